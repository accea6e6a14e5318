import random

from adlens.llm import decontam
from tests.llm.fixtures_llm import AWKWARD, docs, words
from tests.llm.test_jaccard import shingles


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, doc_id string")


def brute(texts, tests):
    whole, sets = {}, {}
    for d, t in texts:
        whole.setdefault(d, set()).update(shingles(t))
    for i, t in tests:
        sets.setdefault(i, set()).update(shingles(t))
    return sorted((d, i, len(s), len(s & w)) for d, w in whole.items() for i, s in sets.items()
                  if d is not None and i is not None and s and 100 * len(s & w) >= 80 * len(s))


def run(spark, texts, tests):
    return sorted((r.doc_id, r.item_id, r.n_item, r.n_found) for r in decontam.search(
        docs(spark, texts), items(spark, tests)).collect())


def test_short_items_in_long_documents(spark):
    r = random.Random(2)
    tests = [(i, words(r.randrange(6, 60), 300 + i, 90)) for i in range(30)]
    texts = []
    for i in range(60):
        w = words(r.randrange(0, 900), i, 90).split(" ")
        for _ in range(r.randrange(0, 3)):
            part = r.choice(tests)[1].split(" ")
            if r.random() < 0.5:
                part[r.randrange(len(part))] = "changed"
            at = r.randrange(len(w) + 1)
            w[at:at] = part
        texts.append((i, " ".join(w).upper() if i % 2 else " ".join(w)))
    want = brute(texts, tests)
    assert len(want) > 20
    assert run(spark, texts, tests) == want


def test_awkward(spark):
    tests = [(1, None), (2, ""), (3, "one two"), (None, "a b c d e"), (4, words(40, 9)), (4, words(40, 9)), (5, words(30000, 9)[:400])]
    texts = AWKWARD + [(40, "One TWO"), (40, words(12, 9)), (41, "one two three")]
    assert run(spark, texts, tests) == brute(texts, tests)


def test_clean_drops_what_holds_an_item(spark):
    item = words(30, 70)
    texts = [(1, words(80, 1) + " " + item), (2, words(80, 2)), (None, item), (3, None)]
    kept = decontam.clean(docs(spark, texts), items(spark, [(1, item)]))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 3]
    assert kept.columns == docs(spark, texts).columns


def test_empty(spark):
    assert run(spark, [], [(1, "a b c d e")]) == []
    assert run(spark, [(1, "a b c d e")], []) == []
