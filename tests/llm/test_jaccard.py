import random
import re

import pytest

from adlens.llm import jaccard
from adlens.llm.shingle import shingles_of, text_chunks
from tests.llm.fixtures_llm import AWKWARD, docs, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(texts):
    sets = [shingles(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            linked = sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b])
            if None not in (texts[a][0], texts[b][0]) and (linked or texts[a][0] == texts[b][0]):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((-1 if d is None else d, len(sets[i]), least.get(find(i)) if d is not None else None)
                  for i, (d, _) in enumerate(texts))


def edited(text, share, seed):
    r = random.Random(seed)
    w = text.split(" ")
    for _ in range(int(len(w) * share)):
        w[r.randrange(len(w))] = f"e{r.randrange(10 ** 6)}"
    return " ".join(w)


def run(spark, texts):
    got = jaccard.join(docs(spark, texts)).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in got)


def test_awkward(spark):
    # a repeated id ties its texts' classes together, also where they are equally long
    texts = AWKWARD + [(60, words(50, 1)), (60, words(50, 2)), (58, words(50, 2)), (61, words(50, 1)), (61, words(50, 3)),
                       (59, words(50, 3))]
    texts += [(20, "one two"), (21, "One Two"), (22, words(30000, 9).upper())]
    assert run(spark, texts) == brute(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_chains_and_shared_passages(spark, seed):
    r = random.Random(seed)
    passage = words(60, 77)
    texts, base = [], words(120, seed)
    for i in range(60):  # around the threshold, so classes, chains and lone ones
        texts.append((1000 - i, edited(base, r.choice([0.0, 0.01, 0.02, 0.03, 0.04, 0.06]), seed * 100 + i)))
    for i in range(40):  # unrelated texts around one passage
        texts.append((i, words(r.randrange(5, 90), 500 + i) + " " + passage))
    chain = words(100, 31)
    for i in range(15):  # each near the next, the ends far apart
        texts.append((2000 + i, chain))
        chain = edited(chain, 0.02, 900 + i)
    texts += [(3000 + i, words(200, 55)) for i in range(10)]
    r.shuffle(texts)
    assert run(spark, texts) == brute(texts)


def test_keeps_one_of_each(spark):
    texts = [(5, words(50, 1)), (3, words(50, 1)), (9, words(50, 2)), (None, "x y"), (8, None), (2, "")]
    kept = jaccard.one_of_each(docs(spark, texts))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 3, 8, 9]
    assert kept.columns == docs(spark, texts).columns


def test_hashed_shingles_are_the_sets():
    import pyarrow as pa
    texts = [t for _, t in AWKWARD] + ["A b C d E", "a B c D e", "a b c d e f a b c d e", "\x0ba\x0cb\x0dc"]
    sizes = [len(s) for _, data, off in text_chunks(pa.array(texts), 50) for s in shingles_of(data, off)]
    assert sizes == [len(shingles(t)) for t in texts]


def test_empty(spark):
    assert jaccard.join(docs(spark, [])).count() == 0
