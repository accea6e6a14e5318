import math
import os
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np

from adlens.llm import quality
from adlens.llm.common import discard, new_path, staged
from tests.llm.fixtures_llm import AWKWARD, docs


def prose(seed, n=150):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["the", "an", "re", "ing", "er", "st", "ou"]) for _ in range(r.randrange(1, 4)))
                    for _ in range(n)).capitalize() + "."


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def brute_probabilities(texts, order):
    """Interpolated modified Kneser-Ney as in the textbook, over the characters of the texts."""
    counts = {order: Counter()}
    for t in texts:
        s = " " * (order - 1) + t + " "
        counts[order].update(s[i: i + order] for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    same = {k: defaultdict(dict) for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            same[k][g[:-1]][g[-1]] = v

    def discounts(c):
        n = [sum(1 for v in c.values() if v == i) for i in range(1, 5)]
        y = n[0] / max(n[0] + 2 * n[1], 1)
        return [0] + [max(min(i - (i + 1) * y * (n[i] / n[i - 1] if n[i - 1] else 0), i), quality.LEAST_DISCOUNT) for i in (1, 2, 3)]
    d = {k: discounts(c) for k, c in counts.items()}

    def p(g):
        if not g:
            return 1 / quality.CHARACTERS
        k, low, seen = len(g), p(g[1:]), same[len(g)].get(g[:-1], {})
        total = sum(seen.values())
        if not total:
            return low
        back = sum(d[k][min(c, 3)] for c in seen.values()) / total
        c = seen.get(g[-1], 0)
        return max(c - d[k][min(c, 3)], 0) / total + back * low
    return p


def fold(spark, i):
    return spark.range(1).selectExpr(f"pmod(xxhash64({i}L), {quality.HOLD_OUT}) as x").first().x


def perplexity(text, p, order=quality.ORDER):
    s = " " * (order - 1) + text + " "
    logs = [math.log2(p(s[i: i + order])) for i in range(len(s) - order + 1)]
    return 2 ** (-sum(logs) / len(logs))


MANY = ["The an re, there Thing 12!", "restou ouer an an AN ÉÉ é", "съешь ещё этих мягких булок", "ещё этих булок, да",
        "日本語の文章 日本の本", "a\x00b 𝔘𝔫𝔦 ẞ", "there there an", "one more text, of THE kind"]


def test_probabilities(spark):
    corpus = quality.packed(docs(spark, list(enumerate(MANY))))
    model = quality.train(corpus, labels(spark, [(i, 1, 0) for i in range(len(MANY))]))
    folds = [fold(spark, i) for i in range(len(MANY))]
    p = [brute_probabilities([t for t, f in zip(MANY, folds) if f != left], quality.ORDER) for left in range(-1, quality.HOLD_OUT)]
    r, grams = random.Random(1), set()
    for t in MANY:
        grams |= {t[i: i + 4] for i in range(len(t) - 3)}
    grams |= {"".join(r.choice("".join(MANY) + "ЖżZ") for _ in range(4)) for _ in range(200)}
    wanted = spark.createDataFrame([(lang, g) for g in grams for lang in ("en", "*")], "lang string, g string")
    got = {(x.lang, x.g): x.p for x in quality.probabilities(wanted, model).collect()}
    assert set(got) == {(lang, g) for g in grams for lang in ("en", "*")}
    for (_, g), found in got.items():
        assert np.allclose(found, [q(g) for q in p], rtol=1e-9, atol=0)


def test_perplexity_of_all_trusted_text_without_the_own_fold(spark):
    """Real characters, every trusted text counted, each scored without its own fold; other languages by the pooled model."""
    other = ["булок этих", "本日語", "AN an", "qqq ÉÉ"]
    rows = [(i, t, ("en", "ru", None)[i % 3]) for i, t in enumerate(MANY * 3)] + [(100 + i, t, ("en", "ru", "xx", None)[i]) for i, t in enumerate(other)]
    trust = [(i, 1, 0) for i in range(len(MANY) * 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r.kn.perplexity for r in quality.classify(d, labels(spark, trust)).collect()}
    folds = {i: fold(spark, i) for i, *_ in trust}
    brute = {}
    for i, t, lang in rows:
        own = lang if lang in ("en", "ru") else None
        key = own, folds.get(i)
        if key not in brute:
            brute[key] = brute_probabilities([x for j, x, y in rows if j < 100 and (own is None or y == own)
                                              and (i >= 100 or folds[j] != folds[i])], quality.ORDER)
        assert np.isclose(got[i], perplexity(t, brute[key]), rtol=1e-5), (i, t)
    assert len({got[100 + i] for i in range(4)}) == 4


def test_letters_of_other_scripts_are_told_apart(spark):
    r = random.Random(4)
    text = lambda letters, n=60: " ".join("".join(r.choice(letters) for _ in range(r.randrange(3, 8))) for _ in range(n))
    good = [(i, text("абвгд")) for i in range(120)]
    bad = [(500 + i, text("цчшщъ")) for i in range(10)]
    got = {x.doc_id: x.kn.keep for x in quality.classify(docs(spark, good + bad), labels(spark, [(i, 1, 0) for i in range(100)])).collect()}
    assert sum(got[i] for i in range(100, 120)) >= 17
    assert not any(got[i] for i, _ in bad)


def test_runs_that_outgrow_a_table(spark, monkeypatch):
    texts = [(i, prose(i, 30) + MANY[i % len(MANY)]) for i in range(40)]
    data = np.frombuffer("".join(t for _, t in texts).encode(), np.uint8)
    symbols, _ = quality.symbols_of(data, np.array([0, len(data)]))
    grams, place = quality.grams_of(symbols)
    assert "".join(map(chr, symbols)) == "   " + "".join(t for _, t in texts) + " "
    monkeypatch.setattr(quality, "TABLE", 1)
    again, other = quality.grams_of(symbols)
    for g, at in ((grams, place), (again, other)):
        names = quality.strings_of(symbols, at)
        assert len(set(names)) == len(names)
        assert [names[x] for x in g] == ["".join(map(chr, symbols[i: i + 4])) for i in range(len(symbols) - 3)]


def test_tells_junk_and_odd_words_from_prose(spark):
    texts = [(i, prose(i)) for i in range(300)]
    junk = [(1000 + i, prose(5000 + i).upper().replace(" ", "!! ")) for i in range(20)]
    odd = [(2000 + i, prose(6000 + i) + " zzyxq wvvkj") for i in range(20)]
    done = quality.classify(docs(spark, texts + junk + odd), labels(spark, [(i, 1, 0) for i in range(200)] + [(1000, 0, 0)]))
    keep = {r.doc_id: r.kn.keep for r in done.collect()}
    assert sum(keep[i] for i in range(200, 300)) >= 92  # held-out prose
    assert not any(keep[i] for i, _ in junk + odd)


def test_awkward(spark):
    good = [(i, prose(i, 40)) for i in range(100, 140)]
    texts = AWKWARD + good
    d = docs(spark, texts)
    trust = labels(spark, [(i, 1, 0) for i, _ in good] + [(101, 0, 0), (102, 1, None), (None, 1, 0), (103, None, None), (999, 1, 0)])
    done = quality.classify(d, trust)
    assert done.columns == [*d.columns, "kn"]
    got = done.collect()
    assert len(got) == len(texts)
    for r in got:
        blank = not (r.text or "").strip()
        assert (r.kn.perplexity is None) == blank
        assert r.kn.keep in (True, False) and not (blank and r.kn.keep)
    trusted = {r.doc_id for r in quality.trusted_ids(trust).collect()}
    assert trusted == {i for i, _ in good if i not in (101, 103)} | {999}


def test_without_trusted_text(spark):
    done = quality.classify(docs(spark, AWKWARD), labels(spark, []))
    assert all(r.kn.keep == bool((r.text or "").strip()) for r in done.collect())
    assert quality.classify(docs(spark, []), labels(spark, [])).count() == 0


def test_length_alone_rejects_no_clean_text(spark):
    vocabulary = prose(77, 4000).lower().strip(".").split()
    r = random.Random(9)
    text = lambda n, odd=0: " ".join(
        "".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) if r.random() < odd else r.choice(vocabulary)
        for _ in range(n))
    rare = 0.0005  # a clean text has odd words at this rate, whatever its length
    good = [(i, text(r.choice([40, 150, 600]), rare)) for i in range(900)]
    long = [(2000 + i, text(8000, rare)) for i in range(60)]
    bad = [(3000 + i, text(8000, 0.05)) for i in range(10)]
    done = quality.classify(docs(spark, good + long + bad), labels(spark, [(i, 1, 0) for i in range(600)]))
    got = {x.doc_id: x.kn for x in done.collect()}
    rejected = lambda ids: sum(not got[i].keep for i in ids) / len(ids)
    assert rejected(range(600, 900)) < 0.06
    assert rejected([i for i, _ in long]) <= rejected(range(600, 900)) + 0.03
    assert not any(got[i].keep for i, _ in bad)


def test_blocks_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 9000)
    monkeypatch.setattr(quality, "PART", "2k")
    texts = [(i, MANY[i % len(MANY)] + prose(i, 20)) for i in range(60)]
    got = quality.classify(docs(spark, texts).coalesce(1), labels(spark, [(i, 1, 0) for i in range(40)])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == texts
    folds = {i: fold(spark, i) for i in range(40)}
    for r in (r for r in got if r.doc_id % 20 == 1):
        p = brute_probabilities([t for i, t in texts if i in folds and folds[i] != folds.get(r.doc_id)], quality.ORDER)
        assert np.isclose(r.kn.perplexity, perplexity(r.text, p), rtol=1e-5)


def test_answers_come_in_waves_and_spent_tables_go(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 1)  # a block a part
    monkeypatch.setattr(quality, "PART", "2k")
    before, answered = set(staged_names(spark)), []
    scored = quality.scored

    def watched(corpus, model, bits, wave):
        asks = {r.block for r in bits.select("block").distinct().collect()}
        assert asks == {r.block for r in corpus.blocks.where(f"wave = {wave}").select("block").distinct().collect()}
        answered.append(asks)
        return scored(corpus, model, bits, wave)

    monkeypatch.setattr(quality, "scored", watched)
    texts = [(i, MANY[i % len(MANY)] + prose(i, 20)) for i in range(60)]
    done = quality.classify(docs(spark, texts).coalesce(1), labels(spark, [(i, 1, 0) for i in range(40)]))
    left = {x.rpartition("_")[0] for x in set(staged_names(spark)) - before}
    assert not left & {"kn_asked", "kn_met", "kn_backed", "kn_probability", "kn_counts", "kn_order"}
    assert len(answered) == quality.WAVES
    sizes = [len(x) for x in answered]
    assert len(set().union(*answered)) == sum(sizes) and max(sizes) - min(sizes) <= 1  # dealt in turn, each block once
    assert sorted((r.doc_id, r.text) for r in done.collect()) == texts


def staged_names(spark):
    root = new_path(spark, "x").rpartition("/")[0].removeprefix("file:")
    return os.listdir(root)


def test_letters():
    text = "aÉ\u0301 ж9_日𝔘!\u200b"
    found = quality._letters(np.array([ord(x) for x in text], np.uint32)).tolist()
    assert found == [unicodedata.category(x)[0] in "LM" for x in text]
    assert not len(quality._letters(np.zeros(0, np.uint32)))


def test_discard(spark):
    kept, spent = staged(spark.range(3), "kept"), staged(spark.range(3), "spent")
    discard(spent, spark.range(3), spent)
    names = staged_names(spark)
    assert kept.count() == 3 and any(x.startswith("kept_") for x in names) and not any(x.startswith("spent_") for x in names)
