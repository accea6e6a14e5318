import itertools
import random
from math import comb

import numpy as np
import pytest

from adlens.llm import hamming, jaccard
from adlens.llm.shingle import shingles_of, text_chunks
from tests.llm import test_jaccard as j
from tests.llm.fixtures_llm import AWKWARD, docs, words


def brute(texts, t=85):
    sets = [j.shingles(x) for _, x in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(texts)):
        for b in range(a):
            linked = sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])
            if None not in (texts[a][0], texts[b][0]) and (linked or texts[a][0] == texts[b][0]):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(texts):
        c = least.get(find(i)) if d is not None else None
        out.append((-1 if d is None else d, len(sets[i]), c, None if d is None else d == c))
    return sorted(out)


def run(spark, texts, **options):
    got = hamming.join(docs(spark, texts), **options).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got)


def test_awkward(spark):
    texts = AWKWARD + [(60, words(50, 1)), (60, words(50, 2)), (58, words(50, 2)), (61, words(50, 1)), (61, words(50, 3)),
                       (59, words(50, 3)), (20, "one two"), (21, "One Two"), (22, words(30000, 9).upper())]
    assert run(spark, texts) == brute(texts)


@pytest.mark.parametrize("seed,t", [(1, 85), (2, 85), (3, 90)])
def test_groups_chains_and_shared_passages(spark, seed, t):
    r = random.Random(seed)
    passage = words(60, 77)
    texts, base = [], words(120, seed)
    for i in range(80):
        texts.append((1000 - i, j.edited(base, r.choice([0.0, 0.01, 0.02, 0.03, 0.04, 0.06]), seed * 100 + i)))
    for i in range(60):  # mostly the same passage, a few words of their own
        texts.append((i, words(r.randrange(2, 40), 500 + i) + " " + passage))
    chain = words(100, 31)
    for i in range(15):
        texts.append((2000 + i, chain))
        chain = j.edited(chain, 0.015, 900 + i)
    texts += [(3000 + i, words(200, 55)) for i in range(10)]
    r.shuffle(texts)
    assert run(spark, texts, threshold=t) == brute(texts, t)


def test_every_pair_within_the_radius_meets():
    r = np.random.default_rng(4)
    base = r.integers(0, 65536, hamming.SYMBOLS, dtype=np.uint16)
    signs = [base]
    for _ in range(400):
        other = base.copy()
        at = r.choice(hamming.SYMBOLS, hamming.RADIUS, replace=False)
        other[at] += r.integers(1, 65535, hamming.RADIUS, dtype=np.uint16)
        signs.append(other)
    # the worst case: two errors in every chunk but one
    worst = base.copy()
    for k, c in enumerate(hamming.CHUNKS):
        worst[c[: 1 if k == 0 else 2]] += 1
    signs.append(worst)
    keys = hamming.keys_of(np.stack(signs))
    assert (keys == keys[0]).any(axis=1).all()
    assert len(np.unique(keys[0])) == hamming.SYMBOLS


def test_distance_of_similar_sets():
    lost = sum(comb(64, k) * .15 ** k * .85 ** (64 - k) for k in range(hamming.RADIUS + 1, 65))
    assert lost < 1e-6
    import pyarrow as pa
    r = random.Random(8)
    texts = []
    for n in (6, 20, 100, 700):
        for i in range(60):
            base = words(n + 4, n * 1000 + i, 10 ** 6).split(" ")
            texts += [" ".join(base), " ".join(base + [f"x{r.random()}" for _ in range(n * 3 // 20)])]
    sets = [s for _, data, off in text_chunks(pa.array(texts)) for s in shingles_of(data, off)]
    signs = hamming.signatures(sets)
    gaps = []
    for a, b in itertools.batched(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        alike = both / (len(sets[a]) + len(sets[b]) - both)
        gaps.append((signs[a] != signs[b]).sum() / 64 - (1 - alike))
    assert abs(np.mean(gaps)) < 0.01 and np.std(gaps) < 0.06  # as many differences as the similarity tells


@pytest.mark.parametrize("module,t", [(hamming, 85), (jaccard, 80)])
def test_a_notice_in_many_texts_pairs_nothing(spark, module, t, monkeypatch):
    """Texts of one notice and a few words of their own fall short of the threshold: no pairs are made."""
    notice, seen = words(20, 1), {}
    texts = [(i, f"{notice} " + " ".join(f"o{i}x{k}" for k in range(4))) for i in range(400)]
    texts += [(1000 + i, f"{words(300, 70 + i)} {words(20, 2)}") for i in range(50)]
    plain = module.staged
    monkeypatch.setattr(module, "staged", lambda df, name: seen.setdefault(name, []).append(plain(df, name)) or seen[name][-1])
    got = module.join(docs(spark, texts)).collect()
    assert all(r.component_id == r.doc_id for r in got)
    assert sum(f.count() for f in seen["ham_left" if module is hamming else "jac_pairs"]) == 0


def test_partner_bands_lose_no_pair(spark):
    from adlens.llm.bands import band, to_partner_bands
    from pyspark.sql import functions as F
    for t in (80, 85, 90):
        rows = spark.range(1, 130).select(F.col("id").alias("n")).withColumn("place", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        dealt = {(r.n, r.place, r.band) for r in to_partner_bands(rows, t).collect()}
        of = {r.n: r.b for r in rows.select("n", band(F.col("n")).alias("b")).distinct().collect()}
        for n in range(1, 130):
            for n2 in range(-(-n * t // 100), min(n * 100 // t, 129) + 1):
                needed = -(-t * (n + n2) // (100 + t))
                assert all((n, p, of[n2]) in dealt for p in range(0, n - needed + 1)), (t, n, n2)


def test_empty(spark):
    assert hamming.join(docs(spark, [])).count() == 0
