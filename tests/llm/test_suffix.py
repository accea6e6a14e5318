import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlens.llm import suffix
from adlens.llm.common import staged
from tests.llm.fixtures_llm import AWKWARD, docs, words


def brute(texts, length, keep="none"):
    data = [(t or "").encode() for _, t in texts]
    count, first = Counter(), {}
    order = sorted(range(len(texts)), key=lambda i: (texts[i][0] is not None, texts[i][0] or 0))
    for d in order:
        for i in range(len(data[d]) - length + 1):
            w = data[d][i: i + length]
            count[w] += 1
            first.setdefault(w, (d, i))
    out = []
    for d, (doc_id, _) in enumerate(texts):
        b = data[d]
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i: i + length]
            if count[w] > 1 and (keep == "none" or first[w] != (d, i)):
                gone[i: i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((-1 if doc_id is None else doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, texts, **options):
    got = suffix.dedup(docs(spark, texts), **options).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans,
                   hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)


def shared(seed):
    r = random.Random(seed)
    passages = [words(90, 40 + i) for i in range(3)]
    texts = []
    for i in range(30):
        parts = [words(r.randrange(3, 60), seed * 1000 + i)] + [
            r.choice(passages)[r.randrange(0, 60):] for _ in range(r.randrange(0, 3))]
        r.shuffle(parts)
        texts.append((i, " ".join(parts)))
    return texts + [(50, "ab" * 600), (51, "x" * 900), (52, "Orre " * 300), (60, texts[0][1]), (61, texts[0][1])]


@pytest.mark.parametrize("keep", ["none", "first"])
def test_against_brute_force(spark, keep):
    texts = shared(4)
    assert run(spark, texts, keep=keep, length=120, gram=24) == brute(texts, 120, keep)


def test_contract_length(spark):
    texts = shared(5)
    assert run(spark, texts, keep="none") == brute(texts, 400)


def test_awkward(spark):
    # repeated ids are texts of their own; equal rows are copies
    texts = AWKWARD + [(8, "é" * 700), (8, words(300, 1)), (9, words(300, 1)[7:])]
    texts = [t for t in texts if t[0] != 5]
    assert run(spark, texts, keep="none") == brute(texts, 400)


def test_suffix_ties_order_windows():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 300).astype(np.uint8)
    starts = np.arange(300 - 21)
    rank = suffix.suffix_ties(data, starts, 21)
    windows = [data[i: i + 21].tobytes() for i in starts]
    assert list(rank) == [sorted(set(windows)).index(w) for w in windows]


@pytest.mark.parametrize("keep", ["none", "first"])
def test_notice_in_many_texts_is_gathered_nowhere(spark, keep, monkeypatch):
    most, seen = 30_000, {}
    monkeypatch.setattr(suffix, "SHARD_BYTES", most)
    monkeypatch.setattr(suffix, "staged", lambda df, name: seen.setdefault(name, staged(df, name)))
    notice, long = words(60, 1)[:250], words(120, 2)[:450]
    texts = [(i, f"{words(40, 500 + i)} {notice if i % 3 else long} {words(40, 9000 + i)}") for i in range(400)]
    texts += [(400, texts[1][1]), (401, texts[2][1][50:]), (402, texts[3][1]), (402, texts[3][1]), (403, "ab" * 20_000)]
    assert run(spark, texts, keep=keep) == brute(texts, 400, keep)
    bodies = seen["suffix_bodies"]
    if "large" in bodies.columns:
        bodies = bodies.where("NOT large")
    assert max((r.n for r in bodies.groupBy("v").agg(F.sum(F.length("body")).alias("n")).collect()), default=0) <= most


def test_empty(spark):
    assert suffix.dedup(docs(spark, [])).count() == 0


def brute_words(texts, n):
    split = [[w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", (t or ""))] for _, t in texts]
    split = [["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in ws] for ws in split]
    count = Counter(tuple(ws[i: i + n]) for ws in split for i in range(len(ws) - n + 1))
    out = []
    for (doc_id, _), ws in zip(texts, split):
        in_one = [False] * len(ws)
        for i in range(len(ws) - n + 1):
            if count[tuple(ws[i: i + n])] > 1:
                in_one[i: i + n] = [True] * n
        out.append((-1 if doc_id is None else doc_id, sum(in_one)))
    return sorted(out)


def test_passages_by_words(spark):
    r = random.Random(3)
    passages = [words(r.randrange(51, 80), 900 + i) for i in range(6)] + [" ".join("ab"[r.randrange(2)] for _ in range(60))]
    texts = AWKWARD[:6] + [(100 + i, f"{words(r.randrange(9), i)} {passages[i % 7]}  {words(r.randrange(90), 70 + i)}") for i in range(20)]
    texts += [(200, words(50, 900)), (201, words(50, 900)), (202, "one " * 30), (203, words(120, 77)), (203, words(120, 77)),
              (204, words(51, 33).upper() + " end"), (205, "a " + words(51, 33))]
    got = suffix.dedup(docs(spark, texts), keep="none", words=suffix.WORDS).collect()
    assert sorted((-1 if g.doc_id is None else g.doc_id, g.n_repeated_words) for g in got) == brute_words(texts, suffix.WORDS)
    short = suffix.dedup(docs(spark, texts), keep="none", words=7).collect()
    assert sorted((-1 if g.doc_id is None else g.doc_id, g.n_repeated_words) for g in short) == brute_words(texts, 7)
