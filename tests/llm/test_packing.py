import zlib

import numpy as np
import pytest

from adlens.llm import packing
from tests.llm.fixtures_llm import AWKWARD, docs, words


def ids_of(tok, text):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.default_tokenizer())


def check(spark, tok, texts, **options):
    got = packing.pack(docs(spark, texts), **options).collect()
    want = sorted((d is None, d or 0, len(ids_of(tok, t))) for d, t in texts)
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert 0 < at <= options.get("capacity", 2048)
    assert sum(r.length for r in got) == sum(w[2] for w in want)
    by_id = {}
    for d, t in texts:
        by_id.setdefault((d, len(ids_of(tok, t))), []).append(t)
    for key, same in by_id.items():
        ids = np.array(ids_of(tok, same[0]), "<u4")
        found = sorted(pieces[key], key=lambda r: r.start)
        starts = [r.start for r in found]
        assert starts == sorted(list(range(0, len(ids), options.get("capacity", 2048))) * len(same))
        for r in found:
            assert r.ids_crc32 == zlib.crc32(ids[r.start: r.start + r.length].tobytes())
    return got, sequences


def test_awkward(spark, tok):
    check(spark, tok, AWKWARD)


def test_padding_is_small(spark, tok):
    _, sequences = check(spark, tok, [(i, words(30 + 37 * i % 500, i)) for i in range(300)], capacity=512)
    used = sum(n for s in sequences.values() for _, n in s)
    assert used / (512 * len(sequences)) > 0.97


def test_cached_parts_give_the_tokenizers_ids(tok):
    odd = ["it's o'''clock 'S a'tb\x1cx İSTANBUL ΣΑΣ", "é é́x ﬁ ² x²", "don't.won't, ça—va", "ÀÖ×÷ß straße ẞ Ǆ", "#'s a#'s",
           "Straße GROß\xa0x\x85y", "x" * 3000]
    assert packing.WordIds(packing.default_tokenizer())(odd) == [
        np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]


def test_first_fit_decreasing_against_a_plain_scan():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 200):
        lengths = rng.integers(1, 100, n)
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        free, want = [], {}
        for i in np.argsort(-lengths, kind="stable"):
            b = next((j for j, f in enumerate(free) if f >= lengths[i]), len(free))
            if b == len(free):
                free.append(100)
            want[i] = (b, 100 - free[b])
            free[b] -= lengths[i]
        assert all((bins[i], offsets[i]) == want[i] for i in range(n))


def test_equal_rows_spread_over_groups(spark, tok):
    texts = [(None, "")] * 3000 + [(7, "same words")] * 1000
    got = packing.pack(docs(spark, texts), group_size=200).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.sequence_id >> 32, []).append(r)
    assert len(got) == 4000 and len(groups) == 20 and max(map(len, groups.values())) < 400


def test_empty(spark):
    assert packing.pack(docs(spark, [])).count() == 0
