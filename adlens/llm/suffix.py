"""Exact substring dedup over whole texts: longest-previous-factor tests on
sharded, truncated suffix orders.

A byte is covered if it lies in a ``length``-byte string that also starts
somewhere else in the corpus. ``keep="none"`` removes all covered bytes,
``keep="first"`` leaves the first copy (smallest doc_id, then position) of each
string. Matches never cross texts; strings are judged on the input.

1. *Shards.* Every start position p of a ``length``-byte window belongs to the
   least hash v(p) of the ``gram``-byte strings inside the window. Equal windows
   have equal v wherever they stand, so a shard holds all copies of its windows.
   Neighbouring starts with one v form a *segment*; a text of n bytes has about
   2 n / (length - gram) segments, and only these small rows are shuffled.
2. *Copies.* Segments whose v occurs once are unique. Equal segments (128 bits
   of hashes, and their size) collapse to one with a count, combined map-side;
   a passage in a third of all texts is one row a task.
3. *Suffix order.* The bytes of one copy of every remaining segment meet in
   their shard. Windows are put in suffix order by prefix doubling up to
   ``length`` bytes; windows equal that far tie and stand by position. So in
   this order the previous smaller position of a window with a common prefix of
   at least ``length`` is its left neighbour, the next larger its right one: its
   longest previous factor reaches ``length`` iff it ties with the left one.
   A shard of more than ``SHARD_BYTES`` of different segments (a short notice in
   many texts, with other bytes around it in each) is not gathered: its windows
   are dealt by their own 128 bits of hashes, counted map-side, and only those
   that occur twice come back to their texts.
4. *Spans.* Matching starts become byte intervals of their texts.

The same steps over words instead of bytes (each word as three characters, 21 bits of its hash) find passages
of more than 50 words that occur twice, however short their words are: ``repeated_words`` counts
the words in them.

Defined cases: null and empty texts have no bytes and nothing removed; texts
shorter than ``length`` stay whole; a null doc_id is kept and takes part (it
counts as the smallest); rows that repeat a doc_id are texts of their own, told
apart by content, and equal rows are copies of each other, treated alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm.common import narrow, release, small_batches, staged
from adlens.llm.shingle import mix, text_chunks, words_of

LENGTH, GRAM = 400, 64
WORDS, WORD_GRAM, UNIT = 51, 5, 3  # a passage, its grams (both in words), and the characters a word becomes
CHUNK = 512 << 10  # bytes of text (whole texts) a task hashes at a time
SHARD_BYTES = 1 << 20  # bytes put in suffix order at a time (a larger shard is dealt by its windows)
WINDOWS = 1 << 19  # windows handed on at a time

_rng = np.random.default_rng(977)
_BYTES = [_rng.integers(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1) for _ in range(2)]
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _tables or len(_tables[which][0]) < n:
        pair = []
        for base in (_BASES[which], pow(_BASES[which], -1, 2**64)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            pair.append(np.cumprod(a, out=a))
        _tables[which] = tuple(pair)
    p, inv = _tables[which]
    return p[:n], inv[:n]


class _Prefix:
    """Polynomial prefix sums of a run of bytes; hashes of any substrings in O(1)."""

    def __init__(self, data: np.ndarray, which: int):
        p, self.inv = _powers(which, len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[which][data] * p[:-1], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.inv[start])

    def grams(self, size: int) -> np.ndarray:
        return mix((self.total[size:] - self.total[:-size]) * self.inv[: len(self.total) - size])


def _window_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w elements (running minima from block edges, both ways)."""
    n = len(a) - w + 1
    padded = np.concatenate([a, np.full(-len(a) % w, np.iinfo(a.dtype).max, a.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, 1).reshape(-1)
    back = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[w - 1: w - 1 + n])


_SEGMENT = pa.schema([("doc", pa.int64()), ("tkey", pa.int64()), ("v", pa.int64()), ("s0", pa.int32()),
                      ("cnt", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64()), ("inner", pa.bool_())])
_SEGMENT_SQL = "doc long, tkey long, v long, s0 int, cnt int, c1 long, c2 long, inner boolean"


def _segments(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for at, data, off in text_chunks(batch.column(2), CHUNK):
                long = np.flatnonzero(np.diff(off) >= length)
                if not len(long):
                    continue
                first, second = _Prefix(data, 0), _Prefix(data, 1)
                grams = first.grams(gram)
                out: list[list[np.ndarray]] = [[] for _ in range(6)]
                for d in long:
                    a, b = off[d], off[d + 1]
                    g = grams[a: b - gram + 1]
                    v = _window_min(g, length - gram + 1)
                    s0 = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1])
                    cnt = np.diff(np.append(s0, len(v)))
                    found = v[s0]
                    keys_here, number = np.unique(found, return_inverse=True)
                    slot = np.minimum(np.searchsorted(keys_here, g), len(keys_here) - 1)
                    often = np.bincount(slot[keys_here[slot] == g], minlength=len(keys_here)) > 1
                    start, end = a + s0, a + s0 + cnt + length - 1
                    for column, x in zip(out, (np.full(len(s0), at + d), found, s0, cnt, start, end)):
                        column.append(x)
                    out.append(often[number])
                row, v, s0, cnt, start, end = (np.concatenate(c) for c in out[:6])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[row]), pa.array(keys[row]), pa.array(v.view(np.int64)), pa.array(s0.astype(np.int32)),
                     pa.array(cnt.astype(np.int32)), pa.array(first.of(start, end).view(np.int64)),
                     pa.array(second.of(start, end).view(np.int64)), pa.array(np.concatenate(out[6:]))], schema=_SEGMENT)
    return run


_BODY = pa.schema([("v", pa.int64()), ("doc", pa.int64()), ("tkey", pa.int64()), ("s0", pa.int32()),
                   ("cnt", pa.int32()), ("m", pa.int64()), ("large", pa.bool_()), ("body", pa.binary())])
_BODY_SQL = "v long, doc long, tkey long, s0 int, cnt int, m long, large boolean, body binary"


def _cut_bodies(length: int):
    """From (doc, tkey, text, wanted = array of (v, s0, cnt, m, large)) the bytes of each wanted segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = []
                part = batch.slice(at, 200)
                for doc, tkey, text, wanted in zip(*(c.to_pylist() for c in part.columns)):
                    data = text.encode()
                    rows += [(w["v"], doc, tkey, w["s0"], w["cnt"], w["m"], w["large"],
                              data[w["s0"]: w["s0"] + w["cnt"] + length - 1])
                             for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BODY)], schema=_BODY)
    return run


def suffix_ties(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the ``length``-byte windows at ``starts`` in suffix order (equal windows tie)."""
    width, n = 8, len(data)
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = (key << np.uint64(8)) | padded[k: k + n].astype(np.uint64)
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    while width * 2 <= length:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        rank = np.unique(rank * (n + 2) + second, return_inverse=True)[1].astype(np.int64)
        width *= 2
    if width < length:
        return np.unique(rank[starts] * (n + 2) + rank[starts + length - width], return_inverse=True)[1]
    return rank[starts]


def previous_and_next(data: np.ndarray, starts: np.ndarray, position: list[np.ndarray],
                      length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window: is there an equal one at an earlier, and at a later, position?

    ``position`` gives the sort keys of the windows' places in the corpus, the
    most significant first.
    """
    rank = suffix_ties(data, starts, length)
    order = np.lexsort([*position[::-1], rank])
    tie = rank[order][1:] == rank[order][:-1]
    earlier, later = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    earlier[order[1:][tie]] = True
    later[order[:-1][tie]] = True
    return earlier, later


_SPAN = pa.schema([("doc", pa.int64()), ("tkey", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_SPAN_SQL = "doc long, tkey long, a long, b long"


def _laid(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all bodies, their offsets, and of every window: its segment, its place in it, its start in the bytes)."""
    bodies = table["body"].combine_chunks() if isinstance(table, pa.Table) else table["body"]
    off = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset: bodies.offset + len(bodies) + 1].astype(np.int64)
    data = np.frombuffer(bodies.buffers()[2], np.uint8)[off[0]: off[-1]]
    off = off - off[0]
    cnt = table["cnt"].to_numpy()
    owner = np.repeat(np.arange(len(cnt)), cnt)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
    return data, off, owner, within, off[owner] + within


_WINDOW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("tkey", pa.int64()),
                     ("s0", pa.int32()), ("at", pa.int64()), ("m", pa.int64())])
_WINDOW_SQL = "h1 long, h2 long, doc long, tkey long, s0 int, at long, m long"


def _windows(length: int):
    """128 bits of hashes and the place of each window of the segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            data, _, owner, within, starts = _laid(part)
            prefixes = [_Prefix(data, which) for which in (0, 1)]
            doc, tkey, s0, m = (part[c].to_numpy() for c in ("doc", "tkey", "s0", "m"))
            for i in range(0, len(starts), WINDOWS):
                o, a = owner[i: i + WINDOWS], starts[i: i + WINDOWS]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x.of(a, a + length).view(np.int64)) for x in prefixes), pa.array(doc[o]), pa.array(tkey[o]),
                     pa.array(s0[o]), pa.array(s0[o].astype(np.int64) + within[i: i + WINDOWS]), pa.array(m[o])], schema=_WINDOW)
    return run


def _joined(length: int):
    """From (doc, tkey, places = starts of windows) their byte intervals, neighbours as one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, tkey, places in zip(*(c for c in batch.columns)):
                at = np.sort(places.values.to_numpy())
                cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
                n = len(cut)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, doc.as_py())), pa.array(np.full(n, tkey.as_py())), pa.array(at[cut]),
                    pa.array(at[np.append(cut[1:] - 1, len(at) - 1)] + length)], schema=_SPAN)
    return run


def _by_window(bodies: DataFrame, length: int, first_kept: bool) -> DataFrame:
    """Byte intervals that segments of large shards lose (one copy of each segment); no shard is gathered."""
    windows = bodies.mapInArrow(_windows(length), _WINDOW_SQL)
    place = F.struct("doc", "tkey", "at")
    facts = [F.count(F.lit(1)).alias("n")] + ([F.min(place).alias("earliest")] if first_kept else [])
    several = staged(windows.groupBy("h1", "h2").agg(*facts).where("n > 1").drop("n"), "suffix_windows")
    hits = windows.join(several, ["h1", "h2"])
    # all copies of a segment that occurs several times are covered anyway; the first one may stay
    hits = hits.where(place != F.col("earliest") if first_kept else F.col("m") == 1)
    return hits.groupBy("doc", "tkey", "s0").agg(F.collect_list("at").alias("places")).select(
        "doc", "tkey", "places").mapInArrow(_joined(length), _SPAN_SQL)


def _shard(table: pa.Table, length: int, first_kept: bool) -> pa.RecordBatch:
    """Byte intervals that the segments of some complete shards lose (one copy of each segment)."""
    data, off, owner, within, starts = _laid(table)
    cnt, s0, m = (table[c].to_numpy() for c in ("cnt", "s0", "m"))
    # segments without any window that occurs twice here need no order
    h = _Prefix(data, 0).of(starts, starts + length)
    _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
    useful = np.zeros(len(cnt), bool)
    useful[owner[times[inverse] > 1]] = True
    keep = useful[owner]
    if not keep.any():
        return pa.RecordBatch.from_pylist([], _SPAN)
    used = np.flatnonzero(useful)
    size = np.diff(off)[used]
    base = np.concatenate([[0], np.cumsum(size)])
    text = np.concatenate([data[off[i]: off[i + 1]] for i in used])
    new = np.full(len(cnt), -1)
    new[used] = np.arange(len(used))
    owner, within = owner[keep], within[keep]
    doc, tkey = (table[c].to_numpy() for c in ("doc", "tkey"))
    at = s0[owner].astype(np.int64) + within
    earlier, later = previous_and_next(text, base[new[owner]] + within, [doc[owner], tkey[owner], at], length)
    # all copies of a segment that occurs several times are covered anyway; the first one may stay
    hit = earlier if first_kept else (earlier | later) & (m[owner] == 1)
    owner, at = owner[hit], at[hit]
    if not len(owner):
        return pa.RecordBatch.from_pylist([], _SPAN)
    cut = np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)])
    a, b = at[cut], at[np.append(np.flatnonzero(cut)[1:] - 1, len(at) - 1)] + length
    return pa.RecordBatch.from_arrays([pa.array(doc[owner[cut]]), pa.array(tkey[owner[cut]]), pa.array(a), pa.array(b)],
                                      schema=_SPAN)


def _shards(length: int, first_kept: bool):
    """Rows come sorted by v; complete shards are taken together up to ``SHARD_BYTES``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            v = batch.column(0).to_numpy()
            if size >= SHARD_BYTES:
                # everything before the last v is complete
                last = held[-1].column(0)[-1].as_py()
                edge = int(np.searchsorted(v != last, True)) if v[0] == last else 0
                if edge < len(v):
                    if edge:
                        held.append(batch.slice(0, edge))
                    yield _shard(pa.Table.from_batches(held), length, first_kept)
                    held, size, batch = [], 0, batch.slice(edge)
            held.append(batch)
            size += batch.nbytes
        if held:
            yield _shard(pa.Table.from_batches(held), length, first_kept)
    return run


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: str = "none") -> DataFrame:
    """(doc, tkey, a, b): byte intervals to remove (they may overlap). ``docs``: doc, tkey, text."""
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    first_kept = keep == "first"
    spark = docs.sparkSession
    segments = staged(docs.select("doc", "tkey", "text").mapInArrow(_segments(length, gram), _SEGMENT_SQL), "suffix_segments")
    shared = staged(segments.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner"))
                    .where("n > 1 OR inner").select("v"), "suffix_shared")
    live = staged(segments.join(shared, "v", "left_semi"), "suffix_live")
    same = ["v", "c1", "c2", "cnt"]
    groups = staged(live.groupBy(*same).agg(
        F.count(F.lit(1)).alias("m"), F.min(F.struct("doc", "tkey", "s0")).alias("first"), F.max("inner").alias("inner")),
        "suffix_groups")
    release(spark)
    size = F.sum(F.col("cnt").cast("long") + (length - 1))
    kinds = groups.groupBy("v").agg(F.count(F.lit(1)).alias("k"), (size > SHARD_BYTES).alias("large"), F.max("inner").alias("any"))
    # written, so that the join finds two plain shuffles and can split the rows of a frequent v
    kinds = staged(kinds.where("k > 1 OR any").select("v", (F.col("k") > 1).alias("mixed"), "large"), "suffix_kinds")
    wanted = (groups.join(kinds, "v").where("mixed OR inner")
              .select("first.doc", "first.tkey", F.struct("v", "first.s0", "cnt", "m", "large").alias("w"))
              .groupBy("doc", "tkey").agg(F.collect_list("w").alias("wanted")))
    texts = docs.select("doc", "tkey", "text").join(staged(wanted, "suffix_wanted").hint("merge"), ["doc", "tkey"])
    bodies = staged(texts.mapInArrow(_cut_bodies(length), _BODY_SQL), "suffix_bodies")
    release(spark)
    # equal rows would bring a segment's bytes twice
    bodies = bodies.dropDuplicates(["v", "doc", "tkey", "s0"])
    small = bodies.where("NOT large").repartition("v").sortWithinPartitions("v").mapInArrow(
        _shards(length, first_kept), _SPAN_SQL)
    partial = staged(small.union(_by_window(bodies.where("large"), length, first_kept)), "suffix_partial")
    several = groups.where("m > 1").select(*same, "first")
    whole = live.join(several, same)
    if first_kept:
        whole = whole.where(F.struct("doc", "tkey", "s0") != F.col("first"))
    return partial.union(whole.select("doc", "tkey", F.col("s0").cast("long").alias("a"),
                                      (F.col("s0") + F.col("cnt") - 1 + length).cast("long").alias("b")))


def _as_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tkey, text) with each word of the text as ``UNIT`` characters of its hash, nothing between."""
    for batch in batches:
        for at, data, off in text_chunks(batch.column(2), CHUNK):
            h, _, _, row = words_of(data, off)
            codes = np.stack([(h >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) for k in range(UNIT)], axis=1)
            ends = np.searchsorted(row, np.arange(len(off))) * UNIT
            texts = pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(codes.tobytes()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(off) - 1) for k in (0, 1)), texts],
                                             names=["doc", "tkey", "text"])


def repeated_words(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc, tkey, n_repeated_words): how many words of a text lie in a run of ``words`` words that
    also begins elsewhere. ``docs``: doc, tkey, text; texts without any are left out."""
    coded = docs.select("doc", "tkey", "text").mapInArrow(_as_codes, "doc long, tkey long, text string")
    with small_batches(docs.sparkSession):
        spans = staged(covered(coded, words * UNIT, WORD_GRAM * UNIT, "none").distinct(), "suffix_word_spans")
    # the words of overlapping spans count once: what a span adds beyond the furthest end before it
    before = F.max("b").over(Window.partitionBy("doc", "tkey").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("b") - F.greatest("a", F.coalesce(before, F.lit(0))))
    return spans.select("doc", "tkey", new.alias("new")).groupBy("doc", "tkey").agg(
        F.expr(f"sum(new) div {UNIT}").alias("n_repeated_words"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            rows = []
            part = batch.slice(at, 500)
            for doc_id, text, spans in zip(*(c.to_pylist() for c in part.columns[:3])):
                data = (text or "").encode()
                merged: list[list[int]] = []
                for s in sorted((s["a"], s["b"]) for s in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                edges = [0, *(e for s in merged for e in s), len(data)]
                kept = b"".join(data[edges[i]: edges[i + 1]] for i in range(0, len(edges), 2))
                rows.append((doc_id, len(data), len(data) - len(kept), len(merged), merged, kept))
            if rows:
                found = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
                yield pa.RecordBatch.from_arrays([*found, *part.columns[3:]], names=[*schema.names, *part.schema.names[3:]])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
          keep: str = "first", words: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, spans ([start, end) pairs), kept (bytes);
    with ``words``, also n_repeated_words (see :func:`repeated_words`).

    Cuts may fall inside a UTF-8 character, as strings are judged by bytes.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col).select(
        "doc_id", F.coalesce("doc_id", F.lit(-2**63)).alias("doc"), F.xxhash64("text").alias("tkey"), "text")
    texts = rows.where("text IS NOT NULL")
    with small_batches(docs.sparkSession):
        spans = staged(covered(texts, length, gram, keep).groupBy("doc", "tkey").agg(
            F.collect_set(F.struct("a", "b")).alias("spans")), "suffix_spans")
    release(docs.sparkSession)
    joined, more, columns = rows.join(spans.hint("merge"), ["doc", "tkey"], "left"), "", ["doc_id", "text", "spans"]
    if words:
        repeated = staged(repeated_words(texts, words), "suffix_words")
        release(docs.sparkSession)
        joined = joined.join(repeated.hint("merge"), ["doc", "tkey"], "left").withColumn(
            "n_repeated_words", F.coalesce("n_repeated_words", F.lit(0)))
        more, columns = ", n_repeated_words long", [*columns, "n_repeated_words"]
    return joined.select(*columns).mapInArrow(
        _cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary{more}")
