"""MinHash near-duplicates by a multi-index join in Hamming space.

A text's signature has ``SYMBOLS`` MinHash values of its word shingles, cut to 16 bits
each; the distance of two signatures is the number of places where they differ. Two
sets of Jaccard similarity s differ in a place with probability 1 - s, so links of 0.85
and more lie within ``RADIUS`` = 25 of 64 places but for six in ten million
at 0.85 itself, and far fewer above it (``tests/llm`` holds the tail of the
binomial distribution to that).

1. *Multi-index.* The 64 places are split into 13 chunks. By pigeonhole two signatures within
   the radius have a chunk with at most 25 // 13 = 1 differing place, so every
   signature is filed under each chunk with each one of its places left out
   (64 keys). Every pair within the radius meets in a bucket, with certainty.
2. *Stars.* Buckets are not expanded into pairs. The most central signature of a
   bucket is its pivot; every text is compared with the pivot it shares most
   buckets with, and, where buckets still hold several classes, with those buckets'
   pivots. A comparison is the signature distance, then the whole shingle sets.
3. *What is left.* Texts in buckets that still hold several classes are paired across
   classes only, where they share a shingle among the rarest of both (two sets of similarity t share one of
   their first |x| - ceil(t |x|) + 1 shingles in any common order, here from rare to frequent), have
   sizes that allow it (:mod:`adlens.llm.bands`) and are within the radius; those pairs are compared in full. Texts around a common passage are
   never paired unless they consist of little else.

Texts with equal sets collapse first and classes are linked by :mod:`adlens.llm.components`. No bucket is gathered
anywhere: counts and pivots are map-side combined aggregates, comparisons are joins whose
skewed sides adaptive execution splits.

Defined cases: null, empty and wordless texts have no shingles and are linked with
nothing; a null doc_id is returned with a null component and takes no part; rows that repeat a
doc_id are linked through it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm.bands import band, to_partner_bands
from adlens.llm.common import narrow, staged
from adlens.llm.components import components
from adlens.llm.jaccard import ORACLE_SHINGLES
from adlens.llm.shingle import mix, shingles_of, text_chunks

THRESHOLD = 85
SYMBOLS = 64
RADIUS = 25
CHUNKS = np.array_split(np.arange(SYMBOLS), 13)
ERRORS = RADIUS // len(CHUNKS)
assert ERRORS == 1  # keys leave out one place of a chunk

_rng = np.random.default_rng(20250212)
_FLIP = _rng.integers(0, 2**63 - 1, SYMBOLS, dtype=np.int64).astype(np.uint64)
_TURN = _rng.integers(0, 2**63 - 1, SYMBOLS, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_PLACE = _rng.integers(0, 2**63 - 1, SYMBOLS, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_LEFT_OUT = _rng.integers(0, 2**63 - 1, SYMBOLS, dtype=np.int64).astype(np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The (sets, SYMBOLS) uint16 signatures of non-empty sets of shingle hashes."""
    flat = np.concatenate(sets)
    start = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    for j in range(SYMBOLS):
        least = np.minimum.reduceat((flat ^ _FLIP[j]) * _TURN[j], start)
        out[:, j] = (mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def keys_of(signs: np.ndarray) -> np.ndarray:
    """The (rows, SYMBOLS) keys: each chunk with each of its places left out."""
    part = mix(signs.astype(np.uint64) * _PLACE + np.arange(SYMBOLS, dtype=np.uint64))
    keys = np.empty(signs.shape, np.uint64)
    for c in CHUNKS:
        for out in c:
            rest = [k for k in c if k != out]
            keys[:, out] = mix(part[:, rest].sum(axis=1, dtype=np.uint64) + _LEFT_OUT[out])
    return keys.view(np.int64)


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, d1, d2, sign) of every row; the digest tells sets apart."""
    for batch in batches:
        for at, data, off in text_chunks(batch.column(1)):
            found = list(shingles_of(data, off))
            digests = _digests(found)
            sizes = np.array([len(s) for s in found], np.int64)
            signs: list = [None] * len(found)
            some = np.flatnonzero(sizes)
            if len(some):
                for i, s in zip(some, signatures([found[i] for i in some])):
                    signs[i] = s.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(found)), pa.array(sizes), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                 pa.array(signs, pa.binary())], names=["doc_id", "n", "d1", "d2", "sign"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = keys_of(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)),
                                              pa.array(np.repeat(batch.column(0).to_numpy(), SYMBOLS))], names=["key", "rep"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (x, y, sx, sy) within the radius."""
    for batch in batches:
        if batch.num_rows:
            near = (_matrix(batch.column(2)) != _matrix(batch.column(3))).sum(axis=1) <= RADIUS
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["x", "y"]).filter(pa.array(near))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, off in text_chunks(batch.column(1)):
            found = list(shingles_of(data, off))
            digests = _digests(found)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()),
                                             pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(found)), pa.array(digests[:, 0]),
                                              pa.array(digests[:, 1]), lists], names=["owner", "d1", "d2", "s"])


class _Index:
    """Signatures and sets of the texts that share a bucket, and their classes so far."""

    def __init__(self, signs: DataFrame, sets: DataFrame, threshold: int):
        self.signs, self.sets, self.t = signs, sets, threshold
        self.classes = staged(sets.select("rep", F.col("rep").alias("cls")), "ham_cls")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) whose signatures are within the radius and whose sets are similar."""
        sx, sy = (self.signs.select(F.col("rep").alias(c), F.col("sign").alias(f"s{c}")) for c in "xy")
        near = staged(pairs.join(sx, "x").join(sy, "y").select("x", "y", "sx", "sy").mapInArrow(_close, "x long, y long"), "ham_near")
        sx, sy = (self.sets.select(F.col("rep").alias(c), F.col("s").alias(f"s{c}")) for c in "xy")
        both = near.join(sx, "x").join(sy, "y").select(
            "x", "y", F.size(F.array_intersect("sx", "sy")).cast("long").alias("both"), (F.size("sx") + F.size("sy")).alias("sum"))
        return both.where(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * self.t).select("x", "y")

    def link(self, pairs: DataFrame) -> None:
        cx, cy = (self.classes.select(F.col("rep").alias(c), F.col("cls").alias(f"c{c}")) for c in "xy")
        edges = self.linked(pairs).join(cx, "x").join(cy, "y").select("cx", "cy").distinct()
        roots = components(edges, "cx", "cy")
        self.classes = staged(self.classes.join(roots, F.col("cls") == F.col("node"), "left").select(
            "rep", F.coalesce("root", "cls").alias("cls")), "ham_cls")

    def open(self, rows: DataFrame, by: str) -> DataFrame:
        """The rows (with class) of groups that hold several classes."""
        rows = staged(rows.join(self.classes, "rep"), "ham_rows")
        several = rows.groupBy(by).agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select(by)
        return staged(rows.join(several, by), "ham_open")


def _left_over(index: _Index, rows: DataFrame, t: int) -> DataFrame:
    """Pairs (x, y) of different classes that share one of their rarest shingles where the rest may still suffice."""
    some = index.sets.join(rows.select("rep", "cls").distinct(), "rep")
    each = some.select("rep", "cls", F.size("s").cast("long").alias("n"), F.explode("s").alias("h"))
    often = staged(each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "ham_df")
    own = Window.partitionBy("rep")
    ranked = each.join(often, "h").select("h", "rep", "cls", "n", F.row_number().over(own.orderBy("df", "h")).alias("at"),
                                          F.count(F.lit(1)).over(own).alias("shared"))
    # shingles that no other of these texts has are the rarest and come first
    first = ranked.withColumn("place", F.col("at") - 1 + F.col("n") - F.col("shared")).where(
        F.expr(f"place <= n - (n * {t} + 99) div 100"))
    first = index.open(staged(first.select("h", "rep", "n", "place"), "ham_first"), "h")
    main = first.groupBy("h", "cls").agg(F.count(F.lit(1)).alias("m")).groupBy("h").agg(
        F.max(F.struct("m", "cls")).getField("cls").alias("main"))
    minor = first.join(main, "h").where("cls <> main").select(
        "h", band(F.col("n")).alias("band"), *[F.col(c).alias(f"{c}2") for c in ("rep", "cls", "n", "place")])
    needed = F.expr(f"({t} * (n + n2) + {99 + t}) div {100 + t}")
    return (to_partner_bands(first, t).join(minor, ["h", "band"]).where((F.col("cls") != F.col("cls2")) & (F.col("n") * 100 >= F.col("n2") * t)
                                         & (F.col("n2") * 100 >= F.col("n") * t)
                                         & (F.col("n") - F.col("place") >= needed) & (F.col("n2") - F.col("place2") >= needed))
            .select(F.least("rep", "rep2").alias("x"), F.greatest("rep", "rep2").alias("y")).distinct())


def classes_of(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(facts, classes): facts (doc_id, n, d1, d2) of every row; classes (n, d1, d2, cls) of every set,
    with the least doc_id of its class."""
    facts = staged(docs.mapInArrow(_facts, "doc_id long, n long, d1 long, d2 long, sign binary"), "ham_facts")
    reps = staged(facts.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2").agg(
        F.min("doc_id").alias("owner"), F.first("sign").alias("sign")).withColumn("rep", F.monotonically_increasing_id()), "ham_reps")
    facts = facts.drop("sign")

    # 1. buckets of two signatures and more
    rows = staged(reps.select("rep", "sign").mapInArrow(_keys, "key long, rep long"), "ham_keys")
    shared = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "ham_shared")
    rows = staged(rows.join(shared, "key"), "ham_buckets")
    central = staged(rows.groupBy("rep").agg(F.sum("c").alias("central")), "ham_central")

    # sets of what shares a bucket; a repeated doc_id may have several, so the digest names them
    some = central.join(reps, "rep").select("rep", "owner", "d1", "d2")
    texts = docs.join(some.select(F.col("owner").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    sets = staged(texts.select("doc_id", "text").mapInArrow(_sets, "owner long, d1 long, d2 long, s array<long>").join(
        some, ["owner", "d1", "d2"]).select("rep", "s").dropDuplicates(["rep"]), "ham_sets")
    signs = reps.join(central, "rep", "left_semi").select("rep", "sign")
    index = _Index(staged(signs, "ham_signs"), sets, threshold)

    # 2. stars
    pivots = staged(rows.join(central, "rep").groupBy("key").agg(F.max(F.struct("central", "rep")).getField("rep").alias("pivot")), "ham_pivots")
    rows = rows.select("key", "rep")
    votes = rows.join(pivots, "key").where("rep <> pivot").groupBy("rep", "pivot").agg(F.count(F.lit(1)).alias("votes"))
    index.link(votes.groupBy("rep").agg(F.max(F.struct("votes", "pivot")).getField("pivot").alias("y")).select(
        F.col("rep").alias("x"), "y"))
    rows = index.open(rows, "key").drop("cls")
    index.link(rows.join(pivots, "key").where("rep <> pivot").select(F.col("rep").alias("x"), F.col("pivot").alias("y")).distinct())

    # 3. what is left
    rows = index.open(rows, "key")
    index.link(staged(_left_over(index, rows, threshold), "ham_left"))
    named = staged(reps.join(index.classes, "rep", "left").select("n", "d1", "d2", "owner", F.coalesce("cls", "rep").alias("cls")), "ham_named")
    least = staged(named.groupBy("cls").agg(F.min("owner").alias("least")), "ham_least")
    return facts, named.join(least, "cls").select("n", "d1", "d2", F.col("least").alias("cls"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (the least doc_id of its class)."""
    facts, classes = classes_of(narrow(docs, doc_id=id_col, text=text_col), threshold)
    ties = facts.where("doc_id IS NOT NULL AND n > 0").join(classes, ["n", "d1", "d2"]).groupBy("doc_id").agg(
        F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b")
    tied = components(ties, "a", "b")
    classes = staged(classes.join(tied, F.col("cls") == F.col("node"), "left").select(
        "n", "d1", "d2", F.coalesce("root", "cls").alias("cls")), "ham_final")
    cls: Column = F.when(F.col("doc_id").isNotNull(), F.coalesce("cls", "doc_id"))
    return facts.join(classes, ["n", "d1", "d2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), cls.alias("component_id"), (F.col("doc_id") == cls).alias("kept"))


ORACLE = f"""
WITH RECURSIVE d AS ({ORACLE_SHINGLES}),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM d),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS nx, any_value(b.n) AS ny
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p WHERE c * 100 >= (nx + ny - c) * {THRESHOLD}),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x AS doc_id, min(y)::BIGINT AS component_id FROM r GROUP BY x)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN m USING (doc_id)
"""
