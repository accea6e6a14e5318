"""N-gram Jaccard join: exact similarity classes of whole texts as a join in the
Jaccard metric space, with pivots, Voronoi regions and triangle windows.

Documents with equal shingle sets collapse first. Then, exactly:

1. *Shells.* A document can only have a neighbour if enough of its shingles
   occur in other sets. Its smallest hashes (a fixed share of its set) are
   matched across all documents, then, for the few documents left, the whole
   sets. Tasks combine equal shingles before the shuffle, so a shingle of a
   third of all documents sends one row a task.
2. *Postings.* In the order from rare to frequent, two sets of similarity t
   share one of their first |x| - ceil(t |x|) + 1 shingles. These are the only
   places where neighbours can meet; frequent passages are not among them
   unless a text consists of little else.
3. *Pivots and Voronoi regions.* The most central document of each posting is
   its pivot; a document's home is the pivot it shares most postings with, and
   its exact distance decides whether it lies within the radius r = 1 - t of it.
   Documents within r of a pivot form one class, so nothing inside a region's
   core is ever paired.
4. *Windows, recursively.* Postings that still hold several classes are joined
   again: their documents are replicated to every such posting's pivot and
   measured; classes merge; what is still open is joined between classes only,
   and only where the distances to the common pivot differ by at most r
   (triangle inequality) and the places of the posting in both sets leave
   room for the needed overlap; postings are split by set size, so that texts which
   cannot reach it are not paired at all (:mod:`adlens.llm.bands`). Every other pair is proven further apart than r.

Classes are linked by :mod:`adlens.llm.components`. Shingles are 64-bit hashes
(:mod:`adlens.llm.shingle`), sets are told apart by 128 bits.

Defined cases: null, empty and wordless texts have no shingles and are linked
with nothing; a null doc_id is returned with a null component and takes no
part; rows that repeat a doc_id are linked through it (each row keeps its own
size); an empty table gives no rows; other columns are ignored.
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
from adlens.llm.shingle import shingles_of, text_chunks

THRESHOLD = 80
EXTRA = 10  # per cent of a set sent beyond the least prefix, so that a lone common shingle does not count
BUFFER = 1 << 21  # shingles a task combines at a time


def _miss(n, t: int):
    """Shingles of a set of size n that a neighbour may lack."""
    return n - (n * t + 99) // 100


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests = [], []
        for _, data, off in text_chunks(batch.column(1)):
            for s in shingles_of(data, off):
                sizes.append(len(s))
                digests.append(_digest(s))
        d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(d[:, 0], pa.int64()), pa.array(d[:, 1], pa.int64())],
            names=["doc_id", "n", "d1", "d2"])


_SENT = pa.schema([("h", pa.int64()), ("key", pa.int64()), ("live", pa.int64()), ("own", pa.bool_())])
_SENT_SQL = "h long, key long, live long, own boolean"


class _Combiner:
    """Combines the shingles of many sets: one row for each shingle, and for each
    set the number of its shingles that another set of this buffer has too."""

    def __init__(self):
        self.sets: dict[int, np.ndarray] = {}
        self.size = 0

    def add(self, key: int, some: np.ndarray) -> None:
        if key not in self.sets and len(some):
            self.sets[key] = some
            self.size += len(some)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys = np.fromiter(self.sets, np.int64, len(self.sets))
        h = np.concatenate(list(self.sets.values()))
        owner = np.repeat(np.arange(len(keys)), [len(s) for s in self.sets.values()])
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        shared = np.diff(np.append(np.flatnonzero(first), len(h))) > 1
        here = np.bincount(owner[np.repeat(shared, np.diff(np.append(np.flatnonzero(first), len(h))))],
                           minlength=len(keys))
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[first].view(np.int64)), pa.array(keys[owner[first]]), pa.array(shared.astype(np.int64)),
             pa.array(np.zeros(len(shared), bool))], schema=_SENT)
        some = np.flatnonzero(here)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[some]), pa.array(keys[some]), pa.array(here[some].astype(np.int64)),
             pa.array(np.ones(len(some), bool))], schema=_SENT)
        self.sets, self.size = {}, 0


def _low_shingles(t: int, extra: int):
    """Combined rows of each text's smallest hashes; key is the first half of the set's digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = _Combiner()
        for batch in batches:
            for _, data, off in text_chunks(batch.column(0)):
                for s in shingles_of(data, off):
                    if n := len(s):
                        key = int.from_bytes(_digest(s)[:8], "little", signed=True)
                        buffer.add(key, s[: _miss(n, t) + 1 + n * extra // 100])
                if buffer.size >= BUFFER:
                    yield from buffer.flush()
        yield from buffer.flush()
    return run


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    buffer = _Combiner()
    for batch in batches:
        sets = batch.column(1)
        off = sets.offsets.to_numpy()
        flat = sets.values.to_numpy(zero_copy_only=False).view(np.uint64)
        for i, key in enumerate(batch.column(0).to_pylist()):
            buffer.add(key, flat[off[i]: off[i + 1]])
            if buffer.size >= BUFFER:
                yield from buffer.flush()
    yield from buffer.flush()


def _live(sent: DataFrame) -> DataFrame:
    """(key, live): how many of a set's sent shingles another set sent too (or more: a superset is safe)."""
    # ``own`` rows are what a task has counted already, dealt out by their key; they only pass through
    of = Window.partitionBy("h", "own")
    found = sent.withColumn("two", F.min("key").over(of) != F.max("key").over(of)).withColumn(
        "marks", F.sum("live").over(of))
    live = F.when(F.col("own"), F.col("live")).when(F.expr("live = 0 AND (two OR marks > 0)"), 1)
    return found.select("key", live.alias("live")).where("live > 0").groupBy("key").agg(F.sum("live").alias("live"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for at, data, off in text_chunks(batch.column(1)):
            found = [s.view(np.int64) for s in shingles_of(data, off)]
            digests = np.frombuffer(b"".join(_digest(s) for s in found), np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(found)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists],
                                             names=["owner", "d1", "d2", "s"])


def _similar(common: Column, n1: Column, n2: Column, t: int) -> Column:
    return common * 100 >= (n1 + n2 - common) * t


class _Classes:
    """The class of each set so far: a table (rep, n, cls), rewritten as links come in."""

    def __init__(self, sets: DataFrame):
        self.table = staged(sets.select("rep", F.size("s").cast("long").alias("n"), F.col("rep").alias("cls")), "jac_cls")

    def link(self, links: DataFrame) -> None:
        cls = self.table.select("rep", "cls")
        edges = (links.join(cls.withColumnsRenamed({"rep": "x", "cls": "cx"}), "x")
                 .join(cls.withColumnsRenamed({"rep": "y", "cls": "cy"}), "y").select("cx", "cy").distinct())
        roots = components(edges, "cx", "cy")
        self.table = staged(self.table.join(roots, F.col("cls") == F.col("node"), "left").select(
            "rep", "n", F.coalesce("root", "cls").alias("cls")), "jac_cls")


def _measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Add ``common`` and both sizes to pairs (x, y), by the sets themselves."""
    sx = sets.select(F.col("rep").alias("x"), F.col("s").alias("sx"))
    sy = sets.select(F.col("rep").alias("y"), F.col("s").alias("sy"))
    # the ids first meet the sets of the many (x), then those of the few pivots (y)
    return pairs.join(sx, "x").join(sy, "y").select(
        "x", "y", F.size(F.array_intersect("sx", "sy")).cast("long").alias("common"),
        F.size("sx").cast("long").alias("nx"), F.size("sy").cast("long").alias("ny"))


def _open(postings: DataFrame, classes: _Classes) -> DataFrame:
    """Postings (h, rep, central, cls) that still hold several classes."""
    rows = staged(postings.join(classes.table.select("rep", "cls"), "rep"), "jac_rows")
    several = staged(rows.groupBy("h").agg(F.min("cls").alias("a"), F.max("cls").alias("b"),
                                           F.max(F.struct("central", "rep")).alias("top"))
                     .where("a <> b").select("h", F.col("top.rep").alias("pivot")), "jac_open")
    return staged(rows.join(several, "h"), "jac_open_rows")


def _postings(sets: DataFrame, t: int) -> DataFrame:
    """(h, rep, n, place, central): the rare-first prefix of each set; place = how many of its n shingles
    come before; central = mean frequency of its shingles."""
    rows = sets.select("rep", F.size("s").cast("long").alias("n"), F.explode("s").alias("h"))
    often = staged(rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "jac_df")
    known = rows.join(often, "h")
    own = Window.partitionBy("rep")
    ranked = known.select(
        "h", "rep", "n", F.row_number().over(own.orderBy("df", "h")).cast("long").alias("at"),
        F.count(F.lit(1)).over(own).alias("shared"), (F.sum("df").over(own) * 1000 / F.col("n")).cast("long").alias("central"))
    # a set's shingles that no other has are the rarest of all and come first
    place = F.col("at") - 1 + F.col("n") - F.col("shared")
    return staged(ranked.withColumn("place", place).where(F.expr(f"place <= n - (n * {t} + 99) div 100"))
                  .select("h", "rep", "n", "place", "central"), "jac_postings")


def classes_of(docs: DataFrame, threshold: int = THRESHOLD, extra: int = EXTRA) -> tuple[DataFrame, DataFrame]:
    """(facts, classes): facts (doc_id, n, d1, d2) of every row; classes (n, d1, d2, owner, cls) of every
    set, with the least doc_id of the set and of its class."""
    t = threshold
    facts = staged(docs.mapInArrow(_facts, "doc_id long, n long, d1 long, d2 long"), "jac_facts")
    # one row a distinct set; ``rep`` numbers it (written, so the numbers stay), ``owner`` is a document that has it
    reps = staged(facts.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2").agg(
        F.min("doc_id").alias("owner")).withColumn("rep", F.monotonically_increasing_id()), "jac_reps")

    # 1. shells
    low = _live(docs.where("doc_id IS NOT NULL").select("text").mapInArrow(_low_shingles(t, extra), _SENT_SQL))
    least = F.expr(f"1 + ((n * {t} + 99) div 100) * {extra} div 100")
    near = staged(reps.join(low, F.col("d1") == F.col("key")).where(F.col("live") >= least)
                  .select(F.col("owner").alias("doc_id")).distinct(), "jac_near")
    some = docs.join(near.hint("merge"), "doc_id", "left_semi").select("doc_id", "text")
    sets = staged(some.mapInArrow(_sets, "owner long, d1 long, d2 long, s array<long>").join(
        reps, ["owner", "d1", "d2"]).select("rep", "s").dropDuplicates(["rep"]), "jac_sets")
    close = _live(sets.mapInArrow(_all_shingles, _SENT_SQL))
    sets = staged(sets.join(close, F.col("rep") == F.col("key")).where(
        F.expr(f"live >= (size(s) * {t} + 99) div 100")).select("rep", "s"), "jac_sets")

    # 2. postings
    postings = _postings(sets, t)
    classes = _Classes(sets)

    # 3. homes: the pivot that shares most postings, one exact distance a document
    rows = _open(postings, classes)
    votes = rows.where("rep <> pivot").groupBy("rep", "pivot").agg(F.count(F.lit(1)).alias("votes"))
    home = votes.groupBy("rep").agg(F.max(F.struct("votes", "pivot")).alias("best")).select(
        F.col("rep").alias("x"), F.col("best.pivot").alias("y"))
    similar = _similar(F.col("common"), F.col("nx"), F.col("ny"), t)
    classes.link(_measure(home, sets).where(similar))

    # 4. replicate what is open to every open pivot, measure, merge
    rows = _open(postings, classes)
    reach = staged(_measure(rows.where("rep <> pivot").select(F.col("rep").alias("x"), F.col("pivot").alias("y"))
                            .distinct(), sets), "jac_reach")
    classes.link(reach.where(similar))

    # 5. between the classes of what is open, inside triangle windows around the pivot
    rows = rows.drop("cls").join(classes.table.select("rep", "cls"), "rep")
    far = F.col("common") / (F.col("nx") + F.col("ny") - F.col("common"))
    rows = rows.join(reach.select(F.col("x").alias("rep"), F.col("y").alias("pivot"), (1 - far).alias("d")),
                     ["rep", "pivot"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    rows = staged(rows, "jac_windows")
    sizes = rows.groupBy("h", "cls").agg(F.count(F.lit(1)).alias("m"))
    main = staged(sizes.groupBy("h").agg(F.max(F.struct("m", "cls")).alias("top"), F.count(F.lit(1)).alias("k"))
                  .where("k > 1").select("h", F.col("top.cls").alias("main")), "jac_main")
    minor = rows.join(main, "h").where("cls <> main").select(
        "h", band(F.col("n")).alias("band"), F.col("rep").alias("y"), F.col("cls").alias("cy"), F.col("d").alias("dy"),
        F.col("n").alias("ny"), F.col("place").alias("py"))
    radius = (100 - t) / 100 + 1e-9
    # at the first posting that two sets share, what follows it in both must still hold the needed overlap;
    # a pair that fails this here either has an earlier common posting or is not similar
    needed = F.expr(f"({t} * (n + ny) + {99 + t}) div {100 + t}")
    rows = to_partner_bands(rows.select("h", F.col("rep").alias("x"), "cls", "d", "n", "place"), t)
    pairs = (rows.join(minor, ["h", "band"])
             .where((F.col("cls") != F.col("cy")) & (F.abs(F.col("d") - F.col("dy")) <= radius)
                    & (F.col("n") - F.col("place") >= needed) & (F.col("ny") - F.col("py") >= needed))
             .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    classes.link(_measure(staged(pairs, "jac_pairs"), sets).where(similar))
    named = staged(reps.join(classes.table.select("rep", "cls"), "rep", "left").select(
        "n", "d1", "d2", "owner", F.coalesce("cls", "rep").alias("cls")), "jac_named")
    least = staged(named.groupBy("cls").agg(F.min("owner").alias("least")), "jac_least")
    return facts, named.join(least, "cls").select("n", "d1", "d2", "owner", F.col("least").alias("cls"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, set_id (least doc_id with the same set), component_id."""
    facts, classes = classes_of(narrow(docs, doc_id=id_col, text=text_col), threshold)
    # rows that repeat a doc_id with another text tie their classes together
    owners = facts.where("doc_id IS NOT NULL AND n > 0").join(classes, ["n", "d1", "d2"])
    ties = owners.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b"))
    tied = components(ties.where("a <> b"), "a", "b")
    classes = classes.join(tied, F.col("cls") == F.col("node"), "left").withColumn("cls", F.coalesce("root", "cls"))
    classes = staged(classes.select("n", "d1", "d2", "owner", "cls"), "jac_final")
    return facts.join(classes, ["n", "d1", "d2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("owner", "doc_id")).alias("set_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("cls", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its class (and those with a null doc_id)."""
    gone = staged(join(docs, id_col, text_col, **options).where("component_id <> doc_id").select(
        F.col("doc_id").alias("__gone_id")).distinct(), "jac_gone")
    return docs.join(gone.hint("merge"), F.col(f"`{id_col}`") == F.col("__gone_id"), "left_anti")


ORACLE_SHINGLES = """
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i:
      array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents)
"""
ORACLE = f"""
WITH RECURSIVE d AS ({ORACLE_SHINGLES}),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM d),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS nx, any_value(b.n) AS ny
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
),
l AS (SELECT x, y FROM p WHERE c * 100 >= (nx + ny - c) * 80),
r AS (
  SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, (SELECT min(y) FROM r WHERE r.x = d.doc_id)::BIGINT AS component_id FROM d
"""
