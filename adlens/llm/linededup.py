"""Line dedup by content-defined chunks of lines, in built-in functions only.

A line's hash is the first 32 bits of its MD5; a rolling hash over a line and
the one before it ends a chunk where it is divisible by ``divisor``. Boundaries
depend on two neighbouring lines alone, so a passage of lines that stands at
different places in two texts is cut the same way in both (shift-resistant).
Chunks of at least ``min_lines`` lines that occur more than once anywhere are
removed, except their first copy (smallest doc_id, then position).

Chunking happens inside each row (array functions, no shuffle). Hashes alone
find repeated candidates (map-side combined counts, so a chunk in a third of
all rows sends one row a task); only candidates' texts are then grouped by
their *bytes*, so a hash collision never removes anything.

Defined cases: a null text stays null, an empty one stays empty; rows with a
null doc_id pass unchanged and take no part; rows that repeat a doc_id count as
the same document (a chunk at the same place in them is one copy, kept or
removed in all); an empty table gives no rows; a text whose chunks all go
becomes empty; other columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import narrow, staged

DIVISOR = 3
MIN_LINES = 2


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def with_chunks(df: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """Add ``lines`` and ``chunks`` (array of k, at = first line, n = lines, h) to a table with ``text``."""
    df = df.withColumn("lines", F.split("text", "\n", -1))
    df = df.withColumn("lh", F.transform("lines", _line_hash))
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (
        (F.coalesce(F.get("lh", i - 2), F.lit(0)) * 31 + F.get("lh", i - 1)) % divisor == 0))
    df = df.withColumn("starts", F.when(F.col("text").isNotNull(), starts))
    span = lambda s, k: F.coalesce(F.get("starts", k + 1), F.size("lines")) - s
    return df.withColumn("chunks", F.transform("starts", lambda s, k: F.struct(
        k.alias("k"), s.alias("at"), span(s, k).alias("n"),
        F.xxhash64(F.array_join(F.slice("lines", s + 1, span(s, k)), "\n")).alias("h")))).drop("lh", "starts")


def repeated_chunks(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, k, h) of every later copy of a repeated multi-line chunk. ``docs``: doc_id, text."""
    chunked = with_chunks(docs.where("doc_id IS NOT NULL"), divisor)
    # explode_outer: for the plain form Spark adds a filter that chunks each text a second time
    several = F.filter("chunks", lambda c: c["n"] >= min_lines)
    occurrences = chunked.select("doc_id", "lines", F.explode_outer(several).alias("c")).where("c IS NOT NULL")
    counts = (chunked.select(F.explode_outer(F.transform(several, lambda c: c["h"])).alias("h"))
              .where("h IS NOT NULL").groupBy("h").count())
    live = staged(counts.where("count > 1").select("h"), "line_live")
    bytes_of = F.array_join(F.slice("lines", F.col("c.at") + 1, F.col("c.n")), "\n")
    found = staged(occurrences.select("doc_id", F.col("c.k").alias("k"), F.col("c.h").alias("h"), bytes_of.alias("body"))
                   .join(live.hint("merge"), "h", "left_semi"), "line_candidates")
    # grouping compares bytes; the digest only names the group afterwards
    groups = found.groupBy("h", "body").agg(F.count(F.lit(1)).alias("copies"),
                                            F.min(F.struct("doc_id", "k")).alias("first"))
    firsts = staged(groups.where("copies > 1").select("h", F.md5("body").alias("digest"), "first"), "line_firsts")
    copies = found.select("doc_id", "k", "h", F.md5("body").alias("digest")).join(firsts, ["h", "digest"])
    return copies.where(F.struct("doc_id", "k") != F.col("first")).select("doc_id", "k", "h").distinct()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR,
          min_lines: int = MIN_LINES) -> DataFrame:
    """The rows of ``docs`` with later copies of repeated chunks cut out of the text.

    Adds the struct ``line_dedup`` (n_lines, n_chunks, n_removed_chunks,
    n_removed_lines); drop it to return to the input's columns.
    """
    own = narrow(docs, doc_id=id_col, text=text_col)
    gone = staged(repeated_chunks(own, divisor, min_lines).groupBy("doc_id").agg(
        F.collect_set(F.struct("k", "h")).alias("gone")), "line_gone")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), whole)
    rows = with_chunks(rows.join(gone.hint("merge"), "doc_id", "left"), divisor)
    is_gone = lambda c: F.coalesce(F.array_contains("gone", F.struct(c["k"], c["h"])), F.lit(False))
    rows = rows.withColumn("cut", F.filter("chunks", is_gone))
    kept = F.flatten(F.transform(F.filter("chunks", lambda c: ~is_gone(c)),
                                 lambda c: F.slice("lines", c["at"] + 1, c["n"])))
    text = F.when(F.size(F.col("cut")) > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    n = lambda c: F.when(F.col("text").isNull(), 0).otherwise(c).cast("long")
    facts = F.struct(
        n(F.size("lines")).alias("n_lines"), n(F.size("chunks")).alias("n_chunks"),
        n(F.size("cut")).alias("n_removed_chunks"),
        n(F.aggregate("cut", F.lit(0), lambda a, c: a + c["n"])).alias("n_removed_lines"))
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"whole.`{c}`").alias(c) for c in docs.columns],
                       facts.alias("line_dedup"))


ORACLE = """
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE doc_id IS NOT NULL
), f AS (
  SELECT doc_id, i, line, ('0x' || substr(md5(line), 1, 8))::BIGINT AS lh
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM l)
), b AS (
  SELECT *, CASE WHEN i = 0 THEN 1 WHEN (
      coalesce(lag(lh, 2) OVER w, 0) * 31 + lag(lh, 1) OVER w) % 3 = 0 THEN 1 ELSE 0 END AS starts
  FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), g AS (
  SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM b
), c AS (
  SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM g GROUP BY doc_id, k
), r AS (
  SELECT *, n >= 2 AND row_number() OVER (PARTITION BY body, n >= 2 ORDER BY doc_id, k) > 1 AS gone FROM c
), d AS (
  SELECT doc_id, sum(n)::BIGINT AS n_lines, count(*)::BIGINT AS n_chunks,
    count(*) FILTER (WHERE gone)::BIGINT AS n_removed_chunks,
    coalesce(sum(n) FILTER (WHERE gone), 0)::BIGINT AS n_removed_lines,
    coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS kept
  FROM r GROUP BY doc_id
)
SELECT doc_id, n_lines, n_chunks, n_removed_chunks, n_removed_lines, sha256(kept) AS text_sha256 FROM d
"""
