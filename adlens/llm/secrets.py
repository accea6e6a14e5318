"""Secret scanning with multipart credential linking.

Three base kinds count by themselves: ``assign`` (a named password, token or
key with a value), ``access`` (cloud access identifiers) and ``hex`` (long hex
runs). Weak parts - an account name, a mixed-character blob, a host or address -
say little alone; they are reported only when a *complementary* part lies in
their scope, the ``window`` code points around them in the same text:

* a weak secret needs an identifier (``access`` or ``account``) or an endpoint;
* an account name or an endpoint needs a secret (``assign``, ``hex`` or a weak one).

Texts are scanned in their tasks; only parts (a few integers each) leave. The
interval join within scopes is a merge over each text's parts in order of start: every part
meets the complementary part that ends last before it and the one that starts first
after it, so it costs a sort, never a row per pair. The nearer of the two within the scope is
the part's ``partner`` and is reported with it (ties: the one before).

Defined cases: null and empty texts give a row with zero counts; a null doc_id
is kept; repeated rows give a row each (rows are told apart by position, not by
doc_id); ties of start are ordered by kind; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm.common import narrow, staged

WINDOW = 200
# --- Fixed values: kinds in the order of the result, base kinds first ---------
KINDS = ("assign", "access", "hex", "account", "blob", "endpoint")
# --- end of fixed values -------------------------------------------------------
N_BASE = 3
_SECRETS, _IDENTIFIERS, _ENDPOINTS = (0, 2, 4), (1, 3), (5,)

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_BLOB = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}(?![A-Za-z0-9+/])")
_ACCOUNT = re.compile(r"""(?i:user(?:_?name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}""",
                      re.ASCII)
_ENDPOINT = re.compile(r"""https?://[^\s"'<>]{4,}|(?<![\w.@])(?:\d{1,3}\.){3}\d{1,3}(?![\w.])""", re.ASCII)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, leftmost and non-overlapping per kind."""
    found = [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [(2, m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def _mixed(s: str) -> bool:
    return s != s.lower() and s != s.upper() and any(c.isdigit() for c in s)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts outside the base spans; none where no part could complement."""
    free = lambda m: all(m.end() <= a or b <= m.start() for _, a, b in base)
    blobs = [(4, m.start(), m.end()) for m in _BLOB.finditer(text) if _mixed(m[0]) and free(m)]
    if not blobs and not any(k in _SECRETS for k, _, _ in base):
        return []
    return blobs + [(k, m.start(), m.end()) for k, p in ((3, _ACCOUNT), (5, _ENDPOINT))
                    for m in p.finditer(text) if free(m)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("kind", pa.int32()),
                        ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        rows = []
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for row, doc_id, text in zip(*(c.to_pylist() for c in part.columns)):
                rows.append((row, doc_id, -1, -1, -1))  # every document is heard of
                base = base_spans(text or "")
                rows += [(row, doc_id, *s) for s in base + (weak_spans(text, base) if text else [])]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
                                         if rows else [pa.array([], f.type) for f in schema], schema=schema)


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All candidate parts: row, doc_id, kind (position in ``KINDS``; -1 stands for the document), start, end."""
    return (narrow(docs, doc_id=id_col, text=text_col)
            .select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
            .mapInArrow(_scan, "row long, doc_id long, kind int, start long, end long"))


def link(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """Keep base parts and the weak ones with a complementary part in scope; adds ``partner`` (kind, start, end; null
    without one) and ``linked``."""
    before = Window.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(1, Window.unboundedFollowing)
    kind = F.col("kind")

    def nearest(kinds: tuple[int, ...]):
        is_one = kind.isin(*kinds)
        last = F.max(F.when(is_one, F.struct("end", "start", "kind"))).over(before)
        first = F.min(F.when(is_one, F.struct("start", "end", "kind"))).over(after)
        # parts of different kinds may overlap: their gap is 0
        gaps = [F.when(p.isNotNull(), F.greatest(F.lit(0), gap)) for p, gap in (
            (last, F.col("start") - last["end"]), (first, first["start"] - F.col("end")))]
        choices = [F.when(gap <= window, F.struct(gap.alias("gap"), F.lit(i).alias("side"), p["kind"].alias("kind"),
                                                  p["start"].alias("start"), p["end"].alias("end")))
                   for i, (gap, p) in enumerate(zip(gaps, (last, first)))]
        return F.array_min(F.array_compact(F.array(*choices)))
    partner = (F.when(kind.isin(*_SECRETS), nearest(_IDENTIFIERS + _ENDPOINTS))
               .when(kind.isin(*_IDENTIFIERS, *_ENDPOINTS), nearest(_SECRETS)))
    found = found.withColumn("_p", partner).withColumn("linked", F.col("_p").isNotNull())
    kept = found.where((kind < N_BASE) | F.col("linked"))
    return kept.withColumn("partner", F.when(F.col("linked"), F.struct("_p.kind", "_p.start", "_p.end"))).drop("_p")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, spans (array of kind, start, end, linked, partner = kind, start, end; in order)."""
    # staged: the row numbers must not change between the two uses
    found = staged(parts(docs, id_col, text_col), "secret_parts")
    kept = link(found, window)
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.sort_array(F.collect_list(F.when(F.col("kind") >= 0, F.struct("start", "kind", "end", "linked", "partner"))))
    return (kept.groupBy("row", "doc_id").agg(spans.alias("s"))
            .select("doc_id", F.transform("s", lambda x: F.struct(
                F.get(names, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                x["linked"].alias("linked"), F.when(x["linked"], F.struct(
                    F.get(names, x["partner"]["kind"]).alias("kind"), x["partner"]["start"].alias("start"),
                    x["partner"]["end"].alias("end"))).alias("partner"))).alias("spans")))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans, the text of all spans, and the links (part>partner)."""
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS[:N_BASE]))
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    text = lambda a: F.array_join(F.transform(a, one), ",")
    links = F.transform(F.filter("spans", lambda x: x["linked"]), lambda x: F.concat_ws(">", one(x), one(x["partner"])))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:N_BASE]],
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["linked"])).cast("long").alias("n_linked"), F.array_join(links, ",").alias("links"))
