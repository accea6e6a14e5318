"""Conversation structure repair by a suffix-shared word graph (DAWG).

Every row of a conversation has a role and at most one fault (blank, duplicate,
truncated); in turn order they spell the conversation's *signature*, a character
a row. The cheapest edits that make the roles fit ``(s?(ua)+)?`` depend on the
signature alone:

1. *Signatures.* Identical rows collapse before the shuffle; a row is a duplicate
   when its role and text occur at an earlier turn. Rows are dealt by ranges of
   (conversation, turn, role, text hash), so a conversation with a third of all rows is cut
   into fragments that are put together as strings.
2. *Word graph.* Signatures are sorted from their ends, so conversations with a
   common suffix lie side by side and walk the same nodes: a node is a suffix,
   kept on a stack while it is shared. Each node holds the cost-to-go and the first edit of the
   best audit for the four states of the grammar; nodes whose costs differ by a
   constant are one class, and what a symbol does to a class is worked out once.
3. *Edits.* Audits meet the rows of their conversation in a sorted union (no
   audit is copied to every row) and are applied while the rows stream by.

The ASCII-least of the cheapest audits is greedy: in a state the edits that
may come next (D, I, K, R) have different letters, so the least letter on a cheapest way wins.

Memory: a task holds one signature or audit (a byte a row of a conversation, as the
result itself does), never a conversation's rows. A SHA-256 is a chain, so the texts of
one conversation stream through one task when they are hashed.

Defined cases: null role or text is one space (a blank text; a role that no
place of the grammar takes); null turns come first and are no turn for ``gaps``; a null
conv_id is a conversation of its own; equal turns are ordered by role, then by the SHA-256 of the
text; repeated rows are duplicates; conversations without rows have an empty audit; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import narrow, staged

ROLES = "sua"  # any other initial is the fourth kind
FAULTS = ("none", "blank", "duplicate", "truncated")
SYMBOLS = "ABCDEFGHIJKLMNOP"  # fault * 4 + role
SHORT = "suaoddddddddSUAO"  # what matters for edits: the role, or that the row must go; capitals are truncated
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
_WHITE = "\\u0020\\u0009\\u000A\\u000B\\u000C\\u000D"

#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_TURN = (("u", 2), ("u", 2), ("a", 3), ("u", 2))  # the role that an insertion or a rerole gives in a state
_NAMES = {"u": "user", "a": "assistant"}


class WordGraph:
    """Cost-to-go classes of suffixes: ``step(cls, symbol)`` is the class of the
    longer suffix, what its costs grow by, and the first edit in each state."""

    def __init__(self):
        self.costs: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self.steps: dict[tuple[int, str], tuple[int, int, str]] = {}
        # the empty suffix: u and a are inserted until the grammar may end
        self.end, base, self.end_edits = self._node([(0, ""), None, None, (0, "")])
        assert base == 0

    def _node(self, best: list) -> tuple[int, int, str]:
        """Add insertions (which stay at the node) to the best (cost, edit) of each state."""
        for _ in range(3):
            for q, (_, to) in enumerate(_TURN):
                if best[to] is not None:
                    found = (best[to][0] + INSERT, "I")
                    best[q] = found if best[q] is None else min(best[q], found)
        base = min(c for c, _ in best)
        costs = tuple(c - base for c, _ in best)
        cls = self.known.setdefault(costs, len(self.costs))
        if cls == len(self.costs):
            self.costs.append(costs)
        return cls, base, "".join(e or "." for _, e in best)

    def step(self, cls: int, symbol: str) -> tuple[int, int, str]:
        found = self.steps.get((cls, symbol))
        if found is None:
            after = self.costs[cls]
            extra = TRUNCATED if symbol.isupper() else 0
            best: list = []
            for q in range(4):
                ways = [(after[q] + DELETE, "D")]
                if symbol != "d":
                    if (to := _NEXT[q].get(symbol.lower())) is not None:
                        ways.append((after[to] + extra, "K"))
                    ways.append((after[_TURN[q][1]] + REROLE + extra, "R"))
                best.append(min(ways))
            found = self.steps[cls, symbol] = self._node(best)
        return found


def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def cheapest(words: Iterator[str]) -> Iterator[tuple[int, str]]:
    """(cost, audit) of each short signature, given from its end; neighbours share what they have in common."""
    graph = WordGraph()
    classes, totals, edits = [graph.end], [0], [graph.end_edits]
    before, found = "", None
    for word in words:
        if found is None or word != before:
            keep = _common_prefix(before, word)
            del classes[keep + 1:], totals[keep + 1:], edits[keep + 1:]
            for symbol in word[keep:]:
                cls, more, first = graph.step(classes[-1], symbol)
                classes.append(cls)
                totals.append(totals[-1] + more)
                edits.append(first)
            audit, q, at = [], 0, len(word)
            while (edit := edits[at][q]) != ".":
                audit.append(edit)
                if edit == "K":
                    q = _NEXT[q][word[at - 1].lower()]
                elif edit != "D":
                    q = _TURN[q][1]
                at -= edit != "I"
            found, before = (totals[-1] + graph.costs[classes[-1]][0], "".join(audit)), word
        yield found


def _trimmed(text: str) -> Column:
    return F.expr(f"trim(TRAILING '{_WHITE}' FROM {text})")


def _rows(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = narrow(conversations, conv=conv, turn=turn, role=role, text=text)
    return rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"))


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def _facts(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, piece): each different row with its part of the signature."""
    trimmed = _trimmed("text")
    kind = F.when(trimmed == "", 1).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3)
    facts = staged(rows.select("conv", "turn", "role", _digest().alias("digest"), kind.alias("kind"))
                   .groupBy("conv", "turn", "role", "digest", "kind").agg(F.count(F.lit(1)).cast("int").alias("m")), "conv_facts")
    # a row with the same role and text at an earlier turn (nulls first) makes all of these duplicates
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = (facts.groupBy("conv", "role", "digest").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("turns"))
             .where("turns > 1").select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("g"), "first"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("g"))
    initial = F.expr(f"CASE left(role, 1) {' '.join(f'WHEN {c!r} THEN {i}' for i, c in enumerate(ROLES))} ELSE 3 END")

    def symbol(fault: Column) -> Column:
        return F.substring(F.lit(SYMBOLS), fault * 4 + initial + 1, F.lit(1))
    later = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(at)
    piece = (F.when(F.col("kind") == 1, F.expr("repeat('x', m)"))
             .when(later, F.expr("repeat('y', m)")).otherwise(F.expr("concat('z', repeat('y', m - 1))")))
    for mark, fault in (("x", F.lit(1)), ("y", F.lit(2)), ("z", F.col("kind"))):
        piece = F.replace(piece, F.lit(mark), symbol(fault))
    return facts.join(first, same, "left").select("conv", "turn", "role", "digest", piece.alias("piece"))


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows: (conv, part, seq, lo, hi, turns, piece) for each conversation of each batch."""
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        convs, turns, pieces = (batch.column(i).to_pylist() for i in range(3))
        out: dict[str, list] = {k: [] for k in ("conv", "part", "seq", "lo", "hi", "turns", "piece")}
        a = 0
        while a < len(convs):
            b = a
            while b < len(convs) and convs[b] == convs[a]:
                b += 1
            known = [t for t, p in zip(turns[a:b], pieces[a:b]) if t is not None and p]
            row = (convs[a], part, seq, known[0] if known else None, known[-1] if known else None, len(set(known)),
                   "".join(pieces[a:b]))
            for k, v in zip(out, row):
                out[k].append(v)
            seq += 1
            a = b
        kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), *[batch.schema.field(1).type] * 2, pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add (cost, audit) to rows sorted by their last column, the short signature from its end."""
    held: list = []

    def words() -> Iterator[str]:
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield from batch.column(batch.num_columns - 1).to_pylist()
    found, cost, audit = cheapest(words()), [], []
    for one in found:
        cost.append(one[0])
        audit.append(one[1])
        if len(cost) == held[0].num_rows:
            batch = held.pop(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(cost, pa.int64()), pa.array(audit, pa.string())],
                                             names=[*batch.schema.names[:-1], "cost", "audit"])
            cost, audit = [], []


_STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _audits(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of ``ids``."""
    kind, turn = (rows.schema[c].dataType.simpleString() for c in ("conv", "turn"))
    order = ["conv", "turn", "role", "digest"]
    alone = ids.distinct().select("conv", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role")],
                                  F.lit(None).cast("binary").alias("digest"), F.lit("").alias("piece"))
    sorted_rows = _facts(rows).unionByName(alone).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = sorted_rows.select("conv", "turn", "piece").mapInArrow(
        _fragments, f"conv {kind}, part int, seq long, lo {turn}, hi {turn}, turns long, piece string")
    whole = parts.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "lo", "hi", "turns", "piece"))).alias("f"),
                                      F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # a turn that ends one fragment and begins the next was counted twice
    turns = F.expr(f"""aggregate(f, struct(0L AS n, CAST(null AS {turn}) AS last), (acc, x) -> struct(
        acc.n + x.turns - CASE WHEN x.lo = acc.last THEN 1L ELSE 0L END AS n, coalesce(x.hi, acc.last) AS last)).n""")
    spelt = whole.select("conv", F.coalesce(F.col("hi") - F.col("lo") + 1 - turns, F.lit(0)).cast("long").alias("gaps"),
                         F.expr("array_join(transform(f, x -> x.piece), '')").alias("s"))

    def count(fault: int) -> Column:
        mine = SYMBOLS[fault * 4: fault * 4 + 4]
        return (F.length("s") - F.length(F.translate("s", mine, ""))).cast("long").alias(FAULTS[fault])
    roles = F.translate("s", SYMBOLS, (ROLES + "o") * 4)
    legal = sum((F.length(roles) - F.length(F.replace(roles, F.lit(p), F.lit("")))) / 2 for p in ("su", "ua", "au"))
    illegal = F.greatest(F.length("s") - 1, F.lit(0)) - legal
    graph = spelt.select("conv", "gaps", count(1), count(2), count(3), illegal.cast("long").alias("illegal"),
                         F.reverse(F.translate("s", SYMBOLS, SHORT)).alias("word"))
    graph = graph.repartitionByRange("word", "conv").sortWithinPartitions("word", "conv")
    return graph.mapInArrow(_audited, f"conv {kind}, {', '.join(f'{c} long' for c in _STATS)}, audit string")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted union of audits and rows: each conversation's audit row (at = 0), then its repaired rows."""
    audit, used, q, at, head = "", 0, 0, 0, None
    schema = None
    for batch in batches:
        schema = schema or pa.schema([batch.schema.field("conv"), ("at", pa.int64()), ("edit", pa.string()), ("role", pa.string()),
                                      ("text", pa.string()), *[(c, pa.int64()) for c in _STATS], ("audit", pa.string())])
        out: list[tuple] = []

        def inserted():
            nonlocal used, q, at
            while used < len(audit) and audit[used] == "I":
                used, at = used + 1, at + 1
                out.append((head[0], at, "I", _NAMES[_TURN[q][0]], "", *[None] * 7))
                q = _TURN[q][1]
        rows = zip(*(batch.column(c).to_pylist() for c in ("conv", "is_row", "role", "text", *_STATS, "audit")))
        for conv, is_row, role, text, *stats, edits in rows:
            if not is_row:
                audit, used, q, at, head = edits, 0, 0, 0, (conv, *stats, edits)
                out.append((conv, 0, None, None, None, *stats, edits))
                # insertions after the last row are known already: they come when the audit holds nothing else
                if not audit.strip("I"):
                    inserted()
                continue
            inserted()
            edit, used = audit[used], used + 1
            if edit == "K":
                q = _NEXT[q][role[:1]]
            elif edit == "R":
                role, q = _NAMES[_TURN[q][0]], _TURN[q][1]
            if edit != "D":
                at += 1
                out.append((conv, at, edit, role, text, *[None] * 7))
            if not audit[used:].strip("I"):
                inserted()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def _stream(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Audits (at = 0) and repaired rows, each conversation in order and in one partition."""
    kind = rows.schema["conv"].dataType.simpleString()
    stats = [*_STATS, "audit"]
    own = rows.select("conv", F.lit(1).alias("is_row"), "turn", "role", _digest().alias("digest"), "text",
                      *[F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in stats])
    heads = audits.select("conv", F.lit(0).alias("is_row"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
                          *[F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("digest", "binary"), ("text", "string"))],
                          *stats)
    order = ["conv", "is_row", "turn", "role", "digest"]
    both = own.unionByName(heads).repartition("conv").sortWithinPartitions(*order)
    return both.select("conv", "is_row", "role", "text", *stats).mapInArrow(
        _edited, f"conv {kind}, at long, edit string, role string, text string, {', '.join(f'{c} long' for c in _STATS)}, audit string")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    head, sha, rows = None, None, 0
    schema = None

    def done(heads: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*heads), schema.types)], schema=schema)
    for batch in batches:
        schema = schema or pa.schema([batch.schema.field("conv"), *[(c, pa.int64()) for c in _STATS], ("audit", pa.string()),
                                      ("repaired_sha256", pa.string())])
        out = []
        for conv, at, role, text, *stats in zip(*(batch.column(c).to_pylist() for c in (
                "conv", "at", "role", "text", *_STATS, "audit"))):
            if at == 0:
                if head:
                    out.append((*head, sha.hexdigest()))
                head, sha = (conv, *stats), hashlib.sha256()
            else:
                sha.update(f"{chr(10) if at > 1 else ''}{role}:{text}".encode())
        if out:
            yield done(out)
    if head:
        yield done([(*head, sha.hexdigest())])


def audits(conversations: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn",
           role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: ``conv``, what is wrong with it, and the cheapest edits (``cost``, ``audit``).

    ``ids``: a table whose first column names conversations that may have no rows left.
    """
    rows = _rows(conversations, conv, turn, role, text)
    every = rows.select("conv") if ids is None else ids.select(F.col(f"`{ids.columns[0]}`").alias("conv"))
    return _audits(rows, every)


def repair(conversations: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn",
           role: str = "role", text: str = "text") -> DataFrame:
    """The repaired rows: (conv, at, edit, role, text), ``at`` from 1 in each conversation; ``edit`` is K, R or I."""
    rows = _rows(conversations, conv, turn, role, text)
    done = _stream(rows, audits(conversations, ids, conv, turn, role, text))
    return done.where("at > 0").select("conv", "at", "edit", "role", "text")


def digest(conversations: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn",
           role: str = "role", text: str = "text") -> DataFrame:
    """:func:`audits` with the SHA-256 of each repaired conversation (``role:text``, newline-joined)."""
    rows = _rows(conversations, conv, turn, role, text)
    kind = rows.schema["conv"].dataType.simpleString()
    return _stream(rows, audits(conversations, ids, conv, turn, role, text)).mapInArrow(
        _hashed, f"conv {kind}, {', '.join(f'{c} long' for c in _STATS)}, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            one_in: Callable[[Column], Column] = lambda key: F.crc32(key) % 20) -> DataFrame:
    """The rows with damage by the CRC-32 of ``conv:turn``: dropped, emptied, end marks removed, repeated, role user."""
    rows = narrow(conversations, conv_id=conv, turn=turn, role=role, text=text)
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    hit = one_in(key)
    role_, text_ = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return (rows.withColumn("hit", hit).where("hit <> 0").select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(role_).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate(text_, ".!?", "")).otherwise(text_).alias("text"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
        .drop("copy"))


_CRC = """
bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
"""


def _option(q: int) -> str:
    """SQL: the best (cost, audit) when row ``r`` is read in state q, before insertions."""
    to = _TURN[q][1]
    ways = [f"{{'c': s.c{q} + {DELETE}, 'a': 'D' || s.a{q}}}",
            f"CASE WHEN NOT r.gone THEN {{'c': s.c{to} + {REROLE} + r.extra, 'a': 'R' || s.a{to}}} END"]
    for c, after in _NEXT[q].items():
        ways.append(f"CASE WHEN NOT r.gone AND r.i = '{c}' THEN {{'c': s.c{after} + r.extra, 'a': 'K' || s.a{after}}} END")
    return f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"


def _inserted(q: int, of: str) -> str:
    to = _TURN[q][1]
    return f"least({of}{q}, {{'c': {of}{to}.c + {INSERT}, 'a': 'I' || {of}{to}.a}})"


ORACLE = f"""
WITH RECURSIVE {_CRC.strip()}
k AS (SELECT *, encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS key FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(key) + 1),
    lambda i: ('0x' || substr(hex(key), (2 * i - 1)::INT, 2))::BIGINT)),
    lambda crc, b: xor(crc >> 8, t[(xor(crc, b) & 255) + 1])), 4294967295) % 20 AS hit FROM k, tab),
x AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
    unnest(CASE hit WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE hit <> 0),
o AS (SELECT *, row_number() OVER w AS pos, row_number() OVER (PARTITION BY conv_id, role, text
    ORDER BY turn NULLS FIRST, copy) AS seen, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e,
    left(role, 1) AS i, lag(left(role, 1)) OVER w AS before
  FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
r AS (SELECT *, CASE WHEN e = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(e, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault,
    fault IN (1, 2) AS gone, CASE WHEN fault = 3 THEN {TRUNCATED} ELSE 0 END AS extra FROM o),
g AS (SELECT conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (pos > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
s(conv_id, pos, c0, a0, c1, a1, c2, a2, c3, a3) AS (
  SELECT conv_id, n + 1, 0::BIGINT, '', 6::BIGINT, 'II', 3::BIGINT, 'I', 0::BIGINT, '' FROM g
  UNION ALL
  SELECT conv_id, pos, w0.c, w0.a, w1.c, w1.a, w2.c, w2.a, w3.c, w3.a FROM (
    SELECT conv_id, pos, {', '.join(_inserted(q, 'v') + f' AS w{q}' for q in range(4))} FROM (
      SELECT conv_id, pos, {', '.join(_inserted(q, 'u') + f' AS v{q}' for q in range(4))} FROM (
        SELECT r.conv_id, r.pos, {', '.join(_option(q) + f' AS u{q}' for q in range(4))}
        FROM s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.pos = s.pos - 1)))),
b AS (SELECT conv_id, c0 AS cost, a0 AS audit FROM s WHERE pos = 1),
p(conv_id, audit, k, pos, q, line) AS (
  SELECT conv_id, audit, 0, 1::BIGINT, 0, NULL::VARCHAR FROM b
  UNION ALL
  SELECT p.conv_id, audit, k + 1, CASE audit[k + 1] WHEN 'I' THEN p.pos ELSE p.pos + 1 END,
    CASE audit[k + 1] WHEN 'D' THEN q WHEN 'K' THEN CASE r.i WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END
      ELSE CASE q WHEN 2 THEN 3 ELSE 2 END END,
    CASE audit[k + 1] WHEN 'D' THEN NULL WHEN 'K' THEN r.role || ':' || r.text
      ELSE CASE q WHEN 2 THEN 'assistant:' ELSE 'user:' END || CASE audit[k + 1] WHEN 'R' THEN r.text ELSE '' END END
  FROM p LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.pos = p.pos WHERE k < length(audit)),
f AS (SELECT conv_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY k), '')) AS sha FROM p GROUP BY conv_id)
SELECT c.conv_id, coalesce(g.gaps, 0)::BIGINT AS gaps, coalesce(g.blank, 0)::BIGINT AS blank,
  coalesce(g.duplicate, 0)::BIGINT AS duplicate, coalesce(g.truncated, 0)::BIGINT AS truncated,
  coalesce(g.illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit,
  coalesce(f.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
"""
