"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of
trusted text, per-document perplexity, language-specific quantiles as limits.

n-grams are of real characters (code points, nothing folded; each text stands
between spaces). The counts of *all* trusted texts, the continuation counts of each lower
order, and the interpolated probabilities are tables in shards by (language, n-gram),
however many there are; every language with trusted text has a model and limits of its
own. Other languages, and null, take the model of all languages together.

Perplexity comes from joins: documents are packed into blocks (a row is a compressed
part of one), a block asks for each distinct n-gram of its texts once, the
questions meet the probabilities shard by shard (unseen n-grams back off order by order,
down to one in ``CHARACTERS``), and the answers return to their block. Blocks are
bucketed, so no text is shuffled. Answers, six numbers for each question, are the largest thing
to be shuffled: blocks are dealt to ``WAVES`` waves, and get them wave by wave, so that no more
than one wave of answers is on disk. Staged tables go once nothing reads them.

Cross-fitting: documents are dealt to ``HOLD_OUT`` folds by a hash of their id, and each
probability is kept ``HOLD_OUT`` + 1 times, of all trusted text and of all but one fold.
A trusted document is scored without its own fold, any other one with all of it; so
every trusted text is counted, and every one sets the limits.

A document is rejected if its perplexity lies above the ``perplexity_quantile`` of
its language, or if it has too many odd words for its length. A word is a run of
letters, its score the mean surprise of its symbols; it is odd above the ``ODD_WORD``
quantile of all words (repeats count) of trusted documents of its language. With n
words and k odd ones the document's score is (k - r n) / sqrt(r n + f (r n)**2), where
r is the rate of odd words in the language and f how much more their number varies
between documents than chance makes it (both from trusted documents of all lengths): the
excess in units of its own spread, whose size does not grow with n. Its limit is
the ``word_quantile``; a single odd word, such as one name, does not count. With few
trusted documents in a language its quantiles are lax, as the largest value is one of them.

Trusted: every label of the document has quality 1 and toxic 0 (or null).

Defined cases: null, empty and blank texts have no perplexity and are rejected;
a null language is scored by the pooled model; without any trusted document
nothing but blank texts is rejected; rows with a null id are scored but not
trusted; rows that repeat an id are scored and trusted each; labels that repeat
an id must all trust it; labels of unknown ids are ignored; an empty table gives
no rows; all columns of the input pass through, whatever their names.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.llm.common import discard, narrow, new_path, release, small_batches, staged
from adlens.llm.shingle import text_chunks

ORDER, HOLD_OUT = 4, 5
CHARACTERS = 0x110000 - 0x800  # code points without surrogates
PERPLEXITY_QUANTILE, WORD_QUANTILE = 0.98, 0.98
ODD_WORD, BINS = 0.998, 128  # quantile of words; steps in which a bit of surprise is counted
ACCURACY = 10_000
LEAST_DISCOUNT = 0.05  # estimates can reach 0 on little text, which would leave unseen n-grams impossible
LEAST_WORD = 4  # letters of a word that is scored
POOLED = "*"
MODELS = HOLD_OUT + 1  # of all trusted text, and without each fold
BLOCK, PART, PIECE = 24 << 20, "4m", 1 << 20  # bytes of documents in a block, in a row of it, looked at at once
TABLE = 1 << 23  # entries up to which codes are ranked by a table
WAVES = 3  # in which blocks get their answers
LEVEL = 3  # of zstd, for blocks
COMBINED = 1 << 19  # n-grams that a task holds before it hands them on
_BLANK = np.array([32, 9, 10, 13, 11, 12])


def symbols_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of a run of UTF-8 texts; each text stands between spaces."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
    code = lead & np.array([0, 0x7F, 0x1F, 0x0F, 0x07], np.uint32)[size]
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        code[more] = (code[more] << 6) | (data[np.minimum(at[more] + k, len(data) - 1)] & 0x3F)
    code[(code > 0x10FFFF) | ((code >= 0xD800) & (code < 0xE000))] = 0xFFFD  # not valid UTF-8
    before = np.searchsorted(at, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(before))
    out = np.full(len(code) + ORDER * (len(off) - 1), 32, np.uint32)
    # ORDER - 1 spaces in front of a text and one behind it
    out[np.arange(len(code)) + ORDER * row + ORDER - 1] = code
    return out, before + ORDER * np.arange(len(off))


def _ranked(code: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Numbers from 0 on of the distinct codes below ``size``, in their order, and how many there are."""
    if size > TABLE:
        found, rank = np.unique(code, return_inverse=True)
        return rank, len(found)
    seen = np.zeros(size, bool)
    seen[code] = True
    rank = np.cumsum(seen) - 1
    return rank[code], int(rank[-1]) + 1 if size else 0


def grams_of(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the n-gram that begins at each symbol, a place where each number occurs)."""
    n = max(0, len(symbols) - ORDER + 1)
    own, width = _ranked(symbols, int(symbols.max()) + 1 if len(symbols) else 0)
    code, found = own[:n], width
    for k in range(1, ORDER):
        code, found = _ranked(code * width + own[k: k + n], found * width)
    place = np.zeros(found, np.int64)
    place[code] = np.arange(n)
    return code, place


def strings_of(symbols: np.ndarray, place: np.ndarray) -> list[str]:
    """The n-grams that begin at these places."""
    text = symbols[place[:, None] + np.arange(ORDER)].astype("<u4").tobytes().decode("utf-32-le")
    return [text[i: i + ORDER] for i in range(0, len(text), ORDER)]


class Layout(NamedTuple):
    """Which columns of the documents are what."""

    id: int
    text: int
    lang: int


class Corpus(NamedTuple):
    """Documents packed into blocks: (block, first, ids, payload, wave), a row a part, partitioned by wave and bucketed by block."""

    blocks: DataFrame
    schema: T.StructType
    layout: Layout
    buckets: int


def _wave() -> Column:
    """The wave of a block."""
    return (F.col("block") % WAVES).cast("int")


def _bucketed(df: DataFrame, buckets: int, name: str) -> DataFrame:
    """Write ``df`` into the shared folder, a folder a wave, in buckets by block, and read it back."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    df.withColumn("wave", _wave()).write.format("parquet").partitionBy("wave").bucketBy(buckets, "block").sortBy("block").option(
        "path", new_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Corpus:
    """The documents, all columns, in compressed blocks."""
    spark = docs.sparkSession
    narrow(docs, id=id_col, text=text_col, lang=lang_col)
    layout = Layout(*(docs.columns.index(c) for c in (id_col, text_col, lang_col)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, first = 0, BLOCK, 0
        wave = TaskContext.get().partitionId()  # the tasks begin with different waves, and each deals its blocks in turn
        codec = pa.Codec("zstd", compression_level=LEVEL)
        for batch in batches:
            if not batch.num_rows:
                continue
            if size + batch.nbytes > BLOCK:
                block = (uuid.uuid4().int >> 66) // WAVES * WAVES + wave % WAVES
                size, first, wave = 0, 0, wave + 1
            sink, ids = pa.BufferOutputStream(), batch.column(layout.id)
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as w:
                w.write_batch(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([first], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "first", "ids", "payload"])
            size, first = size + batch.nbytes, first + batch.num_rows

    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    with small_batches(spark, PART):
        blocks = _bucketed(plain.mapInArrow(pack, T.StructType([
            T.StructField("block", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("ids", T.ArrayType(docs.schema[layout.id].dataType)),
            T.StructField("payload", T.BinaryType())])), buckets, "kn_blocks")
    return Corpus(blocks, docs.schema, layout, buckets)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents that every label trusts."""
    labels = narrow(labels, doc_id="doc_id", quality="quality", toxic="toxic")
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where(
        "q = 1 AND t = 0").select("doc_id")


def folds_of(corpus: Corpus, labels: DataFrame) -> DataFrame:
    """(block, folds): the trusted documents of a block, as place * HOLD_OUT + fold."""
    rows = corpus.blocks.select("block", "first", F.posexplode("ids").alias("at", "doc_id")).where("doc_id IS NOT NULL")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(HOLD_OUT))
    return staged(rows.join(trusted_ids(labels).hint("merge"), "doc_id", "left_semi").groupBy("block").agg(
        F.collect_list((F.col("first") + F.col("at")) * HOLD_OUT + fold).alias("folds")), "kn_folds")


class Piece(NamedTuple):
    """A run of texts of a block."""

    first: int
    symbols: np.ndarray
    at: np.ndarray  # where each text's n-grams begin
    grams: np.ndarray
    place: np.ndarray

    def part(self, d: int) -> tuple[int, int]:
        return int(self.at[d]), int(self.at[d + 1]) - ORDER + 1


def unpacked(payload: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(payload) as reader:
        return reader.read_next_batch()


def _pieces(texts: pa.Array) -> Iterator[Piece]:
    for first, data, off in text_chunks(texts, PIECE):
        symbols, at = symbols_of(data, off)
        yield Piece(first, symbols, at, *grams_of(symbols))


def _used(piece: Piece, group: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, numbers of its n-grams, counts) of the texts of a piece with a group (from 0 on) and anything in them."""
    full = np.diff(piece.at) > ORDER
    own = np.where(full, group, -1)
    key = np.full(len(piece.grams), -1, np.int64)
    for d in np.flatnonzero(own >= 0):
        a, b = piece.part(d)
        key[a:b] = own[d]
    n = len(piece.place)
    code = (key * n + piece.grams)[key >= 0]
    if groups * n <= TABLE:
        count = np.bincount(code, minlength=groups * n)
        found = np.flatnonzero(count)
        count = count[found]
    else:
        found, count = np.unique(code, return_counts=True)
    edge = np.searchsorted(found, n * np.arange(groups + 1))
    for g in range(groups):
        a, b = edge[g], edge[g + 1]
        if b > a:
            yield g, found[a:b] - g * n, count[a:b]


def _langs(batch: pa.RecordBatch, layout: Layout) -> list[str]:
    return [POOLED if x is None else x for x in batch.column(layout.lang).to_pylist()]


def _fold_list(folds: list[int] | None, first: int, rows: int) -> np.ndarray:
    """The fold of each document of a part of a block, -1 if it is not trusted."""
    out = np.full(rows, -1, np.int64)
    both = np.array(folds or [], np.int64) - first * HOLD_OUT
    both = both[(both >= 0) & (both < rows * HOLD_OUT)]
    out[both // HOLD_OUT] = both % HOLD_OUT
    return out


def _table(parts: list[tuple]) -> pa.Table:
    return pa.concat_tables([pa.table({
        "lang": pa.array([lang] * len(g), pa.string()), "fold": pa.array(np.full(len(g), fold, np.int32)),
        "g": pa.array(g, pa.string()), "c": pa.array(c.astype(np.int64))}) for lang, fold, g, c in parts]).group_by(
        ["lang", "fold", "g"]).aggregate([("c", "sum")]).rename_columns(["lang", "fold", "g", "c"])


def _grams(batch: pa.RecordBatch, layout: Layout, fold: np.ndarray | None) -> Iterator[tuple]:
    """(lang, fold, n-grams, counts) of the trusted texts of a block, or without folds of all."""
    langs = _langs(batch, layout)
    names = {x: i for i, x in enumerate(dict.fromkeys(langs))}
    lang = np.array([names[x] for x in langs])
    group = lang if fold is None else np.where(fold >= 0, lang * HOLD_OUT + fold, -1)
    back, step = list(names), 1 if fold is None else HOLD_OUT
    for piece in _pieces(batch.column(layout.text)):
        found = list(_used(piece, group[piece.first: piece.first + len(piece.at) - 1], len(back) * step))
        needed = np.unique(np.concatenate([g for _, g, _ in found])) if found else []
        text = np.empty(len(piece.place), object)
        if len(needed):
            text[needed] = strings_of(piece.symbols, piece.place[needed])
        for i, g, c in found:
            yield back[i // step], i % step, text[g], c


def _count(layout: Layout):
    """(lang, fold, g, c): the n-grams of the trusted texts of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        for batch in batches:
            for payload, first, folds in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                docs = unpacked(payload.as_buffer())
                parts = list(_grams(docs, layout, _fold_list(folds, first, docs.num_rows)))
                if parts:
                    kept.append(_table(parts))
                if len(kept) > 1:
                    kept = [pa.concat_tables(kept).group_by(["lang", "fold", "g"]).aggregate([("c", "sum")]).rename_columns(
                        ["lang", "fold", "g", "c"])]
                if kept and kept[0].num_rows > COMBINED:
                    yield from kept.pop().to_batches(max_chunksize=50_000)
        for table in kept:
            yield from table.combine_chunks().to_batches(max_chunksize=50_000)
    return run


def _wanted(layout: Layout):
    """(block, lang, g): the n-grams of a block, once each where its parts follow one another."""
    def asked(block: int, kept: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(kept).group_by(["lang", "g"]).aggregate([]).sort_by([("lang", "ascending"), ("g", "ascending")])
        table = table.append_column("block", pa.array(np.full(table.num_rows, block, np.int64))).select(["block", "lang", "g"])
        yield from table.combine_chunks().to_batches(max_chunksize=50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, []
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                if kept and block != last:
                    yield from asked(last, kept)
                    kept = []
                last, parts = block, list(_grams(unpacked(payload.as_buffer()), layout, None))
                if parts:
                    kept = [pa.concat_tables([*kept, _table(parts).select(["lang", "g"])]).group_by(["lang", "g"]).aggregate([])]
        if kept:
            yield from asked(last, kept)
    return run


def kneser_ney(counts: DataFrame) -> list[DataFrame]:
    """A table for each order from 1 on: (lang, g, ctx, p, gamma) of the n-grams that occur, interpolated probabilities
    and back-off weights of their contexts in each model (``counts``: lang, g, and c0 to c5, a count in each model)."""
    c = [f"c{m}" for m in range(MODELS)]
    orders = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # how many different symbols an n-gram continues
        orders[k] = staged(orders[k + 1].select("lang", F.expr("substring(g, 2)").alias("g"), *c).groupBy("lang", "g").agg(
            *[F.count_if(F.col(x) > 0).alias(x) for x in c]), "kn_order")
    found: list[DataFrame] = []
    for k in range(1, ORDER + 1):
        t = orders[k]
        discounts = F.broadcast(t.groupBy("lang").agg(*[  # a row a language
            F.count_if(F.col(x) == i).cast("double").alias(f"{x}n{i}") for x in c for i in range(1, 5)]).select("lang", *[
                _discount(x, i).alias(f"{x}d{i}") for x in c for i in (1, 2, 3)]))
        t = t.join(discounts, "lang").select("lang", "g", F.expr(f"substring(g, 1, {k - 1})").alias("ctx"), *c, *[
            F.when(F.col(x) == 0, 0.0).when(F.col(x) == 1, F.col(f"{x}d1")).when(F.col(x) == 2, F.col(f"{x}d2")).otherwise(
                F.col(f"{x}d3")).alias(f"{x}d") for x in c])
        contexts = t.groupBy("lang", "ctx").agg(*[F.sum(x).alias(f"{x}t") for x in c], *[F.sum(f"{x}d").alias(f"{x}s") for x in c])
        ctx = Window.partitionBy("lang", "ctx") if k > 1 else None
        if ctx is None:  # one context a language
            t = t.join(F.broadcast(contexts), ["lang", "ctx"])
        else:
            t = t.select("*", *[F.sum(x).over(ctx).alias(f"{x}t") for x in c], *[F.sum(f"{x}d").over(ctx).alias(f"{x}s") for x in c])
            t = t.withColumn("low", F.expr("substring(g, 2)")).join(
                found[-1].select("lang", F.col("g").alias("low"), F.col("p").alias("lp")).hint("merge"), ["lang", "low"])
        low: list[Column] = [F.lit(1.0 / CHARACTERS) if k == 1 else F.col("lp")[m] for m in range(MODELS)]
        weight = [F.when(F.col(f"{x}t") > 0, F.col(f"{x}s") / F.col(f"{x}t")).otherwise(F.lit(1.0)) for x in c]
        p = [F.when(F.col(f"{x}t") > 0, (F.col(x) - F.col(f"{x}d")) / F.col(f"{x}t")).otherwise(F.lit(0.0)) + weight[m] * low[m]
             for m, x in enumerate(c)]
        found.append(staged(t.select("lang", "g", "ctx", F.array(*p).alias("p"), F.array(*weight).alias("gamma")), "kn_probability"))
    discard(*[orders[k] for k in range(1, ORDER)])
    return found


def _discount(x: str, i: int) -> Column:
    n = [F.col(f"{x}n{j}") for j in range(1, 5)]
    y = n[0] / F.greatest(n[0] + 2 * n[1], F.lit(1.0))
    return F.greatest(F.lit(LEAST_DISCOUNT), F.least(F.lit(float(i)), F.lit(float(i)) - (i + 1) * y * F.when(
        n[i - 1] > 0, n[i] / n[i - 1]).otherwise(F.lit(0.0))))


class Model(NamedTuple):
    """What trusted text makes: a table for each order, the languages with a model of their own, the trusted documents of each block."""

    orders: list[DataFrame]
    langs: DataFrame
    folds: DataFrame


def train(corpus: Corpus, labels: DataFrame) -> Model:
    """Count all trusted text and build the models, of all of it and without each fold."""
    spark = corpus.blocks.sparkSession
    folds = folds_of(corpus, labels)
    rows = corpus.blocks.select("block", "first", "payload").join(folds.hint("shuffle_hash"), "block").select("payload", "first", "folds")
    counts = rows.mapInArrow(_count(corpus.layout), "lang string, fold int, g string, c long")
    own = F.sum("c").alias("c0"), *[F.sum(F.when(F.col("fold") == f, F.col("c")).otherwise(F.lit(0))).alias(f"s{f}") for f in range(HOLD_OUT)]
    with small_batches(spark, PART):
        counts = staged(counts.groupBy("lang", "g").agg(*own).select(
            "lang", "g", "c0", *[(F.col("c0") - F.col(f"s{f}")).alias(f"c{f + 1}") for f in range(HOLD_OUT)]), "kn_counts")
    release(spark)
    pooled = counts.groupBy("g").agg(*[F.sum(f"c{m}").alias(f"c{m}") for m in range(MODELS)]).withColumn("lang", F.lit(POOLED))
    every = staged(counts.where(F.col("lang") != POOLED).unionByName(pooled), "kn_counts")
    langs = staged(counts.select("lang").distinct().where(F.col("lang") != POOLED), "kn_langs")
    discard(counts)
    orders = kneser_ney(every)
    discard(every)
    release(spark)
    return Model(orders, langs, folds)


def probabilities(wanted: DataFrame, model: Model, order: int = ORDER) -> DataFrame:
    """(lang, g, p) of distinct (lang, g), seen or not: what does not occur backs off to the n-gram without its first symbol."""
    uniform = F.array(*[F.lit(1.0 / CHARACTERS)] * MODELS)
    if order == 0:
        return wanted.withColumn("p", uniform)
    table = model.orders[order - 1]
    met = staged(wanted.join(table.select("lang", "g", "p"), ["lang", "g"], "left"), "kn_met")
    unseen = met.where("p IS NULL").select("lang", "g", F.expr("substring(g, 2)").alias("low"),
                                           F.expr(f"substring(g, 1, {order - 1})").alias("ctx"))
    lower = probabilities(unseen.select("lang", F.col("low").alias("g")).distinct(), model, order - 1)
    contexts = table.groupBy("lang", "ctx").agg(F.first("gamma").alias("gamma"))  # the same in all rows
    backed = unseen.join(contexts, ["lang", "ctx"], "left").join(
        lower.select("lang", F.col("g").alias("low"), F.col("p").alias("lp")), ["lang", "low"]).select(
        "lang", "g", F.array(*[F.coalesce(F.col("gamma")[m], F.lit(1.0)) * F.col("lp")[m] for m in range(MODELS)]).alias("p"))
    found = staged(met.where("p IS NOT NULL").unionByName(backed), "kn_backed")
    discard(met, lower)
    return found


def questions(corpus: Corpus) -> DataFrame:
    """(block, lang, g): the distinct n-grams of every block."""
    with small_batches(corpus.blocks.sparkSession, PART):
        return staged(corpus.blocks.select("block", "payload").mapInArrow(
            _wanted(corpus.layout), "block long, lang string, g string"), "kn_asked")


def by_model(asked: DataFrame, model: Model) -> DataFrame:
    """(block, lang, model, g): questions with the model of the text's language."""
    langs = F.broadcast(model.langs.select("lang", F.col("lang").alias("own")))  # a row a language
    return asked.join(langs, "lang", "left").select("block", "lang", F.coalesce("own", F.lit(POOLED)).alias("model"), "g")


def surprises(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(block, lang, g, b0 to b5): -log2 probabilities, in each model, of what blocks ask (``found``: see ``probabilities``)."""
    bits = [(-F.log2(F.col("p")[m])).cast("float").alias(f"b{m}") for m in range(MODELS)]
    answers = asked.join(found.select(F.col("lang").alias("model"), "g", *bits).hint("merge"), ["model", "g"])
    return answers.select("block", "lang", "g", *[f"b{m}" for m in range(MODELS)])


def _letters(symbols: np.ndarray) -> np.ndarray:
    """Which symbols are letters (or marks on them)."""
    found = np.zeros(int(symbols.max()) + 1 if len(symbols) else 0, bool)
    found[symbols] = True
    alphabet = np.flatnonzero(found)
    found[alphabet] = [unicodedata.category(chr(x))[0] in "LM" for x in alphabet.tolist()]
    return found[symbols]


def _scores(texts: pa.Array, langs: list[str], fold: np.ndarray, known: dict[str, dict[str, int]],
            bits: np.ndarray) -> Iterator[tuple[int, float | None, np.ndarray]]:
    """(symbols, perplexity, surprise of every word in steps, in order of size, which takes half the disk) of each text of a
    block, trusted texts without their own fold."""
    for piece in _pieces(texts):
        own = langs[piece.first: piece.first + len(piece.at) - 1]
        names = {x: i for i, x in enumerate(dict.fromkeys(own))}
        strings, where = np.empty(len(piece.place), object), {}
        found = {i: g for i, g, _ in _used(piece, np.array([names[x] for x in own], np.int64), len(names))}
        if found:
            needed = np.unique(np.concatenate(list(found.values())))
            strings[needed] = strings_of(piece.symbols, piece.place[needed])
        for lang, i in names.items():
            if i in found:
                row = np.zeros(len(piece.place), np.int64)
                row[found[i]] = [known[lang][g] for g in strings[found[i]]]
                where[lang] = row
        letters, blank = _letters(piece.symbols), np.isin(piece.symbols, _BLANK)
        for d, lang in enumerate(own):
            a, b = piece.part(d)
            start = a + ORDER - 1  # of the text itself; its last n-gram ends at the space behind it
            if blank[start: piece.at[d + 1] - 1].all():
                yield 0, None, np.zeros(0, np.int32)
                continue
            cost = bits[where[lang][piece.grams[a:b]], fold[piece.first + d] + 1].astype(np.float64)
            edge = np.flatnonzero(np.diff(letters[start: piece.at[d + 1]].astype(np.int8), prepend=0, append=0))
            begin, end = edge[::2], np.minimum(edge[1::2] + 1, len(cost))  # with the symbol behind the word
            long = end - begin > LEAST_WORD
            begin, end = begin[long], end[long]
            total = np.concatenate([[0.0], np.cumsum(cost)])
            words = np.ceil((total[end] - total[begin]) / (end - begin) * BINS).astype(np.int32)
            yield len(cost), float(2.0 ** cost.mean()), np.sort(words)


def scored(corpus: Corpus, model: Model, bits: DataFrame, wave: int) -> DataFrame:
    """(block, place, lang, trusted, n_symbols, perplexity, words) of every document of a wave (``bits``: see ``surprises``);
    ``words`` holds the surprise of each word in steps of 1 / BINS."""
    layout = corpus.layout

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known: dict[str, dict[str, int]] = {}
        for i, (lang, g) in enumerate(zip(right["lang"].to_pylist(), right["g"].to_pylist())):
            known.setdefault(lang, {})[g] = i
        table = np.stack([right[f"b{m}"].to_numpy() for m in range(MODELS)], axis=1)
        parts = [_EMPTY]
        for block, first, payload, folds in zip(left["block"].to_pylist(), left["first"].to_pylist(), left["payload"], left["folds"].to_pylist()):
            docs = unpacked(payload.as_buffer())
            fold, langs = _fold_list(folds, first, docs.num_rows), _langs(docs, layout)
            n, perplexity, words = zip(*_scores(docs.column(layout.text), langs, fold, known, table))
            ends = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int32)
            parts.append(pa.table([
                pa.array(np.full(len(n), block, np.int64)), pa.array(np.arange(first, first + len(n), dtype=np.int32)), pa.array(langs, pa.string()),
                pa.array(fold >= 0), pa.array(n, pa.int64()), pa.array(perplexity, pa.float64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(words)))], names=_EMPTY.schema.names))
        return pa.concat_tables(parts)

    blocks = corpus.blocks.where(F.col("wave") == wave).select("block", "first", "payload").join(
        model.folds.hint("shuffle_hash"), "block", "left")
    return blocks.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(
        run, "block long, place int, lang string, trusted boolean, n_symbols long, perplexity double, words array<int>")


def scored_in_waves(corpus: Corpus, model: Model) -> DataFrame:
    """What ``scored`` gives of all waves. The n-grams of all blocks are looked up at once, their answers shuffled wave by wave."""
    spark = corpus.blocks.sparkSession
    written = questions(corpus)
    asked = by_model(written, model)
    found = probabilities(asked.select(F.col("model").alias("lang"), "g").distinct(), model)
    discard(*model.orders)
    release(spark)
    facts = []
    for wave in sorted(r.wave for r in corpus.blocks.select("wave").distinct().collect()) or [0]:
        with small_batches(spark, PART):
            facts.append(staged(scored(corpus, model, surprises(asked.where(_wave() == wave), found), wave), "kn_scored"))
        release(spark)
    discard(written, found)
    return reduce(DataFrame.unionByName, facts)


_EMPTY = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("lang", pa.string()), ("trusted", pa.bool_()),
                    ("n_symbols", pa.int64()), ("perplexity", pa.float64()), ("words", pa.list_(pa.int32()))]).empty_table()


def restored(corpus: Corpus, facts: DataFrame, out: str) -> DataFrame:
    """The documents, all columns, with a struct ``out`` of what ``facts`` has of each (by block and place)."""
    names = [f"c{i}" for i in range(len(corpus.schema))]
    fields = [f for f in facts.schema if f.name not in ("block", "place")]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, corpus.schema)] + fields)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("place").drop_columns(["block", "place"])
        docs = pa.Table.from_batches([unpacked(x.as_buffer()) for x in left.sort_by("first")["payload"]])
        return pa.table([*docs.columns, *right.columns], names=schema.names)

    rows = corpus.blocks.select("block", "first", "payload").groupBy("block").cogroup(facts.groupBy("block")).applyInArrow(run, schema)
    return rows.select(*[F.col(n).alias(f.name) for n, f in zip(names, corpus.schema)], F.struct(
        *[F.col(f.name) for f in fields]).alias(out))


def excess(n: Column, k: Column, rate: Column, spread: Column) -> Column:
    """By how many standard deviations k odd words are more than n words have; one alone does not count."""
    return F.when(k > 1, (k - rate * n) / F.sqrt(rate * n + spread * (rate * n) * (rate * n))).otherwise(F.lit(0.0))


def limits_of(calibration: DataFrame, perplexity_quantile: float = PERPLEXITY_QUANTILE,
              word_quantile: float = WORD_QUANTILE) -> DataFrame:
    """(lang, odd, rate, spread, perplexity, words): what is judged in each language with trusted texts, and (``POOLED``)
    in all together, from documents as ``scored`` gives them: see the module's description."""
    groups = F.explode(F.array_distinct(F.array(F.col("own"), F.lit(POOLED)))).alias("lang")
    texts = calibration.where("trusted AND perplexity IS NOT NULL").select(F.col("lang").alias("own"), "perplexity", "words")
    bins = texts.select("own", F.explode("words").alias("bin")).groupBy("own", "bin").agg(F.count(F.lit(1)).alias("n"))
    odd = staged(bins.select(groups, "bin", "n").groupBy("lang").agg(
        F.percentile("bin", ODD_WORD, F.col("n")).alias("odd")), "kn_odd")
    rows = texts.select(groups, F.col("perplexity").alias("p"), F.col("words").alias("w")).join(F.broadcast(odd), "lang", "left")
    rows = staged(rows.select("lang", "p", "odd", F.size("w").cast("double").alias("n"), _odd_words("w", "odd").cast("double").alias("k")),
                  "kn_scored")
    n, k = F.col("n"), F.col("k")
    sums = rows.groupBy("lang").agg(F.first("odd").alias("odd"), F.sum(n).alias("sn"), F.sum(k).alias("sk"), F.sum(n * n).alias("nn"),
                                    F.sum(n * k).alias("nk"), F.sum(k * k).alias("kk"))
    rate = F.greatest(F.col("sk") / F.greatest(F.col("sn"), F.lit(1.0)), F.lit(1 - ODD_WORD)).alias("rate")
    r = F.col("rate")
    more = F.col("kk") - 2 * r * F.col("nk") + r * r * F.col("nn") - r * F.col("sn")
    sums = staged(sums.select("*", rate).select("lang", "odd", "rate", F.greatest(F.lit(0.0), more / F.greatest(
        r * r * F.col("nn"), F.lit(1e-9))).alias("spread")), "kn_rates")
    return staged(rows.select("lang", "p", "n", "k").join(F.broadcast(sums), "lang").groupBy("lang", "odd", "rate", "spread").agg(
        F.percentile_approx("p", perplexity_quantile, ACCURACY).alias("perplexity"),
        F.percentile_approx(excess(n, k, r, F.col("spread")), word_quantile, ACCURACY).alias("words")), "kn_limits")


def _odd_words(words: str, odd: str) -> Column:
    """How many words are odd; none where nothing tells odd ones."""
    return F.when(F.col(odd).isNull(), F.lit(0)).otherwise(F.size(F.filter(words, lambda x: x > F.col(odd))))


def judged(facts: DataFrame, limits: DataFrame) -> DataFrame:
    """(block, place, perplexity, odd_words, n_symbols, n_words, n_odd, perplexity_limit, word_limit, keep) of documents
    as ``scored`` gives them; a language without limits of its own has the pooled ones."""
    names = ["odd", "rate", "spread", "perplexity", "words"]
    own = F.broadcast(limits.select("lang", F.struct(*names).alias("own")))  # a row a language
    pooled = F.broadcast(limits.where(F.col("lang") == POOLED).select(F.struct(*names).alias("pooled")))
    rows = facts.join(own, "lang", "left").join(pooled, F.lit(True), "left").withColumn("at", F.coalesce("own", "pooled"))
    rows = rows.select("block", "place", "perplexity", "n_symbols", F.size("words").cast("long").alias("n_words"), F.col(
        "at.odd").alias("odd"), "words", "at").withColumn("n_odd", _odd_words("words", "odd").cast("long"))
    odd = F.when(F.col("perplexity").isNotNull(), F.coalesce(
        excess(F.col("n_words"), F.col("n_odd"), F.col("at.rate"), F.col("at.spread")), F.lit(0.0)))
    rows = rows.withColumn("odd_words", odd)
    within = lambda x, y: F.coalesce(F.col(x) <= F.col(y), F.lit(True))
    return rows.select("block", "place", "perplexity", "odd_words", "n_symbols", "n_words", "n_odd", F.col("at.perplexity").alias(
        "perplexity_limit"), F.col("at.words").alias("word_limit"), (F.col("perplexity").isNotNull() & within(
            "perplexity", "at.perplexity") & within("odd_words", "at.words")).alias("keep"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             out: str = "kn", perplexity_quantile: float = PERPLEXITY_QUANTILE, word_quantile: float = WORD_QUANTILE) -> DataFrame:
    """Train on the trusted documents among ``docs`` and score all of them: all columns of ``docs`` and a struct ``out``:
    perplexity, odd_words (their excess), n_symbols, n_words, n_odd, both limits, keep."""
    corpus = packed(docs, id_col, text_col, lang_col)
    model = train(corpus, labels)
    facts = scored_in_waves(corpus, model)
    return restored(corpus, judged(facts, limits_of(facts, perplexity_quantile, word_quantile)), out)
