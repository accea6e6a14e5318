"""Sequence packing: first-fit decreasing over a tournament tree of bin
capacities, run independently in randomised groups of documents.

1. Every whole text is tokenised in its task (``mapInArrow``); the ids stay
   there, only one small row per *piece* leaves (about 50 bytes): a document
   is cut into full pieces of ``capacity`` ids, which fill a sequence of their
   own, and one remainder.
2. Remainders get a group by a hash of their number in the written table of pieces, so neighbours in
   the corpus, a hot source and any number of equal rows spread over all groups; the number of groups
   follows the number of remainders, so a group stays at ``group_size`` rows
   on average whatever the corpus size.
3. Within a group pieces are taken longest first and each goes to the first
   open sequence with room, found in O(log n) in a tournament tree whose inner
   nodes hold the largest free capacity below them.

Defined cases: null and empty texts are one piece holding the end id alone; a
null doc_id is kept and packed (as its own document, null in the output);
repeated rows are packed as often as they occur; an empty table gives no rows;
columns other than the two named ones are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import narrow, partitions_for, staged

CAPACITY = 2048
GROUP_SIZE = 8192
END_ID = 1
CACHE_PARTS = 300_000
_SPLIT = re.compile(r"[ \t\n\r]+")
_PARTS = re.compile(r"[a-zß-öø-ÿªºµ]+|[^a-zß-öø-ÿªºµ\s]+")
_ODD = re.compile(r"['\x1c-\x1f]|[^\x00-\xff]")  # \x1c-\x1f: white space to Python alone

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
PACKED = PIECES + ", sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of a whole text from those of its parts.

    The tokenizer lower-cases and splits at white space and between letters
    and other signs before it merges, so a text's ids are those of its parts
    in order. The parts seen are cached, within a fixed bound. Texts where
    that shortcut could differ (characters beyond Latin-1, which may compose;
    apostrophes, for contractions that stay whole) are split at spaces only.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(path)
        self._merge = self._tok.model.tokenize
        self._ids: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self._ids) > CACHE_PARTS:
            self._ids = {}
        ids = self._ids
        split = [_SPLIT.split(t) if _ODD.search(t) else _PARTS.findall(t.lower()) for t in texts]
        new = [p for p in set().union(*split) if p not in ids]
        odd = []
        for part in new:
            if part.isascii() and part.isalpha() and part.islower():  # already one normal word
                ids[part] = array("I", [t.id for t in self._merge(part)]).tobytes()
            else:
                odd.append(part)
        for part, enc in zip(odd, self._tok.encode_batch_fast(odd, add_special_tokens=False)):
            ids[part] = array("I", enc.ids).tobytes()
        return [b"".join([ids[p] for p in parts]) for parts in split]


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One instance a worker process and path: its caches outlive a task."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def _tokenise(path: str, capacity: int, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            ids = batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, 64):
                texts = [t or "" for t in batch.column(1).slice(at, 64).to_pylist()]
                for doc_id, body in zip(ids[at: at + 64], ids_of(texts)):
                    body += end
                    total = len(body) // 4
                    for start in range(0, total, capacity):
                        piece = body[4 * start: 4 * (start + capacity)]
                        for column, v in zip(rows, (doc_id, start, len(piece) // 4, zlib.crc32(piece), total)):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], schema=schema)

    return run


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, longest first into the first bin with room.

    The tournament tree has a leaf for each possible bin (as many as pieces);
    ``tree[i]`` is the largest free capacity under node i.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        node //= 2
        while node:
            top = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == top:
                break
            tree[node] = top
            node //= 2
    return bins, offsets


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         capacity: int = CAPACITY, group_size: int = GROUP_SIZE, end_id: int = END_ID) -> DataFrame:
    """Pack whole texts into sequences of at most ``capacity`` ids.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. ``tokenizer`` is the path of a ``tokenizers`` file
    that every executor can read (an installed public vocabulary).
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    pieces = staged(narrow(docs, doc_id=id_col, text=text_col)
                    .mapInArrow(_tokenise(path, capacity, end_id), PIECES)
                    .withColumn("number", F.monotonically_increasing_id()), "pack_pieces")
    full = pieces.where(F.col("length") == capacity)
    rest = pieces.where(F.col("length") < capacity)
    groups = partitions_for(spark, rest.count(), group_size)
    # negative ids: sequences that one full piece fills; they need no packing
    alone = full.drop("number").select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
                        F.lit(0).cast("long").alias("offset"))

    def pack_group(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), capacity)
        table = table.drop_columns(["grp"])
        table = table.append_column("sequence_id", pa.array(bins + (key[0].as_py() << 32), pa.int64()))
        return table.append_column("offset", pa.array(offsets, pa.int64()))

    dealt = rest.withColumn("grp", F.pmod(F.xxhash64("number"), F.lit(groups))).drop("number")
    return dealt.groupBy("grp").applyInArrow(pack_group, PACKED).unionByName(alone)
