"""Dictionary-compressed web archives: write and read ``.warc.zst`` files.

Every record is a Zstandard frame of its own, compressed with one dictionary
that is trained on archived records (a sample bounded by ``SAMPLE_RECORDS`` and
``SAMPLE_CHARS``, the records of smallest id hash) and embedded in each file's
leading skippable frame, so a file can be read alone and from any record on.

Payloads of at least ``min_revisit_bytes`` that occur more than once are stored
once: the row with the largest id is the response, the others become revisit
records without a body. Digests and sizes are compared (not payloads shuffled):
one small row a page, combined map-side, so a payload of a third of all pages
sends one row a task.

Files are written by the tasks themselves under names of their own attempt; the
returned manifest (a written table) names the files of the attempts that
counted, so a retried or lost task leaves at most a file nobody reads.

Defined cases: a null payload is empty; a null id or url is left out of the
headers (the id reads back as null; such a row is always a response); rows that
repeat an id are written as often as they occur; an empty table gives no files
and an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.llm.common import narrow, new_path, staged

MIN_REVISIT_BYTES = 1000
ROLL_BYTES = 256 << 20  # a file is closed and the next begun beyond this compressed size
DICT_BYTES = 110 << 10
SAMPLE_RECORDS, SAMPLE_CHARS = 1000, 8192
LEVEL = 3
# --- Fixed values: archive format ----------------------------------------------
DICT_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
# --- end of fixed values --------------------------------------------------------
MANIFEST = "path string, records long, bytes long"
RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
           "payload_digest string, payload binary")


def _record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str,
            refers_to: int | None, date: str) -> bytes:
    """One record; a revisit keeps the size and digest of the payload it leaves out."""
    block = HTTP_HEAD if refers_to is not None else HTTP_HEAD + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(
            c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
             "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(pages: DataFrame, date: str) -> bytes:
    """A dictionary from a bounded sample of records (the start of long ones).

    The sample is the records of smallest id hash; a first pass over the hashes
    alone finds how small, so the driver sees a few thousand numbers and
    ``SAMPLE_RECORDS`` records, however many pages there are.
    """
    import zstandard
    scale = 1 << 40
    pages = pages.withColumn("rank", F.pmod(F.xxhash64("page_id", "digest"), F.lit(scale)))
    share = min(1.0, 4 * SAMPLE_RECORDS / max(1, pages.select("page_id").count()))
    least = (pages.where(F.col("rank") < int(share * scale)).select("rank").distinct()
             .orderBy("rank").limit(SAMPLE_RECORDS).agg(F.max("rank")).first()[0])
    rows = (pages.where(F.col("rank") <= F.lit(-1 if least is None else least)).limit(SAMPLE_RECORDS)
            .select("page_id", "url", F.substring("html", 1, SAMPLE_CHARS).alias("html"), "digest").collect())
    rows.sort(key=lambda r: (r.digest, r.page_id or 0))
    samples = [_record(r.page_id, r.url, p := (r.html or "").encode(), len(p), r.digest, None, date) for r in rows]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the records themselves, as a plain prefix
        return b"".join(samples)[-DICT_BYTES:]


def _writer(out_dir: str, dictionary: bytes, date: str, roll: int):
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs
        files, base = fs.FileSystem.from_uri(out_dir)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        sink, path, records, size, done = None, "", 0, 0, []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for page_id, url, payload, n, digest, refers_to in zip(
                        *(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    if sink is None:
                        name = f"pages-{uuid.uuid4().hex}.warc.zst"
                        sink, path, records = files.open_output_stream(f"{base}/{name}", compression=None), f"{out_dir}/{name}", 0
                        size = sink.write(struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary)
                    size += sink.write(packer.compress(_record(page_id, url, payload or b"", n, digest, refers_to, date)))
                    records += 1
                    if size >= roll:
                        sink.close()
                        done.append((path, records, size))
                        sink = None
        if sink is not None:
            sink.close()
            done.append((path, records, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], f.type) for i, f in enumerate(schema)],
                                         schema=schema)

    return run


def write_archive(pages: DataFrame, out_dir: str | None = None, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES,
                  date: str = "2020-01-01T00:00:00Z", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write all pages; returns the manifest (path, records, bytes), one row per file."""
    from pyarrow import fs
    spark = pages.sparkSession
    out_dir = out_dir or new_path(spark, "warc")
    files, base = fs.FileSystem.from_uri(out_dir)
    files.create_dir(base, recursive=True)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    pages = narrow(pages, page_id=id_col, url=url_col, html=payload_col).withColumns(
        {"n": F.octet_length(payload).cast("long"), "digest": F.sha1(payload)})
    facts = pages.where((F.col("n") >= min_revisit_bytes) & F.col("page_id").isNotNull()).select("page_id", "n", "digest")
    kept = staged(facts.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"))
                  .where("least < refers_to").drop("least"), "warc_kept")
    revisits = staged(facts.join(kept, ["digest", "n"]).where("page_id < refers_to")
                      .select("page_id", F.col("digest").alias("d"), "refers_to").distinct(), "warc_revisits")
    dictionary = train_dictionary(pages, date)
    rows = (pages.join(revisits.hint("merge"), (pages["page_id"] == revisits["page_id"]) & (pages["digest"] == revisits["d"]), "left")
            .select(pages["page_id"], "url", F.when(F.col("refers_to").isNull(), payload).alias("payload"),
                    "n", "digest", "refers_to"))
    return staged(rows.mapInArrow(_writer(out_dir, dictionary, date, roll_bytes), MANIFEST), "warc_manifest")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a decompressed stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("not at the start of a record")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        stream.read(4)
        yield head, block


def read_file(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file; the dictionary comes from its first frame."""
    import zstandard
    from pyarrow import fs
    files, name = fs.FileSystem.from_uri(path)
    with files.open_input_stream(name, compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != DICT_MAGIC:
            raise ValueError(f"no dictionary frame: {path}")
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(source.read(size)))
        yield from _records(io.BufferedReader(unpacker.stream_reader(source, read_across_frames=True), 1 << 18))


def _page(reference: str | None) -> int | None:
    digits = (reference or "")[len("<urn:page:"):-1]
    return int(digits) if digits else None


def _reader(with_payload: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for head, block in read_file(path):
                    body = block.partition(b"\r\n\r\n")[2]
                    refers_to = _page(head.get("warc-refers-to"))
                    size, digest = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:")
                    if refers_to is None:  # what was read back counts, and must be what was announced
                        if (len(body), hashlib.sha1(body).hexdigest()) != (size, digest):
                            raise ValueError(f"damaged record {head['warc-record-id']} in {path}")
                    rows.append((_page(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"],
                                 refers_to, size, digest, body if with_payload and refers_to is None else None))
                    held += len(block) if with_payload else 0
                    if len(rows) >= 5000 or held > 8 << 20:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_archive(spark: SparkSession, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the manifest's files, a file a task."""
    n = max(1, manifest.count())
    paths = manifest.select("path").repartition(n, "path")
    return paths.mapInArrow(_reader(with_payload), RECORDS)


ORACLE = """
WITH f AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM f
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM g
"""
