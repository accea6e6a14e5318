"""Incremental ingestion of export files dropped into a folder.

The batch reader (``read_exports``) is the unit of work; Structured
Streaming supplies the bookkeeping: a ``binaryFile`` stream over the drop
folder (only file paths are selected, so file contents are not read by the
stream itself) tells each micro-batch which files are new, and
``foreachBatch`` loads exactly those files.

Exactly-once: the stream's checkpoint records which files each batch owns;
it lives inside the table's folder, so a table and its progress cannot be
parted. Every batch writes its rows to ``<table>/rows/batch_id=<id>`` with
overwrite, so a batch replayed after a failure replaces its own output and
nothing else. The file report goes to ``<table>/report`` the same way. The
number of paths a batch collects is bounded by ``max_files_per_trigger``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from adlens.sources.exports import read_exports


# the fixed schema of Spark's binaryFile source
BINARY_FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("content", T.BinaryType(), True),
])


def stream_exports(spark: SparkSession, folder: str, table_path: str,
                   max_files_per_trigger: int = 1000,
                   available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Start the stream; returns the running query.

    ``available_now=True`` processes what is in the folder and stops (a
    scheduled incremental load); otherwise it runs with
    ``processing_time`` triggers until stopped.
    """
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
             .option("recursiveFileLookup", "true")
             .option("maxFilesPerTrigger", max_files_per_trigger)
             .load(folder).select("path"))

    def load_batch(batch, batch_id: int) -> None:
        paths = [r.path for r in batch.select("path").collect()]  # bounded by max_files_per_trigger
        if not paths:
            return
        res = read_exports(spark, paths)
        res.table.write.mode("overwrite").parquet(f"{table_path}/rows/batch_id={batch_id}")
        res.report.write.mode("overwrite").parquet(f"{table_path}/report/batch_id={batch_id}")

    w = files.writeStream.foreachBatch(load_batch).option("checkpointLocation", f"{table_path}/progress")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()


def read_streamed(spark: SparkSession, table_path: str):
    """The ad table accumulated by ``stream_exports`` (all batches; a column
    that only some batches have is null in the others)."""
    return spark.read.option("mergeSchema", "true").parquet(f"{table_path}/rows").drop("batch_id")
