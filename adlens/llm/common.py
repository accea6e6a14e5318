"""Helpers shared by the corpus operators: staged tables in the shared folder
and a column contract check.

Joins that move whole texts carry a ``merge`` hint: a plan that broadcasts the
other side while it is small and shuffles once it is not would make the cost of
a step jump between sizes; with the hint it grows in proportion.

Lineage is cut with *written tables* in the folder that ``spark.checkpoint.dir``
names (see :func:`adlens.session.shared_dir`), so a lost executor costs at most
the tasks since the last written table; nothing is kept in executor memory or
in machine-local folders.
"""

from __future__ import annotations

import contextlib
import gc
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.session import shared_dir, ship_package


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path in the shared folder."""
    return f"{shared_dir(spark)}/{name}_{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    vars(table)["staged_at"] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`staged` gave and nothing reads any more; other DataFrames are passed over."""
    for table in tables:
        if path := vars(table).pop("staged_at", None):
            sc = table.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Jobs run within hand rows to Python tasks in batches of at most about ``size`` bytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions_for(spark: SparkSession, df_rows: int, rows_per_partition: int) -> int:
    """Number of shards so that each holds about ``rows_per_partition`` rows."""
    return max(1, -(-df_rows // rows_per_partition))


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed internal names.

    ``narrow(df, doc_id="doc_id", text="text")``: extra columns, whatever they
    are called, never reach the operator, so they cannot clash with its own.
    Every operator starts here, so this also makes sure that workers have the
    package.
    """
    ship_package(df.sparkSession)
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in columns.items()])


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written.

    They go when the driver collects its garbage, which a driver with little
    to do may not do for hours; this asks for it between the steps of a job.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
