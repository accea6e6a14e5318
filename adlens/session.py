"""Session helpers: building a local session for tests and finding the shared
folder for staged tables.

On a cluster the staging folder is the one the cluster names in
``spark.checkpoint.dir``; it is read from the session and never invented,
except for a local-mode session (tests, laptops) that has none.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot does not JIT-compile methods over 8000 bytes of bytecode; the
    # typed projection of a 26-column export outgrows that as one fused
    # stage and would run interpreted. At this limit Spark compiles such a
    # stage operator by operator instead (2.5x faster on the ingestion).
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "adlens", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("ADLENS_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables and checkpoints.

    Uses ``spark.checkpoint.dir`` (or the context's checkpoint dir). Only a
    local-mode session without one gets a fresh folder under the system temp
    directory; a cluster session without one is an error, because a
    machine-local folder is not visible to the other executors.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d.rstrip("/")
    master = spark.sparkContext.master or ""
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    d = tempfile.mkdtemp(prefix="adlens-")
    spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def staged_table(df, name: str):
    """``df`` written as Parquet under a fresh name in the shared folder and
    read back: computed once however often it is used, lineage cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/adlens_{name}_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Tables written within leave no shuffle files behind: Spark deletes them at the end of each query, not when
    the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, through the session's Hadoop file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when a finished write left its ``_SUCCESS`` marker at ``path``.

    Asks the session's Hadoop file system (any scheme Spark writes to, no
    job, no listing); a session without a JVM gateway probes by reading.
    """
    marker = f"{path.rstrip('/')}/_SUCCESS"
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(marker)
        return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))
    except Exception:  # no gateway (remote session)
        try:
            spark.read.text(marker)
            return True
        except Exception:  # PATH_NOT_FOUND
            return False


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers (once a context).

    Functions that run in tasks are pickled by module name, so workers must be
    able to import the package even where it is not installed and whatever the
    driver's working directory is. A small zip of the sources goes through
    Spark's own file distribution.
    """
    sc = spark.sparkContext
    if getattr(sc, "_adlens_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="adlens-src-"), "adlens_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("adlens", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._adlens_shipped = True
