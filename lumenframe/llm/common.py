"""Shared folder, size checks and small Spark helpers of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides up to this many estimated bytes are broadcast; larger ones go through a shuffle.
BROADCAST_BYTES = 48 << 20
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
RELEASE_S = 5  # at most, for references that Python dropped to reach the JVM


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; set only where it is unset."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not at:
        at = tempfile.mkdtemp(prefix="lumenframe-")  # local tests only: no cluster names a folder
        sc.setCheckpointDir(at)
    return at


def saved(df: DataFrame) -> DataFrame:
    """The rows written as Parquet in the shared folder and read back; lineage is cut."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/lumenframe/{uuid.uuid4().hex}"
    df.write.parquet(at)
    _WRITTEN.append(at)
    return spark.read.schema(df.schema).parquet(at)


_WRITTEN: list[str] = []  # tables that ``saved`` wrote and nobody deleted


def written() -> int:
    """A mark for ``clear_saved``."""
    return len(_WRITTEN)


def clear_saved(spark: SparkSession, since: int | None = None, keep: int = 0) -> None:
    """Deletes the tables that ``saved`` wrote since a mark, but for the last ``keep``; without a mark the whole folder.

    Call it when no result that reads them is needed any more.
    """
    sc = spark.sparkContext
    end = len(_WRITTEN) - keep
    gone = [f"{shared_dir(spark)}/lumenframe"] if since is None else _WRITTEN[since:end]
    del _WRITTEN[since or 0 : end]
    for x in gone:
        at = sc._jvm.org.apache.hadoop.fs.Path(x)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files and broadcasts that nothing refers to any more; else they stay until the driver's next full collection."""
    gc.collect()
    sc = spark.sparkContext
    # Python's dropped references reach the JVM through a thread that looks for them once a second
    dropped, until = getattr(sc._gateway._gateway_client, "finalizer_deque", ()), time.monotonic() + RELEASE_S
    while dropped and time.monotonic() < until:
        time.sleep(0.05)
    sc._jsc.sc().listenerBus().waitUntilEmpty()  # events not yet handled still refer to the plans that just ran
    sc._jvm.System.gc()


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def buckets_for(df: DataFrame, bytes_each: int, least: int = 4) -> int:
    """Bucket number that grows with the input.

    Catalyst gives plans of unknown size about 2**63 bytes; those take the session's shuffle partitions.
    """
    size = input_bytes(df)
    return max(least, -(-size // bytes_each) if size < 1 << 60 else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def small(df: DataFrame, row_bytes: int, rows: int | None = None, items: str | None = None, item_bytes: int = 16) -> DataFrame:
    """The side, marked for broadcast if its counted rows, and the items of an array column, fit BROADCAST_BYTES."""
    n = rows
    if n is None:
        n, k = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(items)), F.lit(0)) if items else F.lit(0)).first()
        row_bytes += item_bytes * k / max(n, 1)
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def text_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows and BATCH_BYTES bytes, where the session has Spark's defaults of 10,000 and 64 MB: of texts and packed arrays these are tens of megabytes on both sides of every task."""
    for name, default, most in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
