"""Continuous ingest: files as they arrive become element rows or documents. No state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenframe.operators import tables

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def stream_objects(spark: SparkSession, directory: str, glob: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    """A stream of files: path, modificationTime, length, content."""
    return spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(directory)


def stream_elements(spark: SparkSession, directory: str, **options: object) -> DataFrame:
    return tables.elements(stream_objects(spark, directory, **options), keep=["path"])


def stream_documents(spark: SparkSession, directory: str, format: str = "flat", **options: object) -> DataFrame:
    s = stream_objects(spark, directory, **options)
    d = tables.to_json_doc(F.col("content"), format=format)
    return s.select("path", d.alias("d")).select("path", "d.value", "d.code", "d.message")


def to_parquet(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream to Parquet; each file is taken once, by the checkpoint."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()
