"""Sources and sinks: files, path lists, documents, images."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import columns as cl
from lumenframe.functions.errors import fail


def read_objects(spark: SparkSession, paths: str | list[str], glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path, length, modificationTime, content; filters on path and length reach the scan."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (r.option("pathGlobFilter", glob) if glob else r).load(paths)


def read_path_list(spark: SparkSession, lines: DataFrame, column: str = "value") -> DataFrame:
    """Objects of a table of paths: trimmed, blanks skipped; a path that can't be read keeps its row and the error.

    Paths are read on the executors, so they must be visible there.
    """
    p = lines.select(F.trim(F.col(f"`{column}`")).alias("path")).where("path <> ''")

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for x in b.column(0).to_pylist():
                data = error = None
                try:
                    with open(x.removeprefix("file://"), "rb") as f:
                        data = f.read()
                except OSError as err:
                    error = f"{type(err).__name__}: {err}"
                yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([data], pa.binary()), pa.array([error], pa.string())], names=["path", "content", "error_message"])

    return p.mapInArrow(work, "path string, content binary, error_message string")


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and doc of JSON files, each one document."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc"))


def detect(df: DataFrame) -> DataFrame:
    """Adds input_kind, from the extension, then the content; null where neither tells."""
    return df.withColumn("input_kind", cl.input_kind(F.col("path"), F.col("content")))


def require_all(df: DataFrame, column: str = "error_code") -> DataFrame:
    """Fails if any row holds an error: the batch has run through by then."""
    bad = df.where(F.col(f"`{column}`").isNotNull()).limit(1).collect()
    if bad:
        raise fail("BatchFailed", f"at least one object failed: {bad[0].asDict()}")
    return df


def write_files(df: DataFrame, path: str = "out_path", content: str = "content") -> DataFrame:
    """Writes each row's bytes (or text) to its own path; returns path, n_bytes and the error.

    A file appears whole or not at all: it is written beside its place and renamed, so a
    repeated task does no harm and a scanned file may be replaced by its new version.
    The result is lazy, like every transformation.
    """

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = error = None
                try:
                    if x is None:
                        raise OSError("nothing to write")
                    p = p.removeprefix("file://")
                    tmp = f"{p}.{uuid.uuid4().hex}.part"
                    os.makedirs(os.path.dirname(p) or ".", exist_ok=True)
                    with open(tmp, "wb") as f:
                        f.write(x)
                    os.replace(tmp, p)
                    n = len(x)
                except OSError as err:
                    error = str(err)
                out.append((p, n, error))
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["path", "n_bytes", "error_message"])

    return df.select(F.col(f"`{path}`"), F.col(f"`{content}`").cast("binary")).mapInArrow(work, "path string, n_bytes bigint, error_message string")


def image_files(renders: DataFrame, base: str) -> DataFrame:
    """Adds out_path to renders: ``base`` for one frame, numbered names from a column of the object's base path for many."""
    return renders.withColumn("out_path", cl.frame_path(F.col(f"`{base}`"), F.col("frame_index") + 1))


def raw_objects(frames: DataFrame, key: str) -> DataFrame:
    """All native frames of an object one after another: one shuffle by the object's key."""
    parts = F.sort_array(F.collect_list(F.struct("frame_index", "frame")))
    joined = F.aggregate(parts, F.unhex(F.lit("")), lambda a, x: F.concat(a, x["frame"]))
    return frames.groupBy(key).agg(joined.alias("content"))


def write_video(*_: object, **__: object) -> None:
    raise fail("UnsupportedOutput", "MPEG-4 output needs an external encoder that is not part of this engine; write numbered frames instead")
