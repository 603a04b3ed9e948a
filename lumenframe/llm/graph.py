"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import common


LIMIT = 400_000


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the same components as the edges."""
    nodes, ids = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, c = ids[: len(u)], ids[len(u) :]
    root = np.arange(len(nodes))
    while True:  # min-label hooking with pointer jumping
        m = np.minimum(root[a], root[c])
        new = root.copy()
        np.minimum.at(new, root[a], m)
        np.minimum.at(new, root[c], m)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _contract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds a partition's edges into star forests of at most about LIMIT edges each."""
    u = v = np.zeros(0, np.int64)
    for b in it:
        u, v = np.concatenate([u, b.column(0).to_numpy()]), np.concatenate([v, b.column(1).to_numpy()])
        if len(u) > LIMIT:
            u, v = _forest(u, v)
            if len(u) > LIMIT // 2:  # it doesn't shrink any more: pass it on
                yield _edges(u, v)
                u = v = np.zeros(0, np.int64)
    if len(u):
        yield _edges(*_forest(u, v))


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """u > v in edges. Joins rather than windows, so adaptive skew handling can split a hub."""
    near = edges if not large else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    j = near.join(least, "u")
    j = j.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return j.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) bigint edges to (node, root): root is the smallest node of the component.

    Only nodes with an edge are returned. Rounds end when the edges are stars.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").cast("bigint").alias("u"), F.least("u", "v").cast("bigint").alias("v"))
    seen = None
    while True:
        e = _stars(_stars(e.mapInArrow(_contract, "u bigint, v bigint").distinct(), True), False)
        e = common.saved(e)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
