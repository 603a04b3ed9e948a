import os
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import blobs, common
from lumenframe.llm.textvec import Words, repeated, runs


def test_saved_tables_and_their_removal(spark):
    df = common.saved(spark.range(5))
    assert df.count() == 5
    at = common.shared_dir(spark).removeprefix("file:") + "/lumenframe"
    assert os.path.isdir(at)
    common.clear_saved(spark)
    assert not os.path.exists(at)


def test_sides_are_broadcast_by_size_only(spark):
    a, b = common.small(spark.range(10), 8), common.small(spark.range(10), 8 << 20)
    assert "broadcast" in a._jdf.queryExecution().toString().lower() and "broadcast" not in b._jdf.queryExecution().logical().toString().lower()
    arrays = spark.range(2).select(F.array_repeat("id", 1000).alias("x"))
    assert "broadcast" not in common.small(arrays, 8, items="x", item_bytes=1 << 20)._jdf.queryExecution().logical().toString().lower()


def test_batches_are_bounded_by_bytes(spark):
    """Rows of packed arrays are large; by rows alone a task holds tens of megabytes of them on both sides."""

    def work(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["n", "size"])

    common.text_batches(spark)
    got = spark.range(64, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 18).alias("x")).mapInArrow(work, "n bigint, size bigint").collect()
    assert sum(r.n for r in got) == 64 and max(r.size for r in got) <= common.BATCH_BYTES + (1 << 19)


def test_words_lines_and_windows_against_plain_code():
    texts = ["", " ", "a", "Ab  c\n\nd\t", None, "\n", "é　ü x\nx", "x" * 3000 + " y"]
    w = Words(pa.array(texts), lower=True)
    plain = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    got = [[bytes(w.buf[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == plain
    same = {}
    for h, x in zip(w.hash.tolist(), (x for p in plain for x in p), strict=True):
        assert same.setdefault(x.lower() if x.isascii() else x, h) == h
    assert len(set(same.values())) == len(same)
    start, end, doc = w.lines()
    lines = [[] for _ in texts]
    for s, e, d in zip(start, end, doc, strict=True):
        lines[d].append(bytes(w.buf[s:e]).decode())
    assert lines == [t.split("\n") if t else [] for t in texts]
    at, d, _ = w.windows(2)
    assert [int((d == k).sum()) for k in range(len(texts))] == [max(0, len(p) - 1) for p in plain]


def test_runs_cover_every_row_once():
    arr = pa.array(["x" * n for n in (0, 5, 100, 1, 1, 0, 50)])
    for most in (1, 10, 60, 1000):
        r = list(runs(arr, most))
        assert [k for i, j in r for k in range(i, j)] == list(range(7)) and all(j == i + 1 or sum(len(arr[k].as_py()) for k in range(i, j)) <= most for i, j in r)


@pytest.mark.parametrize("width", [4, 5, 6, 8])
def test_packed_arrays(width):
    x = np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64)
    a, b, c = blobs.unpack(blobs.pack(x, blobs.narrow(np.arange(300)), blobs.cut(x, width)))
    assert (a == x).all() and b.dtype == np.dtype("<u2") and (b == np.arange(300)).all()
    s = np.uint64(64 - 8 * width)
    assert (blobs.uncut(c, width) == (x >> s) << s).all()
    assert repeated(np.array([3, 1, 3, 2], np.uint64)).tolist() == [True, False, True, False] and blobs.ranges(np.array([5, 0, 9]), np.array([2, 0, 1])).tolist() == [5, 6, 9]


def test_release_waits_for_dropped_references(spark):
    """Else the collection comes before the JVM hears of them, and the shuffle files stay."""
    for _ in range(5):
        df = spark.range(100).repartition(3)
        df.count()
        del df
        common.release(spark)
        assert not spark.sparkContext._gateway._gateway_client.finalizer_deque
