"""Registers the engine's functions for SQL text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf

from lumenframe.functions import documents as docs
from lumenframe.functions.errors import ObjectError
from lumenframe.operators import tables
from lumenframe.operators import transcode as tc
from lumenframe.sources import objects as ob


class _Elements:
    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is None:
            return
        try:
            for r in tables.element_rows(ob.parse(bytes(content))):
                yield r
        except ObjectError as err:
            yield (None,) * 14 + (err.code, str(err))


def register(spark: SparkSession) -> None:
    """``dicom_elements(content)`` as a table function; ``dicom_json(content)``, ``dicom_transcode(content, uid)`` as functions."""
    spark.udtf.register("dicom_elements", udtf(_Elements, returnType=tables.ELEMENTS))

    def to_json(a):
        import pyarrow as pa

        return pa.array([None if x is None else docs.write_json(ob.parse(x)) for x in a.to_pylist()], pa.string())

    def recode(a, u):
        import pyarrow as pa

        return pa.array([None if x is None else ob.write(tc.transcode(ob.parse(x), y)) for x, y in zip(a.to_pylist(), u.to_pylist(), strict=True)], pa.binary())

    spark.udf.register("dicom_json", arrow_udf(to_json, "string"))
    spark.udf.register("dicom_transcode", arrow_udf(recode, "binary"))
