"""Objects made from the driver's tables: inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import tsyntax as ts
from lumenframe.operators import pixels as px
from lumenframe.operators import tables


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before Python work, if the scan has fewer splits than there are cores.

    A table of any size has more splits, and then nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def order_objects(spark: SparkSession, sf_dir: str, syntax: str = ts.EXPLICIT_LE) -> DataFrame:
    """One metadata object per order."""
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("2.25."), F.col("o_orderkey")).alias("uid"),
        F.col("o_custkey").cast("string").alias("patient"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("date"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("price"),
        F.array(F.struct(F.col("o_orderstatus").alias("CodeValue"), F.lit("status").alias("CodeMeaning"))).alias("codes"),
    )
    return tables.encode(spread(o), {"SOPInstanceUID": "uid", "PatientID": "patient", "StudyDate": "date", "StudyDescription": "priority", "SelectorFDValue": "price", "RequestAttributesSequence": "codes"}, syntax, ["o_orderkey"], {"SOPClassUID": ts.SECONDARY_CAPTURE, "Modality": "OT"})


def quantized(top: int = 4095) -> Column:
    """Vector values as stored pixels."""
    return F.transform("embedding", lambda e: F.least(F.lit(top), F.greatest(F.lit(0), ((e.cast("double") + F.lit(0.5)) * F.lit(float(top))).cast("int"))))


def quantized_sql(top: int = 4095) -> str:
    return f"list_transform(embedding, lambda e: least({top}, greatest(0, trunc((e::DOUBLE + 0.5::DOUBLE) * {top}::DOUBLE)))::INT)"


def frame_objects(spark: SparkSession, sf_dir: str, values: Column, rows: int, columns: int, bits: int = 16, stored: int = 12, samples: int = 1, photometric: str = "MONOCHROME2", frames: int = 1, syntax: str = ts.EXPLICIT_LE, **more: object) -> DataFrame:
    """One image object per vector."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", tables.pack(values, bits).alias("pixels"), F.concat(F.lit("M"), F.col("label")).alias("modality"))
    fixed: dict = {"SOPClassUID": ts.SECONDARY_CAPTURE, "Rows": rows, "Columns": columns, "SamplesPerPixel": samples, "BitsAllocated": bits, "BitsStored": stored, "HighBit": stored - 1, "PixelRepresentation": 0, "PhotometricInterpretation": photometric, "NumberOfFrames": str(frames)}
    return tables.encode(spread(e), {"PixelData": "pixels", "Modality": "modality"}, syntax, ["vec_id", "label"], fixed | more)


def window_sql(v: str, center: float, width: float) -> str:
    """The intensity window over a list of doubles named ``v``."""
    den, lower, upper = max(width - 1.0, 1.0), *px.window_edges(center, width)
    d = lambda x: f"({x!r})::DOUBLE"
    lo, hi = f"list_min({v})", f"list_max({v})"
    inside = f"len(list_filter({v}, lambda x: x >= {d(lower)} AND x <= {d(upper)}))"
    back = f"({d(upper)} <= {lo} OR {d(lower)} >= {hi} OR greatest(0::DOUBLE, least({d(upper)}, {hi}) - greatest({d(lower)}, {lo})) / greatest({hi} - {lo}, 1::DOUBLE) < 0.05::DOUBLE OR {inside} * 100 < len({v}))"
    one = f"CASE WHEN x <= {d(lower)} THEN 0 WHEN x > {d(upper)} THEN 255 ELSE trunc(least(255::DOUBLE, greatest(0::DOUBLE, ((x - {d(center - 0.5)}) / {d(den)} + 0.5::DOUBLE) * 255::DOUBLE)))::INT END"
    return f"CASE WHEN {back} THEN {normalize_sql(v)} ELSE list_transform({v}, lambda x: {one}) END"


def normalize_sql(v: str) -> str:
    lo, hi = f"list_min({v})", f"list_max({v})"
    return f"list_transform({v}, lambda x: CASE WHEN abs({hi} - {lo}) < 2.220446049250313e-16::DOUBLE THEN 0 ELSE trunc(least(255::DOUBLE, greatest(0::DOUBLE, (x - {lo}) / ({hi} - {lo}) * 255::DOUBLE)))::INT END)"


def digest(values: Column) -> list[Column]:
    """Sum, extremes and a place-weighted sum of an array."""
    return [
        F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
        F.array_min(values).cast("bigint").alias("least"),
        F.array_max(values).cast("bigint").alias("most"),
        F.aggregate(F.transform(values, lambda x, i: x.cast("bigint") * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("weighted"),
    ]


def digest_sql(v: str) -> str:
    return f"list_sum({v})::BIGINT AS total, list_min({v})::BIGINT AS least, list_max({v})::BIGINT AS most, list_sum(list_transform({v}, lambda x, i: x::BIGINT * i))::BIGINT AS weighted"
