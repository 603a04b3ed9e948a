"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["dataset_roundtrip", "transcode_big_endian", "typed_vr_roundtrip", "flat_json_values", "json_to_object_roundtrip", "voi_window_frames", "window_columns", "redact_gray", "rle_roundtrip", "rendered_images", "elements_sql", "frame_explode", "bulk_inline_or_uri"]
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    from pyspark.sql import SparkSession

    from lumenframe.plans import registry

    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "1m")  # small files: one task a core needs small splits
        .config("spark.sql.files.openCostInBytes", "65536")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    force = lambda df: df.write.format("noop").mode("overwrite").save()
    force(registry.QUERIES["frame_explode"](spark, sf_dir))  # starts the workers
    out = {}
    for name in HEADLINE:
        took = []
        for _ in range(RUNS):
            began = time.time()
            force(registry.QUERIES[name](spark, sf_dir))
            took.append(time.time() - began)
        out[name] = round(statistics.median(took), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
