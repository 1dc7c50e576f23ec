"""Headline queries, timed: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

HERE = str(Path(__file__).resolve().parent)
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))  # for Python workers

from pyspark.sql import SparkSession

from boxwood.plans import catalogue
from boxwood.plans.tree import build
from boxwood.sources import meshes

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {
        "tree_embed_depth8": lambda: build(meshes.mesh_embed(spark, SF_DIR)).leaves,
        "tree_orders_depth8": lambda: build(meshes.mesh_orders(spark, SF_DIR)).leaves,
        "tree_orders_levels_depth3": lambda: build(meshes.mesh_orders(spark, SF_DIR), max_depth=3, finish_below=0).leaves,
        **{name: (lambda f=catalogue.QUERIES[name]: f(spark, SF_DIR)) for name in ("create_edges", "sah_root_best", "best_plane", "classify_triangles", "tree_text")},
    }
    took = {}
    for name, run in runs.items():
        run().write.format("noop").mode("overwrite").save()  # compiles the plans
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
