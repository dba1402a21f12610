"""Headline queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docledger.plans import catalog  # noqa: E402
from docledger.session import local_session  # noqa: E402

HEADLINE = [
    "lang_top",
    "classify_additive",
    "table_runs",
    "html_text",
    "emails",
    "content_hash_dups",
    "type_detect",
    "inv_totals",
    "inv_items",
    "pack_totals",
    "run_corpus",
    "items_rollup",
    "chk_all",
    "val_strict",
    "val_component",
    "compare_reference",
    "best_candidate",
    "json_roundtrip",
    "conv_summary",
    "error_rate_5m",
    "stream_hourly",
    "render_documents",
    "xml_roundtrip",
    "html_report",
]
# Tables whose rows are read by CPU-bound work.
SPREAD = ["orders", "documents", "pages"]


def spread(spark: SparkSession, folder: str, cores: int) -> str:
    """The tables with at least ``cores`` files each, as a table of any size has: one small file would be one task."""
    out = tempfile.mkdtemp(prefix="spark-bench-")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)
        if name.removesuffix(".parquet") in SPREAD:
            spark.read.parquet(path).repartition(cores).write.parquet(f"{out}/{name}")
        else:
            os.symlink(os.path.abspath(path), f"{out}/{name}")
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    folder = spread(spark, folder, int(cores))
    # One small query first: the numbers below are queries, not the start of the virtual machine.
    catalog.QUERIES["job_counts"](spark, folder).collect()
    took: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    docs = spark.read.parquet(f"{folder}/orders.parquet").count()
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": sf,
                "documents_per_second": round(docs / took["run_corpus"], 1),
                "line_items_per_second": round(lines / took["inv_items"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
