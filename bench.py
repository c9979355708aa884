"""Time the headline queries and print one JSON line.

``load`` derives the 19 all-text extracts from the source tables and stores them. Each query then
runs from the stored extracts (typing included) to its full result, written to Spark's no-op sink;
nothing is cached or materialised in between, except that the detail supply stores its context.
``refresh`` is the daily run from the extracts as CSV files: every table read, rebuilt and stored, and all
model tests. ``value`` is the sum over ``queries`` without the load and the refresh. ``BENCH_SF_DIR`` and
``BENCH_CPUS`` choose the tables and the cores.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from runout.fixtures.order_tables import PARAMS
from runout.plans.queries import FRAMES, stored_planning
from runout.plans.refresh import refresh
from runout.sources.sinks import scratch_folder

HEADLINE = [
    "material_stock_context",
    "quota_share",
    "po_transit_quota",
    "open_schedule",
    "late_shipment",
    "asn_status",
    "backlog",
    "consumption",
    "inventory_simulation",
    "shortage_report",
    "vendor_performance",
    "supply_gap_fill",
    "detail_supply",
    "weekly_demand",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        # tables that do not wait for each other are built at once
        .config("spark.scheduler.mode", "FAIR")
        # small files on one machine: let a scan and a coalesced shuffle use every core
        .config("spark.sql.files.openCostInBytes", "512k")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    plan = stored_planning(spark, folder, scratch_folder(spark))
    load = round(time.perf_counter() - start, 3)
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        FRAMES[name](plan).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    folders = [scratch_folder(spark) for _ in range(3)]
    for table, df in plan.extracts.items():
        df.write.option("header", True).option("escape", '"').csv(f"{folders[0]}/{table}_20000103.csv")
    plan.lanes.write.option("header", True).csv(folders[2])
    start = time.perf_counter()
    refresh(spark, folders[0], folders[1], PARAMS, folders[2])
    refreshed = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "load": load,
                "refresh": refreshed,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
