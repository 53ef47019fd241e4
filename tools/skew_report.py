"""Task balance under hot keys, from Spark's event log.

Derives skewed tables from the driver's tables (one customer holds a third of
the orders, one order and one product each a third of the items), runs jobs
with size-based broadcasting off (large-data plans) and AQE's skew-join
threshold scaled down to the test size, then reports for every job the largest
share of a shuffle-reading stage's records that a single task read.

usage: python tools/skew_report.py [sf_dir] [job ...]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(argv):
    sf_dir = next((a for a in argv[1:] if a.startswith("/")), "/root/testdata/sf0.1")
    names = [a for a in argv[1:] if not a.startswith("/")] or [
        "monthly_metrics", "category_revenue", "repeat_customer_metrics", "top_customers_by_revenue",
        "days_between_first_two_orders", "business_summary", "category_delay_top10", "rfm_segment_summary"]
    scratch = tempfile.mkdtemp(prefix="skew-report-")
    ev = os.path.join(scratch, "events")
    os.makedirs(ev)
    from pyspark.sql import functions as F
    from tillroll import catalog
    from tillroll.session import build_session
    from tillroll.sources.landing import ParquetShop
    from tillroll.sources.testbind import TestShop
    spark = build_session("local[8]", int(os.environ.get("SKEW_PARTITIONS", "64")), extra={
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        # no coalescing: every task's share is then comparable with 1 / partitions
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": ev,
        "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
    s = TestShop(spark, sf_dir)
    hot_c = s.customers().agg(F.min("customer_id")).first()[0]
    hot_o = s.orders(delivery=False).agg(F.min("order_id")).first()[0]
    hot_p = s.products().agg(F.min("product_id")).first()[0]
    t = dict(s.all_tables())
    t["orders"] = s.orders().withColumn(
        "customer_id", F.when(F.col("order_id") % 3 == 0, F.lit(hot_c)).otherwise(F.col("customer_id")))
    t["order_items"] = (t["order_items"]
                        .withColumn("order_id", F.when(F.col("order_item_id") % 3 == 0, F.lit(hot_o))
                                    .otherwise(F.col("order_id")))
                        .withColumn("product_id", F.when(F.col("order_id") % 3 == 1, F.lit(hot_p))
                                    .otherwise(F.col("product_id"))))
    raw = os.path.join(scratch, "raw")
    for name, df in t.items():
        df.repartition(8).write.mode("overwrite").parquet(f"{raw}/{name}")
    shop = ParquetShop(spark, raw)
    for name in names:
        spark.sparkContext.setJobDescription(name)
        catalog.run_on(shop, name).collect()
    spark.stop()

    log = glob.glob(os.path.join(ev, "*"))[0]
    stage_job, job_desc, reads = {}, {}, {}
    current = None
    for line in open(log):
        e = json.loads(line)
        kind = e["Event"]
        if kind == "SparkListenerJobStart":
            # jobs run one after another; stage jobs submitted without the
            # description belong to the job described last
            current = e.get("Properties", {}).get("spark.job.description") or current
            job_desc[e["Job ID"]] = current
            for st in e["Stage IDs"]:
                stage_job[st] = e["Job ID"]
        elif kind == "SparkListenerTaskEnd" and e.get("Task Metrics"):
            r = e["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"]
            reads.setdefault(e["Stage ID"], []).append(r)
    worst = {}
    for st, rs in reads.items():
        total = sum(rs)
        if total < 10_000 or len(rs) < 2:      # fact-volume stages only
            continue
        d = job_desc.get(stage_job.get(st))
        ratio = max(rs) / (total / len(rs))
        if d and ratio > worst.get(d, (0, 0, 0, 0))[0]:
            worst[d] = (ratio, max(rs), total, len(rs))
    print("| job | worst stage: largest task / mean task | records (largest task / stage, tasks) |")
    print("|---|---|---|")
    for name in names:
        ratio, mx, tot, n = worst.get(name, (0, 0, 0, 0))
        print(f"| {name} | {ratio:.2f} | {mx:,} / {tot:,} ({n}) |")


if __name__ == "__main__":
    main(sys.argv)
