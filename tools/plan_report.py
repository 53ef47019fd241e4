"""Per-job physical-plan summary, as the jobs would plan on large inputs.

Broadcast joins by size are disabled (autoBroadcastJoinThreshold=-1), so every
join the planner would only broadcast because the test tables are small shows
up as the shuffle join it becomes at scale; explicit broadcasts (bounded
dimensions, one-row tables) stay.  Prints a markdown table.

usage: python tools/plan_report.py [sf_dir] [--bucketed]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("simple")
    return buf.getvalue()


def summarize(text: str) -> dict:
    lines = text.splitlines()
    ex = [l for l in lines if "Exchange " in l and "BroadcastExchange" not in l and "ReusedExchange" not in l]
    return {
        "hash": sum("hashpartitioning" in l for l in ex),
        "range": sum("rangepartitioning" in l for l in ex),
        "single": sum("SinglePartition" in l for l in ex),
        "bhj": sum("BroadcastHashJoin" in l for l in lines),
        "smj": sum("SortMergeJoin" in l for l in lines),
        "bnlj": sum("BroadcastNestedLoopJoin" in l for l in lines),
        "partial_agg": sum(bool(re.search(r"HashAggregate\(keys=.*functions=\[partial_", l)) for l in lines),
        "wgl": sum("WindowGroupLimit" in l for l in lines),
        "python": any(k in text for k in ("EvalPython", "InPandas", "PythonUDF")),
        "single_keys": [re.sub(r"#\d+L?", "", l.strip())[:80] for l in ex if "SinglePartition" in l],
    }


def main(argv):
    sf_dir = next((a for a in argv[1:] if a.startswith("/")), "/root/testdata/sf0.01")
    from tillroll import catalog
    from tillroll.session import build_session
    from tillroll.sources.testbind import TestShop
    spark = build_session("local[8]", 8, extra={"spark.sql.autoBroadcastJoinThreshold": "-1"})
    shop = TestShop(spark, sf_dir)
    title = "test binding"
    if "--bucketed" in argv:
        from tillroll.sources.landing import ORDER_KEYED, ParquetShop, write_table
        raw = tempfile.mkdtemp(prefix="plan-report-") + "/raw"
        for name, df in {**shop.all_tables(), "orders": shop.orders()}.items():
            write_table(df, raw, name, bucket_by=("order_id", 8) if name in ORDER_KEYED else None,
                        database="raw_report")      # registers every table
        shop = ParquetShop(spark, raw, database="raw_report")
        title = "bucketed landed layer"
    print(f"Plans on the {title}, size-based broadcast disabled.\n")
    print("| job | hash exch. | range exch. | single-partition exch. | SMJ | BHJ | partial aggs | group limits |")
    print("|---|---|---|---|---|---|---|---|")
    for name in catalog.job_names():
        s = summarize(plan(catalog.run_on(shop, name)))
        assert not s["python"], name
        print(f"| {name} | {s['hash']} | {s['range']} | {s['single']} | {s['smj']} | {s['bhj']} | "
              f"{s['partial_agg']} | {s['wgl']} |")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
