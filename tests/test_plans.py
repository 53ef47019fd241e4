"""Plan shape: the physical plans the jobs are designed to get."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF001
from tests.plan_utils import plan_text
from tillroll import catalog
from tillroll.plans import customers as C
from tillroll.sources.landing import ParquetShop, write_table
from tillroll.sources.testbind import TestShop

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                "PythonUDF", "FlatMapCoGroupsInPandas")


@pytest.mark.parametrize("name", catalog.job_names())
def test_no_python_in_any_plan(spark, name):
    text = plan_text(E.queries()[name](spark, SF001))
    assert not any(n in text for n in PYTHON_NODES)


@pytest.mark.parametrize("name", ["dq_orders_without_items", "dq_orders_without_payments",
                                  "dq_reviews_without_order"])
def test_anti_joins(spark, name):
    assert "LeftAnti" in plan_text(E.queries()[name](spark, SF001))


def test_rfm_scores_shuffle_no_customer_rows(spark):
    """No global ntile, no sort, no exchange of the customers: boundaries come in by a scalar subquery."""
    shop = TestShop(spark, SF001)
    base = C.rfm_base(shop.orders(delivery=False), shop.customers(), shop.order_items())
    text = plan_text(C.rfm_scores(base), "simple")
    main = text.split("Subquery")[0] if "Subquery" in text else text
    assert "ntile(" not in text.lower() and "Window" not in main
    assert "Exchange" not in main and "Sort" not in main


def test_median_has_no_global_window(spark):
    shop = TestShop(spark, SF001)
    text = plan_text(catalog.run_on(shop, "exact_median_global"), "simple")
    windows = [l for l in text.splitlines() if "Window " in l or "Window [" in l]
    # by target prefix or customer; the first level has one prefix, its window is over 65,536 digit counts at most
    keys = ("prefix#", "_p#", "g#", "customer_id#", "customer_unique_id#", "digit#")
    assert windows and all(any(f"windowspecdefinition({k}" in l for k in keys) for l in windows)
    assert "Scan ExistingRDD" in text                # a plan over the materialised counts, not literals


def test_first_two_orders_limit_before_shuffle(spark):
    shop = TestShop(spark, SF001)
    gaps = C.first_two_purchase_gaps(shop.orders(delivery=False), shop.customers())
    assert "WindowGroupLimit" in plan_text(gaps)


def test_category_dimensions_broadcast_at_small_scale(spark):
    text = plan_text(E.queries()["category_revenue"](spark, SF001))
    assert text.count("BroadcastHashJoin") >= 2


@pytest.mark.parametrize("name", ["category_revenue", "chart_top_categories"])
def test_category_items_are_not_held_before_the_order_join(spark, name):
    """No map of (order, product) in the scan tasks and no sort of items: nearly every item row would stay in memory."""
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan_text(E.queries()[name](spark, SF001), "simple").splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    join_at = next(i for i, l in enumerate(lines) if "Join [order_id" in l)
    below = "\n".join(lines[join_at:next(i for i, l in enumerate(lines) if i > join_at and "o_orderkey" in l and "Scan" in l)])
    assert "ShuffledHashJoin" in lines[join_at] and "BuildRight" in lines[join_at]
    assert "Aggregate" not in below and "Sort " not in below


def test_category_customers_are_counted_in_partitions_that_stay_apart(spark):
    text = plan_text(E.queries()["category_revenue"](spark, SF001), "simple")
    dealt = [l for l in text.splitlines() if "Exchange hashpartitioning" in l and "customer_id" in l]
    assert dealt and all("REPARTITION_BY_NUM" in l for l in dealt)


def test_spread_is_not_merged_by_aqe(spark):
    from tillroll.operators.blocks import spread
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = spread(spark.range(10_000).withColumn("k", F.col("id") % 2_000), "k").groupBy("k").agg(F.count("*").alias("n"))
    rows = groups.withColumn("part", F.spark_partition_id()).collect()
    assert len(rows) == 2_000 and {r.n for r in rows} == {5}
    assert {r.part for r in rows} == set(range(n))


def test_landed_tables_push_filters_and_prune_columns(spark, tmpdir_fresh):
    shop = TestShop(spark, SF001)
    raw = f"{tmpdir_fresh}/raw"
    write_table(shop.orders(), raw, "orders")
    write_table(shop.order_items(), raw, "order_items")
    landed = ParquetShop(spark, raw)
    text = plan_text(catalog.run_on(landed, "monthly_metrics"))
    assert "EqualTo(order_status,delivered)" in text          # status filter reaches the scan
    orders_schema = [l for l in text.splitlines() if "ReadSchema" in l and "order_status" in l][0]
    assert "order_approved_at" not in orders_schema             # unused columns are not read
    items_schema = [l for l in text.splitlines() if "ReadSchema" in l and "price" in l][0]
    assert "seller_id" not in items_schema


def test_bucketed_layer_joins_orders_without_shuffle(spark, tmpdir_fresh):
    from tillroll.sources.landing import ORDER_KEYED, register_layer
    shop = TestShop(spark, SF001)
    raw = f"{tmpdir_fresh}/raw"
    tables = {**shop.all_tables(), "orders": shop.orders()}
    for name, df in tables.items():
        write_table(df, raw, name, bucket_by=("order_id", 4) if name in ORDER_KEYED else None,
                    database="raw_bucketed_test")
    # a later session only needs the catalog entries
    register_layer(spark, raw, "raw_bucketed_again", buckets=4)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # force shuffle joins
    try:
        for db in ("raw_bucketed_test", "raw_bucketed_again"):
            landed = ParquetShop(spark, raw, database=db)
            df = catalog.run_on(landed, "monthly_metrics")
            text = plan_text(df, "simple")
            exchanges = [l for l in text.splitlines() if "Exchange hashpartitioning" in l]
            assert exchanges and not any("order_id" in l for l in exchanges), exchanges
            want = catalog.run_on(shop, "monthly_metrics").collect()
            assert sorted(map(str, df.collect())) == sorted(map(str, want))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
