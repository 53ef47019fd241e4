"""Hot keys: one customer, one order and one product each hold a third of the rows.

The skewed tables are derived by Spark from the driver's tables; every job must
still equal its SQL version, and the customer joins must only ever see one row
per account (pre-aggregated), whatever the share of the hot account.
"""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from tests.edge_data import FrameShop
from tests.oracle import canon
from tests.plan_utils import plan_text
from tillroll import catalog
from tillroll.oracle_sql import oracle_bodies
from tillroll.plans import customers as C
from tillroll.sources.testbind import TestShop

_state = {}


def _skewed(spark, tmp):
    if "shop" in _state:
        return _state["shop"], _state["con"]
    s = TestShop(spark, SF001)
    hot_customer = s.customers().agg(F.min("customer_id")).first()[0]
    hot_order = s.orders().agg(F.min("order_id")).first()[0]
    hot_product = s.products().agg(F.min("product_id")).first()[0]
    t = {n: df for n, df in s.all_tables().items()}
    o = s.orders()
    t["orders"] = o.withColumn("customer_id", F.when(F.col("order_id") % 3 == 0, F.lit(hot_customer))
                               .otherwise(F.col("customer_id")))
    i = t["order_items"]
    t["order_items"] = (i.withColumn("order_id", F.when(F.col("order_item_id") % 3 == 0, F.lit(hot_order))
                                     .otherwise(F.col("order_id")))
                         .withColumn("product_id", F.when(F.col("order_id") % 3 == 1, F.lit(hot_product))
                                     .otherwise(F.col("product_id"))))
    con = duckdb.connect()
    frames = {}
    for name, df in t.items():
        path = f"{tmp}/{name}"
        df.write.mode("overwrite").parquet(path)
        frames[name] = spark.read.parquet(path)
        con.execute(f"CREATE VIEW raw_{name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    _state.update(shop=FrameShop(frames), con=con)
    return _state["shop"], con


@pytest.mark.parametrize("name", catalog.job_names())
def test_skewed_job_matches_sql(spark, tmpdir_fresh, name):
    shop, con = _skewed(spark, tmpdir_fresh)
    got = catalog.run_on(shop, name).toPandas()
    want = con.execute(oracle_bodies()[name]).df()
    assert canon(got) == canon(want)


def test_hot_account_reaches_customer_join_as_one_row(spark, tmpdir_fresh):
    shop, _ = _skewed(spark, tmpdir_fresh)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cr = C.customer_revenue(shop.orders(), shop.customers(), shop.order_items())
        text = plan_text(cr, "simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    # The join on customer_id takes the per-account aggregate as its order-side input.
    join_at = next(i for i, l in enumerate(text.splitlines()) if "SortMergeJoin" in l and "customer_id" in l)
    below = "\n".join(text.splitlines()[join_at:join_at + 6])
    assert "HashAggregate(keys=[customer_id" in below


def test_null_keys_of_a_lookup_are_spread(spark):
    """A third of the rows has no key: without broadcasts and without AQE every task still gets its share."""
    from tillroll.operators.blocks import left_lookup
    n, parts = 60_000, 16
    df = spark.range(n).select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 5000).alias("product_id"))
    dim = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("double"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(parts)}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        joined = left_lookup(df, "product_id", dim, "k")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        rows = joined.collect()
        plan = plan_text(joined, "simple")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin" in plan and len(sizes) == parts and max(sizes) < 1.5 * n / parts
    assert joined.columns == ["id", "product_id", "k", "double"] and len(rows) == n
    assert all(r.double == (2 * r.product_id if r.product_id is not None and r.product_id < 4000 else None) for r in rows)


def test_category_counts_with_hot_order_and_hot_customer(spark):
    """A hot order comes as one order of each category, a hot customer as one customer; rows without a customer count as orders only."""
    from decimal import Decimal
    from tillroll.plans.sales import category_revenue
    orders = spark.range(3_000).select(F.col("id").alias("order_id"), F.when(F.col("id") % 10 == 9, None).when(F.col("id") % 3 == 0, 7)
                                       .otherwise(F.col("id")).alias("customer_id"),
                                       F.when(F.col("id") % 5 == 4, "shipped").otherwise("delivered").alias("order_status"))
    items = spark.range(12_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 3_000).alias("order_id"), (F.col("id") % 50).alias("product_id"),
                                       F.when(F.col("id") % 7 != 0, Decimal("1.25")).cast("decimal(12,2)").alias("price"),
                                       F.lit(Decimal("0.10")).cast("decimal(12,2)").alias("freight_value"))
    products = spark.range(40).select(F.col("id").alias("product_id"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("p"), F.col("id") % 4)).alias("product_category_name"))
    translation = spark.createDataFrame([("p1", "one")], "product_category_name string, product_category_name_english string")
    got = {r.category: r for r in category_revenue(orders, items, products, translation).collect()}
    raw = items.join(orders.where("order_status = 'delivered'"), "order_id").join(products, "product_id", "left").select(
        F.when(F.col("product_category_name") == "p1", "one").otherwise(F.coalesce("product_category_name", F.lit("unknown"))).alias("category"),
        "order_id", "customer_id", "price").collect()
    assert set(got) == {r.category for r in raw} == {"one", "p2", "p3", "unknown"}
    for c, row in got.items():
        mine = [r for r in raw if r.category == c]
        assert row.orders_count == len({r.order_id for r in mine})
        assert row.customers_count == len({r.customer_id for r in mine} - {None})
        assert row.revenue == float(sum(r.price for r in mine if r.price is not None))
