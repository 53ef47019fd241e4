"""Monthly and category revenue (delivered orders; revenue = item price, freight excluded)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.numeric import exact_round, exact_sum, pct, ratio, share_of_total
from tillroll.functions.temporal import month_start
from tillroll.model import DELIVERED
from tillroll.operators.blocks import delivered_orders, order_revenue, spread, with_category


def _delivered_month(orders: DataFrame, status: str) -> DataFrame:
    return delivered_orders(orders, status).select(
        "order_id", "customer_id", month_start("order_purchase_timestamp").alias("order_month"))


def monthly_totals(orders: DataFrame, items: DataFrame, status: str = DELIVERED) -> DataFrame:
    """Per month: orders, distinct customers (``customer_id``), revenue, items, freight.

    Items are summed per order first; the inner join then drops delivered
    orders without items.  ``order_id`` is the orders key, so after the
    per-order aggregate a row count is the distinct order count.
    """
    joined = _delivered_month(orders, status).join(order_revenue(items), "order_id")
    return joined.groupBy("order_month").agg(
        F.count(F.lit(1)).alias("orders_count"),
        F.countDistinct("customer_id").alias("customers_count"),
        F.sum("order_item_revenue").alias("revenue"),
        F.sum("items_count").alias("total_items"),
        F.sum("order_freight").alias("total_freight"))


def monthly_metrics(orders: DataFrame, items: DataFrame, status: str = DELIVERED) -> DataFrame:
    """Monthly KPIs with month-over-month change.

    "Previous month" is the previous month *present* in the data (gaps are
    not filled); the first month has NULL changes.  The window runs over the
    month rows only.
    """
    m = monthly_totals(orders, items, status)
    w = Window.orderBy(F.asc_nulls_last("order_month"))
    prev_rev, prev_cnt = F.lag("revenue").over(w), F.lag("orders_count").over(w)
    return (m.select(
        "order_month", "orders_count", "customers_count",
        exact_round("revenue", 2).alias("revenue"),
        ratio("revenue", "orders_count", 2).alias("avg_order_value"),
        ratio("total_items", "orders_count", 2).alias("avg_items_per_order"),
        ratio("total_freight", "orders_count", 2).alias("avg_freight_per_order"),
        pct(F.col("revenue") - prev_rev, prev_rev, 2).alias("revenue_mom_pct"),
        pct(F.col("orders_count") - prev_cnt, prev_cnt, 2).alias("orders_mom_pct"))
        .orderBy(F.asc_nulls_last("order_month")))


def chart_monthly_revenue(orders: DataFrame, items: DataFrame, status: str = DELIVERED) -> DataFrame:
    """Chart data: ``order_month, orders_count, revenue``."""
    joined = _delivered_month(orders, status).join(
        items.groupBy("order_id").agg(exact_sum(items, "price").alias("revenue")), "order_id")
    return (joined.groupBy("order_month")
                  .agg(F.count(F.lit(1)).alias("orders_count"),
                       exact_round(F.sum("revenue"), 2).alias("revenue"))
                  .orderBy(F.asc_nulls_last("order_month")))


# Orders of a customer are dealt into so many groups before the customer is counted.
ORDER_GROUPS = 1 << 8


def _delivered_items(orders: DataFrame, items: DataFrame, status: str) -> DataFrame:
    """Items of delivered orders, with the order's customer.

    The items stream past a hash table of their partition's delivered orders (unique by
    key), so a task neither sorts nor holds item rows.  Aggregating the items before this
    join would keep nearly every item row of a scan split in memory: a product seldom
    comes twice in an order.  The partition of a hot order is split by AQE, as nothing
    downstream reuses this partitioning.
    """
    d = delivered_orders(orders, status).select(F.col("order_id").alias("_oid"), "customer_id")
    sold = items.select("order_id", "product_id", "price", "freight_value")
    return sold.join(d.hint("shuffle_hash"), sold.order_id == F.col("_oid"), "inner").drop("_oid")


def _category_customers(orders, items, products, translation, status) -> DataFrame:
    """Delivered item revenue and orders per (category, customer).

    Nearly every group is a row or two, so map-side aggregates would only fill memory.
    The rows are dealt out first (``spread``) and each task aggregates a small partition:
    items by (order, product), so that a hot order shrinks to its products; lines by
    (category, customer, group of orders), so that a hot customer's orders spread over
    all tasks and shrink to ``ORDER_GROUPS`` rows a category; those by (category, customer).
    """
    keys = ["order_id", "customer_id", "product_id"]
    delivered = _delivered_items(orders, items, status)
    sold = spread(delivered, *keys).groupBy(*keys).agg(
        exact_sum(delivered, "price").alias("rev"), F.count("price").alias("n_price"),
        exact_sum(delivered, "freight_value").alias("freight"), F.count("freight_value").alias("n_freight"))
    sums = [F.sum(c).alias(c) for c in ("rev", "n_price", "freight", "n_freight")]
    lines = with_category(sold, products, translation).withColumn(
        "_orders", F.pmod(F.xxhash64("order_id"), F.lit(ORDER_GROUPS)))
    keys = ["category", "customer_id", "_orders"]
    per_group = (spread(lines, *keys).groupBy(*keys, "order_id").agg(*sums)
                 .groupBy(*keys).agg(*sums, F.count(F.lit(1)).alias("orders")))
    keys = ["category", "customer_id"]
    return spread(per_group, *keys).groupBy(*keys).agg(*sums, F.sum("orders").alias("orders"))


def category_revenue(orders: DataFrame, items: DataFrame, products: DataFrame,
                     translation: DataFrame, status: str = DELIVERED) -> DataFrame:
    """Revenue, orders, customers, averages, share and dense rank per category.

    An order counts once in each of its categories.  Distinct orders and
    customers are counted by grouping (category, customer) first, so no
    ``Expand`` of the fact rows is needed.
    """
    per_cust = _category_customers(orders, items, products, translation, status)
    cat = per_cust.groupBy("category").agg(
        F.sum("rev").alias("revenue"), F.sum("orders").alias("orders_count"),
        F.count("customer_id").alias("customers_count"),
        F.sum("n_price").alias("n_price"), F.sum("freight").alias("freight"),
        F.sum("n_freight").alias("n_freight"))
    # Category rows only from here on.
    return (cat.select(
        "category",
        exact_round("revenue", 2).alias("revenue"),
        "orders_count", "customers_count",
        ratio("revenue", "orders_count", 2).alias("avg_order_value"),
        ratio("revenue", "n_price", 2).alias("avg_item_price"),
        ratio("freight", "n_freight", 2).alias("avg_freight"),
        share_of_total("revenue", 2).alias("revenue_share_pct"),
        F.dense_rank().over(Window.orderBy(F.desc_nulls_first("revenue"))).cast("long").alias("revenue_rank"),
        F.col("revenue").alias("_raw_revenue"))
        .orderBy(F.desc_nulls_first("_raw_revenue"), "category").drop("_raw_revenue"))


def chart_top_categories(orders: DataFrame, items: DataFrame, products: DataFrame,
                         translation: DataFrame, status: str = DELIVERED, n: int = 10) -> DataFrame:
    """Chart data: the ``n`` categories with the highest (rounded) revenue."""
    delivered = _delivered_items(orders, items, status)
    lines = with_category(delivered.groupBy("product_id").agg(exact_sum(delivered, "price").alias("rev")),
                          products, translation)
    return (lines.groupBy("category").agg(exact_round(F.sum("rev"), 2).alias("revenue"))
                 .orderBy(F.desc_nulls_first("revenue"), "category").limit(n))
