"""One-row business summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numeric import exact_round, exact_sum, pct, ratio
from tillroll.model import DELIVERED
from tillroll.operators.blocks import customer_key, delivered_orders


def business_summary(orders: DataFrame, customers: DataFrame, items: DataFrame,
                     reviews: DataFrame, status: str = DELIVERED) -> DataFrame:
    """Revenue, orders, customers, order value, repeat rate, late rate, review score.

    Revenue, order, lateness and review figures cover delivered orders *with
    items*; the repeat rate covers all delivered orders.  Everything comes
    from one pass: order-level facts (revenue and review pre-aggregated per
    order) are folded per customer, then per whole table.  The uncorrelated
    sub-queries of a literal SQL translation would scan the orders twice more.
    """
    d = delivered_orders(orders, status).select(
        "order_id", "customer_id", "order_delivered_customer_date", "order_estimated_delivery_date")
    rev = items.groupBy("order_id").agg(exact_sum(items, "price").alias("rev"), F.count(F.lit(1)).alias("_n_items"))
    score = reviews.groupBy("order_id").agg(F.avg(F.col("review_score").cast("double")).alias("score"))
    # Order grain: the three inputs share the order key, so they meet in one co-partitioned join.
    j = d.join(rev, "order_id", "left").join(score, "order_id", "left")
    has = F.col("_n_items").isNotNull()
    dd, ed = F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")
    per_account = j.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("freq"),
        F.count_if(has).alias("orders_with_items"),
        F.sum("rev").alias("rev"),
        F.count_if(has & (dd > ed)).alias("late"),
        F.count_if(has & dd.isNotNull() & ed.isNotNull()).alias("dated"),
        F.sum(F.when(has, F.col("score"))).alias("score_sum"),
        F.count(F.when(has, F.col("score"))).alias("score_n"))
    # Accounts -> customers only after the per-account aggregate (one row per account).
    per_cust = (customer_key(per_account, customers, "freq", "orders_with_items", "rev", "late",
                             "dated", "score_sum", "score_n")
                .groupBy("customer_unique_id")
                .agg(*[F.sum(c).alias(c) for c in ("freq", "orders_with_items", "rev", "late",
                                                   "dated", "score_sum", "score_n")]))
    t = per_cust.agg(
        F.sum("rev").alias("rev"),
        F.sum("orders_with_items").alias("orders"),
        F.count_if(F.col("orders_with_items") > 0).alias("customers"),
        F.count_if(F.col("freq") >= 2).alias("repeat"),
        F.count(F.lit(1)).alias("all_customers"),
        F.sum("late").alias("late"), F.sum("dated").alias("dated"),
        F.sum("score_sum").alias("score_sum"), F.sum("score_n").alias("score_n"))
    return t.select(
        exact_round("rev", 2).alias("total_revenue"),
        F.coalesce("orders", F.lit(0)).alias("delivered_orders"),
        F.col("customers").alias("unique_customers"),
        ratio("rev", "orders", 2).alias("avg_order_value"),
        pct("repeat", "all_customers", 2).alias("repeat_purchase_rate_pct"),
        pct("late", "dated", 2).alias("late_delivery_rate_pct"),
        exact_round(F.col("score_sum") / F.nullif(F.col("score_n"), F.lit(0)), 3).alias("avg_review_score"))
