"""Delivery times, lateness and their relation to review scores.

Only delivered orders with both a delivery date and an estimate are used;
``delay_days`` = delivered - estimated in fractional days, ``> 0`` is late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numeric import exact_round, pct, share_of_total
from tillroll.functions.temporal import MICROS_PER_DAY
from tillroll.model import DELIVERED
from tillroll.operators import materialize
from tillroll.operators.blocks import (delivery_times, first_item_per_order, order_review,
                                       with_category)
from tillroll.operators.ranking import summarize_with_percentile



def _late():
    return F.col("delay_days") > 0


def delivery_performance(orders: DataFrame, status: str = DELIVERED) -> DataFrame:
    """Counts, averages, exact median delivery time and late share.

    The two numbers of each order are materialised once; the aggregates and the
    median's selection read them from there.
    """
    dt = materialize(delivery_times(orders, status).select("delivery_days", "delay_days"))
    s = summarize_with_percentile(
        dt, [F.count(F.lit(1)).alias("delivered_orders"),
             exact_round(F.avg("delivery_days"), 1).alias("avg_delivery_days"),
             F.count_if(_late()).alias("late_orders"),
             F.avg("delay_days").alias("_avg_delay")],
        "delivery_days", 0.5, "_median", per_unit=MICROS_PER_DAY, materialized=True)
    return s.select(
        "delivered_orders", "avg_delivery_days",
        exact_round("_median", 1).alias("median_delivery_days"),
        "late_orders",
        pct("late_orders", "delivered_orders", 2).alias("late_rate_pct"),
        exact_round("_avg_delay", 1).alias("avg_delay_days"))


def _reviewed_delivery(orders, reviews, status, rounded=False) -> DataFrame:
    """Delivered orders with their per-order review score (unreviewed orders drop out)."""
    dt = delivery_times(orders, status).select("order_id", "delay_days")
    return dt.join(order_review(reviews, rounded), "order_id", "inner")


def review_score_by_delivery_group(orders: DataFrame, reviews: DataFrame,
                                   status: str = DELIVERED) -> DataFrame:
    j = _reviewed_delivery(orders, reviews, status)
    group = (F.when(F.col("delay_days") < 0, "early")
              .when(F.col("delay_days") == 0, "on_time").otherwise("late"))
    g = j.groupBy(group.alias("delivery_group")).agg(
        F.count(F.lit(1)).alias("orders"),
        exact_round(F.avg("review_score"), 3).alias("avg_review_score"))
    return (g.select("delivery_group", "orders", "avg_review_score",
                     share_of_total("orders", 2).alias("pct_of_orders"))
             .orderBy(F.desc_nulls_first("avg_review_score"), "delivery_group"))


def score_distribution_by_delivery(orders: DataFrame, reviews: DataFrame,
                                   status: str = DELIVERED) -> DataFrame:
    """Rounded per-order score x {on time or early, late}: a two-column pivot by conditional counts."""
    j = _reviewed_delivery(orders, reviews, status, rounded=True)
    return (j.groupBy("review_score").agg(
                F.count_if(~_late()).alias("on_time_or_early"),
                F.count_if(_late()).alias("late"))
             .orderBy(F.asc_nulls_last("review_score")))


def chart_delivery_reviews(orders: DataFrame, reviews: DataFrame, status: str = DELIVERED) -> DataFrame:
    """Chart data: 'Late' versus 'On time / Early' orders and their average score."""
    j = _reviewed_delivery(orders, reviews, status)
    group = F.when(_late(), "Late").otherwise("On time / Early")
    return (j.groupBy(group.alias("delivery_group"))
             .agg(F.count(F.lit(1)).alias("orders"),
                  exact_round(F.avg("review_score"), 3).alias("avg_review_score"))
             .orderBy(F.desc_nulls_first("avg_review_score"), "delivery_group"))


def order_category(items: DataFrame, products: DataFrame, translation: DataFrame) -> DataFrame:
    """Category of each order = category of its first item."""
    return with_category(first_item_per_order(items), products, translation).select("order_id", "category")


def category_delay_top10(orders: DataFrame, items: DataFrame, products: DataFrame,
                         translation: DataFrame, status: str = DELIVERED,
                         min_orders: int = 100, n: int = 10) -> DataFrame:
    """Categories (of at least ``min_orders`` orders) with the largest average delay.

    The first item per order is an aggregate on the order key, so it joins the
    delivery times without another shuffle of the items; only the surviving
    delivered orders then look up their category.
    """
    dt = delivery_times(orders, status).select("order_id", "delay_days")
    first = first_item_per_order(items)
    j = with_category(first.join(dt, "order_id", "inner"), products, translation)
    g = j.groupBy("category").agg(
        F.count(F.lit(1)).alias("orders"),
        exact_round(F.avg("delay_days"), 2).alias("avg_delay_days"),
        F.count_if(_late()).alias("_late"))
    return (g.where(F.col("orders") >= min_orders)
             .select("category", "orders", "avg_delay_days",
                     pct("_late", "orders", 2).alias("late_rate_pct"))
             .orderBy(F.desc_nulls_first("avg_delay_days"), "category").limit(n))
