"""Repeat purchases, top customers and RFM segmentation.

A customer is ``customer_unique_id``; only delivered orders count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.numeric import exact_round, exact_sum, pct, ratio, share_of_total
from tillroll.functions.temporal import MICROS_PER_DAY, fractional_days, whole_days
from tillroll.model import DELIVERED
from tillroll.operators import materialize
from tillroll.operators.blocks import customer_key, delivered_orders
from tillroll.operators.ranking import ntile_buckets, summarize_with_percentile


def orders_per_customer(orders: DataFrame, customers: DataFrame, status: str = DELIVERED) -> DataFrame:
    """``customer_unique_id, orders_count`` over delivered orders (with or without items).

    Orders are counted per ``customer_id`` before the join, so a customer
    with a huge number of orders is one row when the join shuffles.
    """
    per_id = (delivered_orders(orders, status).groupBy("customer_id")
              .agg(F.count(F.lit(1)).alias("n")))
    return (customer_key(per_id, customers, "n")
            .groupBy("customer_unique_id").agg(F.sum("n").alias("orders_count")))


def repeat_customer_metrics(orders: DataFrame, customers: DataFrame, status: str = DELIVERED) -> DataFrame:
    opc = orders_per_customer(orders, customers, status)
    g = opc.agg(F.count(F.lit(1)).alias("total_customers"),
                F.count_if(F.col("orders_count") >= 2).alias("repeat_customers"),
                F.sum("orders_count").alias("_orders"),
                F.max("orders_count").alias("max_orders_single_customer"))
    return g.select(
        "total_customers", "repeat_customers",
        pct("repeat_customers", "total_customers", 2).alias("repeat_rate_pct"),
        ratio("_orders", "total_customers", 3).alias("avg_orders_per_customer"),
        "max_orders_single_customer")


def orders_per_customer_distribution(orders: DataFrame, customers: DataFrame,
                                     status: str = DELIVERED) -> DataFrame:
    """Histogram ``orders_count, customers, pct`` (an aggregate of an aggregate)."""
    opc = orders_per_customer(orders, customers, status)
    h = opc.groupBy("orders_count").agg(F.count(F.lit(1)).alias("customers"))
    return (h.select("orders_count", "customers",
                     share_of_total("customers", 2).alias("pct"))
             .orderBy(F.asc_nulls_last("orders_count")))


def _first_two(df: DataFrame, key: str) -> DataFrame:
    """The first two rows per ``key`` by (purchase time, order id), numbered 1 and 2.

    The ``row_number() <= 2`` filter is planned as a ``WindowGroupLimit`` that
    also runs before the shuffle, so a key with very many orders contributes
    at most two rows per map task.
    """
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last("order_purchase_timestamp"),
                                        F.asc_nulls_last("order_id"))
    return df.withColumn("order_seq", F.row_number().over(w)).where(F.col("order_seq") <= 2)


def first_two_purchase_gaps(orders: DataFrame, customers: DataFrame, status: str = DELIVERED) -> DataFrame:
    """``customer_unique_id, days``: days from the first to the second delivered purchase.

    The first two orders of a customer are among the first two of one of its
    ``customer_id`` s, so orders are cut to two per ``customer_id`` before the
    join to customers (a hot account never reaches the join), and to two per
    customer after it.  The gap is taken from the two numbered rows, as
    ``LAG`` over the same ordering would.
    """
    d = delivered_orders(orders, status).select("order_id", "customer_id", "order_purchase_timestamp")
    per_account = _first_two(d, "customer_id").drop("order_seq")
    two = _first_two(customer_key(per_account, customers, "order_id", "order_purchase_timestamp"),
                     "customer_unique_id")
    per = two.groupBy("customer_unique_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by("order_purchase_timestamp", "order_seq").alias("_first"),
        F.max_by("order_purchase_timestamp", "order_seq").alias("_second"))
    return per.where(F.col("_n") == 2).select(
        "customer_unique_id", fractional_days("_second", "_first").alias("days"))


def days_between_first_two_orders(orders: DataFrame, customers: DataFrame,
                                  status: str = DELIVERED) -> DataFrame:
    # The gaps come out of two joins and two windows and are read twice: materialised once.
    gaps = materialize(first_two_purchase_gaps(orders, customers, status))
    return summarize_with_percentile(
        gaps, [exact_round(F.avg("days"), 1).alias("avg_days_between"),
               exact_round(F.min("days"), 1).alias("min_days"),
               exact_round(F.max("days"), 1).alias("max_days")],
        "days", 0.5, "median_days", per_unit=MICROS_PER_DAY, materialized=True)


def customer_revenue(orders: DataFrame, customers: DataFrame, items: DataFrame,
                     status: str = DELIVERED) -> DataFrame:
    """Per customer over delivered orders *with items*: last purchase, orders, item revenue.

    Items are summed per order, orders per ``customer_id``; only then are the
    accounts mapped to customers.  Every join input is at most one row per
    key, so no join partition can be dominated by one hot key.
    """
    rev = items.groupBy("order_id").agg(exact_sum(items, "price").alias("rev"))
    d = delivered_orders(orders, status).select(
        F.col("order_id").alias("_oid"), "customer_id", "order_purchase_timestamp")
    per_account = (d.join(rev, F.col("_oid") == rev.order_id, "inner")
                    .groupBy("customer_id")
                    .agg(F.max("order_purchase_timestamp").alias("last_purchase"),
                         F.count(F.lit(1)).alias("frequency"),
                         F.sum("rev").alias("revenue")))
    return (customer_key(per_account, customers, "last_purchase", "frequency", "revenue")
            .groupBy("customer_unique_id")
            .agg(F.max("last_purchase").alias("last_purchase"),
                 F.sum("frequency").alias("frequency"),
                 F.sum("revenue").alias("revenue")))


def top_customers_by_revenue(orders: DataFrame, customers: DataFrame, items: DataFrame,
                             status: str = DELIVERED, n: int = 10) -> DataFrame:
    cr = customer_revenue(orders, customers, items, status)
    return (cr.select("customer_unique_id", F.col("frequency").alias("orders_count"),
                      exact_round("revenue", 2).alias("total_revenue"))
              .orderBy(F.desc_nulls_first("total_revenue"), "customer_unique_id").limit(n))


# -- RFM ---------------------------------------------------------------------------

def rfm_base(orders: DataFrame, customers: DataFrame, items: DataFrame,
             status: str = DELIVERED, ref_date=None) -> DataFrame:
    """``customer_unique_id, recency_days, frequency, monetary``.

    The reference date defaults to the latest delivered purchase (over all
    delivered orders, also those without items): a scalar subquery.  ``monetary`` keeps its exact decimal.
    """
    if ref_date is None:
        ref = (delivered_orders(orders, status)
               .agg(F.max("order_purchase_timestamp").cast("timestamp_ntz")).scalar())
    else:
        text = ref_date if isinstance(ref_date, str) else ref_date.isoformat(sep=" ")
        ref = F.lit(text).cast("timestamp_ntz")         # zone-less wall clock, exact to the microsecond
    cr = customer_revenue(orders, customers, items, status)
    return cr.select(
        "customer_unique_id",
        whole_days(ref, "last_purchase").alias("recency_days"),
        "frequency",
        F.round("revenue", 2).alias("monetary"))


# Quintile orderings: 5 is best (recent, frequent, high spend).  The customer id
# is the final key so that the many tied customers split repeatably.
# Score -> (metric, descending).
RFM_ORDER = {"r_score": ("recency_days", True), "f_score": ("frequency", False), "m_score": ("monetary", False)}


def rfm_scores(base: DataFrame, k: int = 5, scores: tuple[str, ...] = tuple(RFM_ORDER)) -> DataFrame:
    """Add ``scores`` (by default ``r_score, f_score, m_score``) = ``NTILE(k)`` over each metric.

    The base is materialised once; the scores come from the boundary rows of the
    buckets, so no customer row is shuffled for them.
    """
    b = materialize(base.withColumn("monetary", F.col("monetary").cast("decimal(18,2)")))
    return ntile_buckets(b, k, {s: RFM_ORDER[s] for s in scores}, "customer_unique_id")


# Segment rules, checked in this order (the F score is not used).
SEGMENT_RULES = (
    ("Champions", "r_score >= 4 AND m_score >= 4"),
    ("Loyal Customers", "r_score >= 3 AND m_score >= 3"),
    ("Potential Loyalists", "r_score >= 4 AND m_score < 3"),
    ("At Risk", "r_score <= 2 AND m_score >= 3"),
)
DEFAULT_SEGMENT = "Hibernating"


def rfm_segments(scored: DataFrame) -> DataFrame:
    seg = None
    for name, rule in SEGMENT_RULES:
        seg = (F.when(F.expr(rule), name) if seg is None else seg.when(F.expr(rule), name))
    return scored.withColumn("segment", seg.otherwise(DEFAULT_SEGMENT))


def rfm_segment_summary(segments: DataFrame) -> DataFrame:
    g = segments.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("monetary").alias("_m"), F.count("monetary").alias("_mn"),
        F.sum("frequency").alias("_f"), F.count("frequency").alias("_fn"),
        F.sum("recency_days").alias("_r"), F.count("recency_days").alias("_rn"))
    return (g.select(
        "segment", "customers",
        share_of_total("customers", 2).alias("pct_customers"),
        ratio("_m", "_mn", 2).alias("avg_revenue_per_customer"),
        ratio("_f", "_fn", 2).alias("avg_orders"),
        ratio("_r", "_rn", 0).alias("avg_recency_days"),
        exact_round("_m", 2).alias("total_revenue"))
        .orderBy(F.desc_nulls_first("total_revenue"), "segment"))
