"""Integrity and data-quality checks (keys, references, nulls, value ranges).

Spark enforces no constraints, so the declared keys of the landing model are
verified by jobs.  Every check is a single scan with partial aggregation; the
anti joins are written as ``left_anti`` (an outer join followed by ``IS NULL``
is not rewritten by the optimizer).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numeric import exact_round, share_of_total


def _n(expr_name: str):
    return F.count(F.lit(1)).alias(expr_name)


# -- generic constraint checks ------------------------------------------------

def check_unique(df: DataFrame, keys: Sequence[str], count_name: str = "cnt") -> DataFrame:
    """Key values occurring more than once: ``keys..., cnt``  (``GROUP BY .. HAVING COUNT(*) > 1``)."""
    return df.groupBy(*keys).agg(_n(count_name)).where(F.col(count_name) > 1)


def check_not_null(df: DataFrame, columns: Sequence[str], table_name: str | None = None) -> DataFrame:
    """NULL count per column in one pass: ``[table_name,] column_name, null_count``."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    out = agg.selectExpr(f"stack({len(columns)}, {pairs}) AS (column_name, null_count)")
    if table_name is not None:
        out = out.select(F.lit(table_name).alias("table_name"), "*")
    return out


def check_foreign_key(child: DataFrame, columns: Sequence[str], parent: DataFrame,
                      parent_columns: Sequence[str] | None = None,
                      count_name: str = "orphan_rows") -> DataFrame:
    """Referencing values with no parent row: ``columns..., orphan_rows``.

    Rows with a NULL in the reference are not checked (SQL ``MATCH SIMPLE``).
    The child is aggregated to distinct reference values before the anti join,
    so a hot value crosses the shuffle once.
    """
    parent_columns = list(parent_columns or columns)
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    keys = child.where(present).groupBy(*columns).agg(_n(count_name))
    p = parent.select(*[F.col(pc).alias(f"_p{i}") for i, pc in enumerate(parent_columns)])
    cond = [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(columns)]
    return keys.join(p, cond, "left_anti")


# -- data-quality report --------------------------------------------------------

def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, row_count`` for each named table, sorted by name."""
    parts = [df.agg(_n("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("table_name")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return check_unique(df, [key], "cnt")


def duplicate_review_ids(reviews: DataFrame) -> DataFrame:
    """``total_reviews, distinct_review_ids, duplicate_review_ids``.

    The distinct count is a two-level aggregate: distinct ids per task, then a
    count of the shuffled ids.
    """
    per_id = reviews.groupBy("review_id").agg(_n("_c"))
    return per_id.agg(F.sum("_c").cast("long").alias("total_reviews"),
                      F.count("review_id").alias("distinct_review_ids")) \
                 .select(F.coalesce("total_reviews", F.lit(0)).alias("total_reviews"),
                         "distinct_review_ids",
                         (F.coalesce("total_reviews", F.lit(0)) - F.col("distinct_review_ids"))
                         .alias("duplicate_review_ids"))


def order_nulls(orders: DataFrame) -> DataFrame:
    return orders.agg(
        F.count_if(F.col("order_status").isNull()).alias("null_status"),
        F.count_if(F.col("order_purchase_timestamp").isNull()).alias("null_purchase"),
        F.count_if(F.col("order_approved_at").isNull()).alias("null_approved"),
        F.count_if(F.col("order_delivered_customer_date").isNull()).alias("null_delivered"))


def products_without_category(products: DataFrame) -> DataFrame:
    return products.where(F.col("product_category_name").isNull()).agg(_n("products_without_category"))


def status_distribution(orders: DataFrame) -> DataFrame:
    """``order_status, cnt, pct`` by count, largest first."""
    g = orders.groupBy("order_status").agg(_n("cnt"))
    return (g.select("order_status", "cnt", share_of_total("cnt", 2).alias("pct"))
             .orderBy(F.desc("cnt"), F.asc_nulls_last("order_status")))


def orders_without(orders: DataFrame, other: DataFrame, name: str, key: str = "order_id") -> DataFrame:
    """Count of orders with no row in ``other`` (NULL keys count as missing)."""
    o = orders.select(key)
    # Distinct keys of the other side: a hot order crosses the shuffle once.
    k = other.select(F.col(key).alias("_k")).distinct()
    return o.join(k, o[key] == F.col("_k"), "left_anti").agg(_n(name))


def delivered_before_purchase(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("order_delivered_customer_date") < F.col("order_purchase_timestamp")) \
                 .agg(_n("delivered_before_purchase"))


def item_money(items: DataFrame) -> DataFrame:
    return items.agg(F.count_if(F.col("price") <= 0).alias("non_positive_price"),
                     F.count_if(F.col("freight_value") < 0).alias("negative_freight"))


def payment_money(payments: DataFrame) -> DataFrame:
    return payments.where(F.col("payment_value") <= 0).agg(_n("non_positive_payment"))


def reviews_without_order(reviews: DataFrame, orders: DataFrame) -> DataFrame:
    """Reviews whose order does not exist; a NULL ``order_id`` counts as missing.

    Reviews are first reduced to one row per referenced order, so only
    distinct order ids are shuffled against the orders table.
    """
    per_order = reviews.groupBy("order_id").agg(_n("_c"))
    o = orders.select(F.col("order_id").alias("_k"))
    return per_order.join(o, per_order.order_id == F.col("_k"), "left_anti") \
                    .agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("reviews_without_order"))


def purchase_range(orders: DataFrame) -> DataFrame:
    return orders.agg(F.min("order_purchase_timestamp").alias("first_order"),
                      F.max("order_purchase_timestamp").alias("last_order"))
