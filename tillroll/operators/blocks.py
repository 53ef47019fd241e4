"""Shared building blocks of the analytical jobs.

Each block brings a fact table to the grain the jobs join on (one row per
order, per order and category, ...).  Aggregating *before* a join is done by
hand on purpose: Catalyst does not push aggregates below joins, and the
pre-aggregation is what protects the joins from hot keys (an order or a
customer holding a large share of all rows collapses to one row in the
map-side partial aggregate before anything is shuffled).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numeric import exact_sum
from tillroll.functions.temporal import fractional_days
from tillroll.model import DELIVERED

UNKNOWN_CATEGORY = "unknown"


def delivered_orders(orders: DataFrame, status: str = DELIVERED, *cols: str) -> DataFrame:
    """Orders with the delivered status; the predicate reaches the Parquet scan."""
    out = orders.where(F.col("order_status") == status)
    return out.select(*cols) if cols else out


def order_revenue(items: DataFrame) -> DataFrame:
    """One row per order: item revenue, freight, item count (``order_id`` unique)."""
    return items.groupBy("order_id").agg(
        exact_sum(items, "price").alias("order_item_revenue"),
        exact_sum(items, "freight_value").alias("order_freight"),
        F.count(F.lit(1)).alias("items_count"))


def order_review(reviews: DataFrame, rounded: bool = False) -> DataFrame:
    """One average review score per order (duplicate reviews are averaged)."""
    score = F.avg(F.col("review_score").cast("double"))
    if rounded:
        # ROUND(AVG(score)) on the exact average: half away from zero (4.5 -> 5).
        score = F.round(score.cast("decimal(28,8)"), 0).cast("int")
    return reviews.groupBy("order_id").agg(score.alias("review_score"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into ``spark.sql.shuffle.partitions`` partitions that stay apart.

    For aggregates with nearly as many groups as rows.  AQE merges its own shuffle
    partitions up to 64 MB of compressed columns, which become ten times that in the
    aggregates' maps; it leaves partitions that were asked for by number.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


# Rows with a NULL key are dealt into so many groups of a lookup join.
NULL_GROUPS = 1 << 16


def left_lookup(df: DataFrame, key: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """``df LEFT JOIN dim ON key = dim_key`` in which NULL keys do not meet in one task.

    Spark keeps the rows without a key and deals them like one hot key, to a single task
    if the join shuffles.  A second join column holds a hash of the row where the key is
    NULL and 0 elsewhere, as on all rows of ``dim``: nothing else matches or is lost, the
    rows are read once, and the NULLs are spread evenly without AQE's help.
    """
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*[f"`{c}`" for c in df.columns]), F.lit(NULL_GROUPS)).cast("int")).otherwise(F.lit(0))
    left = df.withColumn("_spread", spread)
    # a literal would be folded into the condition, and the join dealt by the key alone
    right = dim.withColumn("_zero", F.pmod(F.xxhash64(dim_key), F.lit(1)).cast("int"))
    return (left.join(right, (left[key] == right[dim_key]) & (left["_spread"] == right["_zero"]), "left").drop("_spread", "_zero"))


def with_category(df: DataFrame, products: DataFrame, translation: DataFrame) -> DataFrame:
    """Attach ``category`` to rows carrying a ``product_id`` (left joins).

    Category = english name, else original name, else ``'unknown'`` (also
    for products missing from the catalogue).

    Both joins are left to the planner: a broadcast when the scan statistics (or
    the sizes AQE measures) are under ``spark.sql.autoBroadcastJoinThreshold``,
    otherwise a sort-merge join whose skewed partitions (a best-selling product)
    AQE splits at run time.  Rows without a product or a category name match nothing
    and are spread over all tasks (``left_lookup``).  Joining the two dimensions to
    each other first would hide the product table's size from the planner.
    """
    p = products.select(F.col("product_id").alias("_p_id"), F.col("product_category_name").alias("_p_name"))
    t = translation.select(F.col("product_category_name").alias("_t_name"),
                           F.col("product_category_name_english").alias("_t_english"))
    named = left_lookup(df, "product_id", p, "_p_id")
    return (left_lookup(named, "_p_name", t, "_t_name")
              .withColumn("category", F.coalesce("_t_english", "_p_name", F.lit(UNKNOWN_CATEGORY)))
              .drop("_p_id", "_p_name", "_t_name", "_t_english"))


def delivery_times(orders: DataFrame, status: str = DELIVERED) -> DataFrame:
    """Delivered orders with both delivery dates, with delivery and delay in fractional days.

    ``delay_days > 0`` is late, ``< 0`` early, ``= 0`` exactly on the estimate.
    """
    d = orders.where((F.col("order_status") == status)
                     & F.col("order_delivered_customer_date").isNotNull()
                     & F.col("order_estimated_delivery_date").isNotNull())
    return d.select(
        "order_id",
        fractional_days("order_delivered_customer_date", "order_purchase_timestamp").alias("delivery_days"),
        fractional_days("order_delivered_customer_date", "order_estimated_delivery_date").alias("delay_days"))


def first_item_per_order(items: DataFrame) -> DataFrame:
    """The first item of each order: lowest ``order_item_id``, ties by ``product_id``
    (NULLs sort last as in an ascending SQL ordering).

    ``min(struct)`` is an ordinary aggregate: partial per map task, no sort,
    no window, and a hot order is reduced to one row before the shuffle.
    """
    key = F.struct(F.col("order_item_id").isNull().alias("n1"), F.col("order_item_id").alias("k1"),
                   F.col("product_id").isNull().alias("n2"), F.col("product_id").alias("k2"))
    return (items.groupBy("order_id").agg(F.min(key).alias("_first"))
                 .select("order_id", F.col("_first.k2").alias("product_id")))


def customer_key(orders: DataFrame, customers: DataFrame, *order_cols: str) -> DataFrame:
    """Attach ``customer_unique_id`` to order rows (inner join on ``customer_id``)."""
    c = customers.select(F.col("customer_id").alias("_cid"), "customer_unique_id")
    return (orders.join(c, orders.customer_id == F.col("_cid"), "inner")
                  .select("customer_unique_id", *order_cols))

