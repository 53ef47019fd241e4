"""Registry of the jobs: name -> ``fn(spark, sf_dir) -> DataFrame`` over the test binding.

Every job reads the driver's tables through ``TestShop`` and publishes its
result with ``publish``: exact decimals become doubles (after rounding) and
calendar dates become midnight timestamps, as the client side receives them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.temporal import MICROS_PER_DAY
from tillroll.model import FOREIGN_KEYS, TABLES
from tillroll.operators import quality as Q
from tillroll.operators.ranking import exact_percentile, global_row_number, ntile_buckets, with_surrogate_id
from tillroll.plans import customers as C
from tillroll.plans import delivery as D
from tillroll.plans import sales as S
from tillroll.plans.summary import business_summary
from tillroll.session import apply_required_conf, ensure_checkpoint_dir
from tillroll.sources.landing import ParquetShop, land_csv, write_table
from tillroll.sources.landing import publish as publish_table
from tillroll.sources.testbind import TestShop
from tillroll.sources.versions import write_version


def publish(df: DataFrame) -> DataFrame:
    """Client representation: decimal -> double, date -> timestamp (midnight)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            cols.append(F.col(f.name).cast("timestamp_ntz").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


Job = Callable[[TestShop], DataFrame]
_JOBS: dict[str, Job] = {}


def job(name: str):
    def deco(fn: Job) -> Job:
        _JOBS[name] = fn
        return fn
    return deco


# ------------------------------------------------------------------ data quality
@job("dq_row_counts")
def _(s: TestShop):
    return Q.row_counts({"customers": s.customers(), "orders": s.orders(delivery=False),
                         "products": s.products(), "order_items": s.order_items(),
                         "order_payments": s.order_payments(), "order_reviews": s.order_reviews()})


job("dq_duplicate_order_ids")(lambda s: Q.duplicate_keys(s.orders(delivery=False), "order_id"))
job("dq_duplicate_customer_ids")(lambda s: Q.duplicate_keys(s.customers(), "customer_id"))
job("dq_duplicate_reviews")(lambda s: Q.duplicate_review_ids(s.order_reviews()))
job("dq_order_nulls")(lambda s: Q.order_nulls(s.orders()))
job("dq_products_without_category")(lambda s: Q.products_without_category(s.products()))
job("dq_status_distribution")(lambda s: Q.status_distribution(s.orders(delivery=False)))
job("dq_orders_without_items")(
    lambda s: Q.orders_without(s.orders(delivery=False), s.order_items(), "orders_without_items"))
job("dq_orders_without_payments")(
    lambda s: Q.orders_without(s.orders(delivery=False), s.order_payments(), "orders_without_payments"))
job("dq_delivered_before_purchase")(lambda s: Q.delivered_before_purchase(s.orders()))
job("dq_item_money")(lambda s: Q.item_money(s.order_items()))
job("dq_payment_money")(lambda s: Q.payment_money(s.order_payments()))
job("dq_reviews_without_order")(
    lambda s: Q.reviews_without_order(s.order_reviews(), s.orders(delivery=False)))
job("dq_purchase_range")(lambda s: Q.purchase_range(s.orders(delivery=False)))


# --------------------------------------------------------------- key constraints
def _frames(s: TestShop) -> dict[str, Callable[[], DataFrame]]:
    return {"customers": s.customers, "orders": lambda: s.orders(delivery=False),
            "products": s.products, "order_items": s.order_items,
            "order_payments": s.order_payments, "order_reviews": s.order_reviews,
            "product_category_translation": s.translation}


for _t, _key in [("products", "check_pk_products"), ("order_items", "check_pk_order_items"),
                 ("order_payments", "check_pk_order_payments"),
                 ("order_reviews", "check_pk_order_reviews"),
                 ("product_category_translation", "check_pk_category_translation")]:
    job(_key)(lambda s, _t=_t: Q.check_unique(_frames(s)[_t](), TABLES[_t].primary_key))


@job("check_not_null")
def _(s: TestShop):
    parts = [Q.check_not_null(_frames(s)[name](), list(t.primary_key) + list(t.not_null), name)
             for name, t in TABLES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_FK_NAMES = {("orders", "customers"): "check_fk_orders_customers",
             ("order_items", "orders"): "check_fk_order_items_orders",
             ("order_items", "products"): "check_fk_order_items_products",
             ("order_payments", "orders"): "check_fk_order_payments_orders"}
for _fk in FOREIGN_KEYS:
    job(_FK_NAMES[(_fk.child, _fk.parent)])(
        lambda s, fk=_fk: Q.check_foreign_key(_frames(s)[fk.child](), fk.columns,
                                              _frames(s)[fk.parent](), fk.parent_columns))

# --------------------------------------------------------------------- analytics
job("monthly_metrics")(lambda s: S.monthly_metrics(s.orders(delivery=False), s.order_items()))
job("chart_monthly_revenue")(lambda s: S.chart_monthly_revenue(s.orders(delivery=False), s.order_items()))
job("category_revenue")(lambda s: S.category_revenue(
    s.orders(delivery=False), s.order_items(), s.products(), s.translation()))
job("chart_top_categories")(lambda s: S.chart_top_categories(
    s.orders(delivery=False), s.order_items(), s.products(), s.translation()))

job("repeat_customer_metrics")(lambda s: C.repeat_customer_metrics(s.orders(delivery=False), s.customers()))
job("orders_per_customer_distribution")(
    lambda s: C.orders_per_customer_distribution(s.orders(delivery=False), s.customers()))
job("days_between_first_two_orders")(
    lambda s: C.days_between_first_two_orders(s.orders(delivery=False), s.customers()))
job("top_customers_by_revenue")(
    lambda s: C.top_customers_by_revenue(s.orders(delivery=False), s.customers(), s.order_items()))

job("delivery_performance")(lambda s: D.delivery_performance(s.orders()))
job("review_score_by_delivery_group")(
    lambda s: D.review_score_by_delivery_group(s.orders(), s.order_reviews()))
job("score_distribution_by_delivery")(
    lambda s: D.score_distribution_by_delivery(s.orders(), s.order_reviews()))
job("chart_delivery_reviews")(lambda s: D.chart_delivery_reviews(s.orders(), s.order_reviews()))
job("category_delay_top10")(lambda s: D.category_delay_top10(
    s.orders(), s.order_items(), s.products(), s.translation()))


def _rfm_base(s: TestShop) -> DataFrame:
    return C.rfm_base(s.orders(delivery=False), s.customers(), s.order_items())


job("rfm_base")(_rfm_base)
job("rfm_scores")(lambda s: C.rfm_scores(_rfm_base(s)))
job("rfm_customer_segments")(lambda s: C.rfm_segments(C.rfm_scores(_rfm_base(s))))
job("rfm_segment_summary")(lambda s: C.rfm_segment_summary(C.rfm_segments(
    C.rfm_scores(_rfm_base(s), scores=("r_score", "m_score")))))      # the rules use no frequency score

job("business_summary")(lambda s: business_summary(
    s.orders(), s.customers(), s.order_items(), s.order_reviews()))


@job("review_surrogate_keys")
def _(s: TestShop):
    r = s.order_reviews().select("review_id", "order_id", "review_score", "review_creation_date")
    order = [F.asc_nulls_last(c) for c in ("review_creation_date", "review_id", "order_id", "review_score")]
    return with_surrogate_id(r, order, "review_sk").select(
        "review_sk", "review_id", "order_id", "review_score", "review_creation_date")


# The distributed operators on inputs of their own: every item numbered by price,
# and quartiles of the orders by their number of items.
@job("global_row_number")
def _(s: TestShop):
    i = s.order_items().select("order_id", "order_item_id", "product_id", "price")
    order = [F.asc_nulls_last(c) for c in ("price", "order_id", "order_item_id", "product_id")]
    return global_row_number(i, order, "row_number")


@job("ntile_global")
def _(s: TestShop):
    per_order = s.order_items().groupBy("order_id").agg(F.count(F.lit(1)).alias("items")).where("order_id is not null")
    return ntile_buckets(per_order, 4, {"quartile": ("items", False)}, "order_id")


@job("exact_median_global")
def _(s: TestShop):
    dt = D.delivery_times(s.orders()).select("delivery_days")
    gaps = C.first_two_purchase_gaps(s.orders(delivery=False), s.customers()).select("days")
    median = exact_percentile(dt, "delivery_days", per_unit=MICROS_PER_DAY).select(
        F.col("value").alias("median_delivery_days"))
    return median.withColumn("median_days_between", exact_percentile(gaps, "days", per_unit=MICROS_PER_DAY).scalar())


# --------------------------------------------------------------------- load path
# The order in which rows stand in the CSV files, where generated keys depend on it.
FILE_ORDER = {"order_reviews": ("review_creation_date", "review_id", "order_id", "review_score")}


def _landed(s: TestShop, table: str) -> DataFrame:
    """The table written as CSV, landed as Parquet and read back, all below the shared checkpoint folder."""
    df = s.all_tables()[table]
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/landing-{uuid.uuid4().hex}"
    fields = TABLES[table].file_schema.fields
    if table in FILE_ORDER:
        df = df.orderBy(*[F.asc_nulls_last(c) for c in FILE_ORDER[table]])
    out = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    (out.write.option("header", "true").option("escape", '"').option("nullValue", "").option("emptyValue", '""')
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(f"{folder}/{table}.csv"))
    write_table(land_csv(spark, f"{folder}/{table}.csv", table), f"{folder}/raw", table)
    return getattr(ParquetShop(spark, f"{folder}/raw"), SHOP_METHODS.get(table, table))()


# Columns of the landed tables that the test binding fills.
LANDED = {
    "customers": ("customer_id", "customer_unique_id", "customer_city", "customer_state"),
    "orders": ("order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
               "order_delivered_customer_date", "order_estimated_delivery_date"),
    "products": ("product_id", "product_category_name"),
    "order_items": ("order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price", "freight_value"),
    "order_payments": ("order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"),
    "order_reviews": ("review_sk", "review_id", "order_id", "review_score", "review_creation_date"),
    "product_category_translation": ("product_category_name", "product_category_name_english"),
}
SHOP_METHODS = {"product_category_translation": "translation"}
for _t, _cols in LANDED.items():
    job(f"land_{_t}")(lambda s, t=_t, cols=_cols: _landed(s, t).select(*cols))


@job("publish_business_summary")
def _(s: TestShop):
    out = publish(business_summary(s.orders(), s.customers(), s.order_items(), s.order_reviews()))
    spark = out.sparkSession
    return spark.read.parquet(publish_table(out, f"{ensure_checkpoint_dir(spark)}/analytics-{uuid.uuid4().hex}", "summary"))


@job("layer_versions")
def _(s: TestShop):
    """Two versions of a layer: a shop pinned to the first reads it whole while the second, of fewer items, is current."""
    tables = s.all_tables()
    spark = tables["orders"].sparkSession
    layer = f"{ensure_checkpoint_dir(spark)}/layer-{uuid.uuid4().hex}"
    write_version(layer, tables)
    pinned = ParquetShop(spark, layer)
    write_version(layer, {"order_items": tables["order_items"].where("order_item_id > 1"), "products": tables["products"].limit(0)})
    shops = {"first": pinned, "second": pinned.refresh()}
    counts = [Q.row_counts(shop.all_tables()).withColumn("layer_version", F.lit(v)) for v, shop in shops.items()]
    return counts[0].unionByName(counts[1])


def job_names() -> list[str]:
    return list(_JOBS)


def run_on(shop, name: str) -> DataFrame:
    """Run job ``name`` on any shop (test binding, landed Parquet, given frames)."""
    return publish(_JOBS[name](shop))


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_required_conf(spark)
    return run_on(TestShop(spark, sf_dir), name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, _n=name: run(_n, spark, sf_dir)) for name in _JOBS}
