"""Canonical data model: seven shop tables, their keys and references.

Schemas follow the landing DDL of the source project (ids are text there; the
operators never assume a key type, so numeric ids work as well).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

S, I, L, TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampNTZType()
MONEY = T.DecimalType(12, 2)


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


CUSTOMERS = _schema(
    ("customer_id", S, False), ("customer_unique_id", S, False),
    ("customer_zip_code_prefix", S, True), ("customer_city", S, True),
    ("customer_state", S, True))

ORDERS = _schema(
    ("order_id", S, False), ("customer_id", S, True), ("order_status", S, True),
    ("order_purchase_timestamp", TS, True), ("order_approved_at", TS, True),
    ("order_delivered_carrier_date", TS, True), ("order_delivered_customer_date", TS, True),
    ("order_estimated_delivery_date", TS, True))

PRODUCTS = _schema(
    ("product_id", S, False), ("product_category_name", S, True),
    ("product_name_length", I, True), ("product_description_length", I, True),
    ("product_photos_qty", I, True), ("product_weight_g", I, True),
    ("product_length_cm", I, True), ("product_height_cm", I, True),
    ("product_width_cm", I, True))

ORDER_ITEMS = _schema(
    ("order_id", S, False), ("order_item_id", I, False), ("product_id", S, True),
    ("seller_id", S, True), ("shipping_limit_date", TS, True),
    ("price", MONEY, True), ("freight_value", MONEY, True))

ORDER_PAYMENTS = _schema(
    ("order_id", S, False), ("payment_sequential", I, False), ("payment_type", S, True),
    ("payment_installments", I, True), ("payment_value", MONEY, True))

# The review file has no surrogate key; ``review_sk`` is generated at landing.
ORDER_REVIEWS_FILE = _schema(
    ("review_id", S, True), ("order_id", S, True), ("review_score", I, True),
    ("review_comment_title", S, True), ("review_comment_message", S, True),
    ("review_creation_date", TS, True), ("review_answer_timestamp", TS, True))
ORDER_REVIEWS = T.StructType([T.StructField("review_sk", L, False)] + ORDER_REVIEWS_FILE.fields)

CATEGORY_TRANSLATION = _schema(
    ("product_category_name", S, False), ("product_category_name_english", S, False))


@dataclass(frozen=True)
class Table:
    name: str
    file_schema: T.StructType
    csv_file: str
    primary_key: tuple[str, ...]
    not_null: tuple[str, ...] = ()


@dataclass(frozen=True)
class ForeignKey:
    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"{self.child}_{'_'.join(self.columns)}__{self.parent}"


# The source file names of the marketplace export, in load order.
TABLES: dict[str, Table] = {
    "customers": Table("customers", CUSTOMERS, "olist_customers_dataset.csv",
                       ("customer_id",), ("customer_unique_id",)),
    "orders": Table("orders", ORDERS, "olist_orders_dataset.csv", ("order_id",)),
    "products": Table("products", PRODUCTS, "olist_products_dataset.csv", ("product_id",)),
    "order_items": Table("order_items", ORDER_ITEMS, "olist_order_items_dataset.csv",
                         ("order_id", "order_item_id")),
    "order_payments": Table("order_payments", ORDER_PAYMENTS, "olist_order_payments_dataset.csv",
                            ("order_id", "payment_sequential")),
    "order_reviews": Table("order_reviews", ORDER_REVIEWS_FILE, "olist_order_reviews_dataset.csv",
                           ("review_sk",)),
    "product_category_translation": Table(
        "product_category_translation", CATEGORY_TRANSLATION,
        "product_category_name_translation.csv", ("product_category_name",),
        ("product_category_name_english",)),
}

FOREIGN_KEYS: tuple[ForeignKey, ...] = (
    ForeignKey("orders", ("customer_id",), "customers", ("customer_id",)),
    ForeignKey("order_items", ("order_id",), "orders", ("order_id",)),
    ForeignKey("order_items", ("product_id",), "products", ("product_id",)),
    ForeignKey("order_payments", ("order_id",), "orders", ("order_id",)),
)

DELIVERED = "delivered"
