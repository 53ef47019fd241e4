"""Bind the driver's TPC-H-like test tables onto the canonical shop model.

The shop export itself is not shipped, so the test tables stand in for it:

==========================  =================================================
canonical                   derived from
==========================  =================================================
customers                   customer (+ nation, region for city / state)
orders                      orders (+ latest lineitem ship date = delivery)
order_items                 lineitem
products                    part (brand = category, every 10th size has none)
product_category_translation distinct brands, two under names no product has (untranslated)
order_payments              orders; every 500th names an order that does not exist
order_reviews               events (duplicate review ids, orphan orders)
==========================  =================================================

``SQL_VIEWS`` holds the same binding as SQL text for the independent oracle
engine; the Spark and SQL versions must stay expression-for-expression equal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the binding.
STATUS_BY_CODE = {"F": "delivered", "O": "shipped", "P": "processing"}
UNTRANSLATED_BRANDS = ("Brand#1", "Brand#2")
ESTIMATE_DAYS = 730


# Column types of the driver's test tables (declared, so reads
# need no schema-inference job).
RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
             "p_retailprice double"),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                 "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                 "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    "events": ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
               "props string"),
}


def _read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    reader = spark.read.schema(RAW_SCHEMAS[name]) if name in RAW_SCHEMAS else spark.read
    df = reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


@dataclass
class TestShop:
    """Canonical frames over one scale-factor directory (lazy, column-pruned)."""

    __test__ = False            # not a test class

    spark: SparkSession
    sf_dir: str

    def table(self, name: str, *cols: str) -> DataFrame:
        return _read(self.spark, self.sf_dir, name, *cols)

    # -- customers -------------------------------------------------------
    def customers(self, geo: bool = False) -> DataFrame:
        c = self.table("customer", "c_custkey", "c_nationkey")
        out = c.select(
            F.col("c_custkey").alias("customer_id"),
            (F.col("c_custkey") - F.col("c_custkey") % 2).alias("customer_unique_id"),
            F.lit(None).cast("string").alias("customer_zip_code_prefix"),
            F.col("c_nationkey"))
        if geo:
            # nation / region are fixed 25- and 5-row reference tables.
            n = self.table("nation", "n_nationkey", "n_name", "n_regionkey")
            r = self.table("region", "r_regionkey", "r_name")
            out = (out.join(F.broadcast(n), out.c_nationkey == n.n_nationkey, "left")
                      .join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey, "left")
                      .select(out.customer_id, out.customer_unique_id, out.customer_zip_code_prefix,
                              F.col("n_name").alias("customer_city"),
                              F.col("r_name").alias("customer_state")))
        else:
            out = out.select("customer_id", "customer_unique_id", "customer_zip_code_prefix",
                             F.lit(None).cast("string").alias("customer_city"),
                             F.lit(None).cast("string").alias("customer_state"))
        return out

    # -- orders ----------------------------------------------------------
    def orders(self, delivery: bool = True) -> DataFrame:
        o = self.table("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
        status = F.when(F.col("o_orderstatus") == "F", STATUS_BY_CODE["F"]) \
                  .when(F.col("o_orderstatus") == "O", STATUS_BY_CODE["O"]) \
                  .when(F.col("o_orderstatus") == "P", STATUS_BY_CODE["P"])
        hours = (F.col("o_orderkey") % 24).cast("int")
        base = o.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            status.alias("order_status"),
            (F.col("o_orderdate") + F.make_dt_interval(hours=hours)).alias("order_purchase_timestamp"),
            F.when(F.col("o_orderkey") % 97 == 0, F.lit(None))
             .otherwise(F.col("o_orderdate") + F.make_dt_interval(days=F.lit(1)))
             .alias("order_approved_at"),
            F.lit(None).cast("timestamp_ntz").alias("order_delivered_carrier_date"),
            (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(ESTIMATE_DAYS)))
             .alias("order_estimated_delivery_date"))
        if delivery:
            # Delivery = latest ship date of the order's lines; partial aggregation
            # collapses each order's lines before the shuffle on the order key.
            shipped = (self.table("lineitem", "l_orderkey", "l_shipdate")
                       .groupBy("l_orderkey")
                       .agg(F.max("l_shipdate").alias("order_delivered_customer_date")))
            base = base.join(shipped, base.order_id == shipped.l_orderkey, "left").drop("l_orderkey")
        # Without it the column is absent: a job that needs the date fails instead of reading NULLs.
        return base.select(
            "order_id", "customer_id", "order_status", "order_purchase_timestamp",
            "order_approved_at", "order_delivered_carrier_date",
            *(["order_delivered_customer_date"] if delivery else []), "order_estimated_delivery_date")

    # -- order_items -----------------------------------------------------
    def order_items(self) -> DataFrame:
        li = self.table("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                        "l_shipdate", "l_extendedprice", "l_quantity")
        return li.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
            F.col("l_quantity").cast("decimal(12,2)").alias("freight_value"))

    # -- products / translation -----------------------------------------
    def products(self) -> DataFrame:
        p = self.table("part", "p_partkey", "p_brand", "p_size")
        return p.select(
            F.col("p_partkey").alias("product_id"),
            F.when(F.col("p_size") % 10 == 0, F.lit(None)).otherwise(F.col("p_brand"))
             .alias("product_category_name"))

    def translation(self) -> DataFrame:
        p = self.table("part", "p_brand")
        name = F.when(F.col("p_brand").isin(*UNTRANSLATED_BRANDS), F.concat(F.lit("old "), F.col("p_brand")))
        return (p.select(name.otherwise(F.col("p_brand")).alias("product_category_name"),
                         F.concat(F.lit("brand_"), F.substring("p_brand", 7, 1 << 20))
                          .alias("product_category_name_english"))
                 .distinct())

    # -- payments / reviews ---------------------------------------------
    def order_payments(self) -> DataFrame:
        o = self.table("orders", "o_orderkey", "o_orderpriority", "o_totalprice")
        return (o.select(F.when(F.col("o_orderkey") % 500 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("order_id"),
                         F.lit(1).alias("payment_sequential"),
                         F.col("o_orderpriority").alias("payment_type"),
                         F.lit(1).alias("payment_installments"),
                         F.col("o_totalprice").cast("decimal(12,2)").alias("payment_value")))

    def order_reviews(self) -> DataFrame:
        e = self.table("events", "event_id", "ts", "value")
        eid = F.col("event_id")
        return e.select(
            eid.alias("review_sk"),
            F.when(eid % 50 == 0, eid + 1).otherwise(eid).alias("review_id"),
            F.when(eid % 3 == 0, eid * 2).otherwise(eid).alias("order_id"),
            (F.lit(1) + F.floor("value") % 5).cast("int").alias("review_score"),
            F.lit(None).cast("string").alias("review_comment_title"),
            F.lit(None).cast("string").alias("review_comment_message"),
            F.col("ts").alias("review_creation_date"),
            F.lit(None).cast("timestamp_ntz").alias("review_answer_timestamp"))

    def all_tables(self) -> dict[str, DataFrame]:
        return {"customers": self.customers(geo=True), "orders": self.orders(),
                "products": self.products(), "order_items": self.order_items(),
                "order_payments": self.order_payments(), "order_reviews": self.order_reviews(),
                "product_category_translation": self.translation()}


# The same binding for the independent SQL engine (DuckDB dialect), one CTE per
# canonical table.  Names carry a ``raw_`` prefix: the landing layer was called
# ``raw`` and the driver's ``orders`` view would otherwise be shadowed.
SQL_VIEWS: dict[str, str] = {
    "raw_customers": """
        SELECT c.c_custkey AS customer_id,
               c.c_custkey - (c.c_custkey % 2) AS customer_unique_id,
               CAST(NULL AS VARCHAR) AS customer_zip_code_prefix,
               n.n_name AS customer_city, r.r_name AS customer_state
        FROM customer c
        LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
        LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "raw_orders": """
        SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id,
               CASE o.o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
                                    WHEN 'P' THEN 'processing' END AS order_status,
               o.o_orderdate + to_hours(CAST(o.o_orderkey % 24 AS INTEGER)) AS order_purchase_timestamp,
               CASE WHEN o.o_orderkey % 97 = 0 THEN NULL
                    ELSE o.o_orderdate + INTERVAL 1 DAY END AS order_approved_at,
               CAST(NULL AS TIMESTAMP) AS order_delivered_carrier_date,
               s.last_ship AS order_delivered_customer_date,
               o.o_orderdate + INTERVAL 730 DAY AS order_estimated_delivery_date
        FROM orders o
        LEFT JOIN (SELECT l_orderkey, MAX(l_shipdate) AS last_ship
                   FROM lineitem GROUP BY l_orderkey) s ON s.l_orderkey = o.o_orderkey""",
    "raw_order_items": """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
               l_suppkey AS seller_id, l_shipdate AS shipping_limit_date,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
               CAST(l_quantity AS DECIMAL(12,2)) AS freight_value
        FROM lineitem""",
    "raw_products": """
        SELECT p_partkey AS product_id,
               CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_brand END AS product_category_name
        FROM part""",
    "raw_product_category_translation": """
        SELECT DISTINCT CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'old ' || p_brand ELSE p_brand END AS product_category_name,
               'brand_' || substr(p_brand, 7) AS product_category_name_english
        FROM part""",
    "raw_order_payments": """
        SELECT CASE WHEN o_orderkey % 500 = 0 THEN -o_orderkey ELSE o_orderkey END AS order_id, 1 AS payment_sequential,
               o_orderpriority AS payment_type, 1 AS payment_installments, CAST(o_totalprice AS DECIMAL(12,2)) AS payment_value
        FROM orders""",
    "raw_order_reviews": """
        SELECT event_id AS review_sk,
               CASE WHEN event_id % 50 = 0 THEN event_id + 1 ELSE event_id END AS review_id,
               CASE WHEN event_id % 3 = 0 THEN 2 * event_id ELSE event_id END AS order_id,
               CAST(1 + floor(value) % 5 AS INTEGER) AS review_score,
               ts AS review_creation_date
        FROM events""",
}

_ORDER = list(SQL_VIEWS)


def with_views(body: str) -> str:
    """Prefix ``body`` with the binding CTEs it mentions."""
    used = [n for n in _ORDER if n in body]
    if not used:
        return body
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in used)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
