"""Hand-built canonical tables for edge cases the driver's tables do not contain."""

from datetime import datetime as dt
from decimal import Decimal as D

import pandas as pd
from pyspark.sql import types as T

from tillroll.model import (CATEGORY_TRANSLATION, CUSTOMERS, ORDER_ITEMS, ORDER_PAYMENTS,
                            ORDER_REVIEWS, ORDERS, PRODUCTS)

SCHEMAS = {"customers": CUSTOMERS, "orders": ORDERS, "products": PRODUCTS,
           "order_items": ORDER_ITEMS, "order_payments": ORDER_PAYMENTS,
           "order_reviews": ORDER_REVIEWS, "product_category_translation": CATEGORY_TRANSLATION}


def _o(oid, cid, status, purchase, delivered=None, estimated=None, approved=None):
    return dict(order_id=oid, customer_id=cid, order_status=status, order_purchase_timestamp=purchase,
                order_approved_at=approved, order_delivered_customer_date=delivered,
                order_estimated_delivery_date=estimated)


def _i(oid, n, pid, price, freight=None):
    return dict(order_id=oid, order_item_id=n, product_id=pid,
                price=None if price is None else D(price),
                freight_value=None if freight is None else D(freight))


def _r(sk, rid, oid, score):
    return dict(review_sk=sk, review_id=rid, order_id=oid, review_score=score,
                review_creation_date=dt(2017, 6, 1))


MIXED = {
    "customers": [dict(customer_id=c, customer_unique_id=u) for c, u in
                  [("c1", "u1"), ("c2", "u1"), ("c3", "u3"), ("c4", "u4"), ("c5", "u5"), ("c6", "u6")]],
    "orders": [
        _o("o1", "c1", "delivered", dt(2017, 1, 10, 10), dt(2017, 1, 20), dt(2017, 1, 25), dt(2017, 1, 10, 12)),
        _o("o2", "c2", "delivered", dt(2017, 3, 5, 8), dt(2017, 3, 30), dt(2017, 3, 30)),       # exactly on time
        _o("o3", "c3", "delivered", dt(2017, 3, 15), dt(2017, 4, 20, 6), dt(2017, 4, 1)),        # late
        _o("o4", "c3", "shipped", dt(2017, 3, 16)),
        _o("o5", "c4", "delivered", dt(2017, 4, 1), dt(2017, 4, 3), dt(2017, 4, 9)),             # no items
        _o("o6", "c5", "delivered", dt(2017, 5, 2, 23, 30), None, dt(2017, 5, 20)),              # not delivered yet
        _o("o7", None, "delivered", dt(2017, 5, 7), dt(2017, 5, 8), dt(2017, 5, 9)),             # no customer
        _o("o8", "c4", "delivered", None, dt(2017, 6, 1), dt(2017, 6, 5)),                       # no purchase time
        _o("o9", "c1", "delivered", dt(2017, 1, 10, 10), dt(2017, 1, 11), dt(2017, 1, 10)),      # tie on time with o1
        _o("o10", "c9", None, dt(2017, 7, 1)),                                                   # unknown customer
        _o("o11", "c6", "delivered", dt(2017, 2, 1), dt(2017, 1, 30), dt(2017, 2, 10)),          # delivered before purchase
    ],
    "order_items": [
        _i("o1", 1, "p1", "10.00", "1.00"), _i("o1", 2, "p2", "20.00", "2.00"), _i("o1", 1, "p2", "4.00", "0.50"),
        _i("o2", 1, "p3", "5.55"),
        _i("o3", 1, "p4", None, "3.00"), _i("o3", 2, "p1", "0.00", "-1.00"),
        _i("o4", 1, "p2", "3.00", "1.00"),
        _i("o7", 1, "p9", "7.00", "1.00"),
        _i("o8", 1, "p1", "1.00", "0.10"),
        _i("o9", 2, None, "2.50", "0.20"), _i("o9", 2, "p3", "2.50", "0.20"),
        _i("o11", 1, "p2", "9.99", "0.99"),
        _i("oX", 1, "p1", "2.00", "0.00"),
        _i(None, 1, "p1", "1.00", "0.00"),
    ],
    "products": [dict(product_id=p, product_category_name=c) for p, c in
                 [("p1", "cat_a"), ("p2", "cat_b"), ("p3", "cat_x"), ("p4", None)]],
    "product_category_translation": [dict(product_category_name="cat_a", product_category_name_english="A"),
                                     dict(product_category_name="cat_b", product_category_name_english="B")],
    "order_payments": [dict(order_id=o, payment_sequential=1, payment_type="credit_card",
                            payment_installments=1, payment_value=D(v)) for o, v in
                       [("o1", "34.00"), ("o2", "0.00"), ("o3", "12.00"), ("o6", "1.00"), ("oP", "5.00")]],
    "order_reviews": [_r(1, "r1", "o1", 5), _r(2, "r1", "o1", 4), _r(3, "r3", "o2", 3), _r(4, "r4", "o3", 1),
                      _r(5, "r5", "oZ", 2), _r(6, "r6", None, 4), _r(7, "r7", "o3", None), _r(8, "r8", "o9", 2),
                      _r(9, "r9", "o11", 5)],
}

EMPTY = {name: [] for name in SCHEMAS}

# Three customers only (fewer than five quintiles), all tied on frequency.
SMALL = {
    "customers": [dict(customer_id=f"c{i}", customer_unique_id=f"u{i}") for i in range(3)],
    "orders": [_o(f"o{i}", f"c{i}", "delivered", dt(2018, 1, 1 + i), dt(2018, 1, 5 + i), dt(2018, 1, 6))
               for i in range(3)],
    "order_items": [_i(f"o{i}", 1, "p1", "10.00", "1.00") for i in range(3)],
    "products": [dict(product_id="p1", product_category_name="cat_a")],
    "product_category_translation": [],
    "order_payments": [],
    "order_reviews": [],
}

# A small export with sound keys, and one that breaks every key.
KEYED = {
    "customers": [dict(customer_id="c1", customer_unique_id="u1")],
    "orders": [_o("o1", "c1", "delivered", dt(2018, 1, 1), dt(2018, 1, 5), dt(2018, 1, 6))],
    "order_items": [_i("o1", 1, "p1", "10.00", "1.00"), _i("o1", 2, "p1", "5.00", "1.00")],
    "products": [dict(product_id="p1", product_category_name="cat_a")],
    "product_category_translation": [dict(product_category_name="cat_a", product_category_name_english="A")],
    "order_payments": [dict(order_id="o1", payment_sequential=1, payment_type="card", payment_installments=1,
                            payment_value=D("16.00"))],
    "order_reviews": [_r(1, "r1", "o1", 5)],
}
BROKEN = {
    "customers": [dict(customer_id="c1", customer_unique_id="u1")] * 2 + [dict(customer_id="c2", customer_unique_id=None)],
    "orders": [_o("o1", "c1", "delivered", dt(2018, 1, 1), dt(2018, 1, 5), dt(2018, 1, 6)),
               _o("o1", "c1", "shipped", dt(2018, 1, 2)), _o("o2", "c9", "shipped", dt(2018, 1, 2))],
    "order_items": [_i("o1", 1, "p1", "10.00", "1.00"), _i("o1", 1, "p1", "0.00", "-1.00"), _i("o9", 1, "p9", "5.00", "1.00")],
    "products": [dict(product_id="p1", product_category_name="cat_a")] * 2,
    "product_category_translation": [dict(product_category_name="cat_a", product_category_name_english="A")] * 3,
    "order_payments": [dict(order_id=o, payment_sequential=1, payment_type="card", payment_installments=1,
                            payment_value=D(v)) for o, v in [("o1", "16.00"), ("o1", "0.00"), ("o9", "1.00")]],
    "order_reviews": [_r(1, "r1", "o1", 5), _r(1, "r1", "o1", 4), _r(2, "r3", "o9", 1)],
}


def spark_frames(spark, data):
    out = {}
    for name, schema in SCHEMAS.items():
        rows = [tuple(r.get(f.name) for f in schema.fields) for r in data[name]]
        # Nullable copies: the edge data deliberately breaks NOT NULL keys.
        loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
        out[name] = spark.createDataFrame(rows, loose)
    return out


_DUCK_TYPES = {T.StringType: "VARCHAR", T.IntegerType: "INTEGER", T.LongType: "BIGINT",
               T.TimestampNTZType: "TIMESTAMP"}


def _duck_type(t):
    if isinstance(t, T.DecimalType):
        return f"DECIMAL({t.precision},{t.scale})"
    return _DUCK_TYPES[type(t)]


def duck_tables(con, data):
    for name, schema in SCHEMAS.items():
        cols = ", ".join(f"{f.name} {_duck_type(f.dataType)}" for f in schema.fields)
        con.execute(f"CREATE TABLE raw_{name} ({cols})")
        if data[name]:
            pdf = pd.DataFrame([{f.name: r.get(f.name) for f in schema.fields} for r in data[name]])
            pdf = pdf.astype(object).where(pdf.notna(), None)
            con.register("_src", pdf)
            casts = ", ".join(f"CAST({f.name} AS {_duck_type(f.dataType)})" for f in schema.fields)
            con.execute(f"INSERT INTO raw_{name} SELECT {casts} FROM _src")
            con.unregister("_src")


class FrameShop:
    """Shop interface over given frames (the jobs' keyword options are irrelevant here)."""

    def __init__(self, frames):
        self.f = frames

    def customers(self, geo=False):
        return self.f["customers"]

    def orders(self, delivery=True):
        return self.f["orders"]

    def products(self):
        return self.f["products"]

    def order_items(self):
        return self.f["order_items"]

    def order_payments(self):
        return self.f["order_payments"]

    def order_reviews(self):
        return self.f["order_reviews"]

    def translation(self):
        return self.f["product_category_translation"]

    def all_tables(self):
        return self.f
