"""The Spark binding of the test tables equals the SQL binding the oracle uses."""

import pytest

from tests.conftest import SF001, SF01
from tests.oracle import canon, duck
from tillroll.catalog import publish
from tillroll.sources.testbind import SQL_VIEWS, TestShop


def _spark_tables(shop):
    return {"raw_customers": shop.customers(geo=True), "raw_orders": shop.orders(),
            "raw_order_items": shop.order_items(), "raw_products": shop.products(),
            "raw_product_category_translation": shop.translation(),
            "raw_order_payments": shop.order_payments(), "raw_order_reviews": shop.order_reviews()}


@pytest.mark.parametrize("sf", [SF001, SF01])
@pytest.mark.parametrize("view", list(SQL_VIEWS))
def test_binding_matches_sql(spark, sf, view):
    got = publish(_spark_tables(TestShop(spark, sf))[view])
    want = duck(sf).execute(f"SELECT * FROM ({SQL_VIEWS[view]})").df()
    cols = [c for c in want.columns if c in got.columns]
    assert set(want.columns) <= set(got.columns)
    assert canon(got.select(*cols).toPandas()) == canon(want[cols])
