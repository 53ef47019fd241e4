"""Edge cases on hand-built tables: every job against its SQL version, plus spot checks
of the semantics that the SQL version could get wrong in the same way."""

import duckdb
import pytest

from tests.edge_data import BROKEN, EMPTY, MIXED, SMALL, FrameShop, duck_tables, spark_frames
from tests.oracle import canon
from tillroll import catalog
from tillroll.oracle_sql import oracle_bodies

DATASETS = {"mixed": MIXED, "empty": EMPTY, "small": SMALL, "broken": BROKEN}
# Keys are broken on purpose in "broken": only the checks that look for that run on it.
CHECKS = [n for n in catalog.job_names() if n.startswith(("dq_", "check_"))]
_cache = {}


def _frames(spark, key):
    if key not in _cache:
        con = duckdb.connect()
        duck_tables(con, DATASETS[key])
        _cache[key] = (spark_frames(spark, DATASETS[key]), con)
    return _cache[key]


def _run(spark, key, name):
    frames, _ = _frames(spark, key)
    return catalog.run_on(FrameShop(frames), name)


@pytest.mark.parametrize("key, name", [(k, n) for k in DATASETS for n in catalog.job_names()
                                       if k != "broken" or n in CHECKS])
def test_edge_matches_sql(spark, key, name):
    frames, con = _frames(spark, key)
    got = catalog.run_on(FrameShop(frames), name).toPandas()
    want = con.execute(oracle_bodies()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want), (got.to_string(), want.to_string())


def _rows(df):
    return [r.asDict() for r in df.collect()]


def test_monthly_gaps_and_null_month(spark):
    rows = _rows(_run(spark, "mixed", "monthly_metrics"))
    months = [r["order_month"] for r in rows]
    assert months[-1] is None                       # NULL month sorts last
    assert [m.month for m in months[:-1]] == [1, 2, 3, 5]  # gaps are not filled
    jan, feb, mar = rows[0], rows[1], rows[2]
    assert jan["revenue_mom_pct"] is None
    assert jan["orders_count"] == 2 and jan["customers_count"] == 1
    # March compares with February (previous month present), not with a filled zero.
    assert mar["orders_mom_pct"] == 100.0


def test_category_fallbacks(spark):
    cats = {r["category"]: r for r in _rows(_run(spark, "mixed", "category_revenue"))}
    assert {"A", "B", "cat_x", "unknown"} <= set(cats)   # translated, untranslated, NULL / missing product
    assert cats["unknown"]["orders_count"] == 3          # o3 (NULL category), o7 (unknown product), o9
    assert sorted(r["revenue_rank"] for r in cats.values()) == list(range(1, len(cats) + 1))


def test_review_groups_and_rounding(spark):
    groups = {r["delivery_group"]: r for r in _rows(_run(spark, "mixed", "review_score_by_delivery_group"))}
    assert groups["on_time"]["orders"] == 1              # delay exactly zero is its own group
    dist = {r["review_score"]: r for r in _rows(_run(spark, "mixed", "score_distribution_by_delivery"))}
    assert dist[5]["on_time_or_early"] >= 1              # o1: (5 + 4) / 2 = 4.5 rounds half up to 5


def test_empty_input_gives_nulls_not_errors(spark):
    perf = _rows(_run(spark, "empty", "delivery_performance"))[0]
    assert perf["delivered_orders"] == 0 and perf["late_rate_pct"] is None
    summ = _rows(_run(spark, "empty", "business_summary"))[0]
    assert summ["delivered_orders"] == 0 and summ["repeat_purchase_rate_pct"] is None
    assert _run(spark, "empty", "monthly_metrics").count() == 0


def test_ntile_with_fewer_rows_than_buckets(spark):
    rows = _rows(_run(spark, "small", "rfm_scores"))
    assert sorted(r["f_score"] for r in rows) == [1, 2, 3]   # all tied: split by customer id
    assert sorted(r["r_score"] for r in rows) == [1, 2, 3]


def test_quality_counts(spark):
    money = _rows(_run(spark, "mixed", "dq_item_money"))[0]
    assert money == {"non_positive_price": 1, "negative_freight": 1}
    assert _rows(_run(spark, "mixed", "dq_payment_money"))[0]["non_positive_payment"] == 1
    assert _rows(_run(spark, "mixed", "dq_reviews_without_order"))[0]["reviews_without_order"] == 2
    assert _rows(_run(spark, "mixed", "dq_orders_without_items"))[0]["orders_without_items"] == 3
    orphans = {r["order_id"] for r in _rows(_run(spark, "mixed", "check_fk_order_items_orders"))}
    assert orphans == {"oX"}                               # NULL reference is not an orphan
    assert {r["customer_id"] for r in _rows(_run(spark, "mixed", "check_fk_orders_customers"))} == {"c9"}
    dup = _rows(_run(spark, "mixed", "check_pk_order_items"))
    assert {(r["order_id"], r["order_item_id"]) for r in dup} == {("o1", 1), ("o9", 2)}


def test_first_two_orders_tie_break(spark):
    r = _rows(_run(spark, "mixed", "days_between_first_two_orders"))[0]
    # u1 has o1 and o9 at the same instant, then o2: the first two are o1/o9 -> 0 days.
    assert r["min_days"] == 0.0


@pytest.mark.parametrize("name", [n for n in CHECKS if n.startswith(("check_", "dq_duplicate_"))])
def test_broken_keys_are_found(spark, name):
    rows = _rows(_run(spark, "broken", name))
    assert rows, name
