"""Distributed ranking / percentiles equal the native single-partition functions."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.plan_utils import plan_text
from tillroll.operators import ranking
from tillroll.operators.ranking import (exact_percentile, exact_percentiles, global_row_number, key_span, ntile_buckets,
                                        order_key, select_ranks, select_text_ranks)


def _frame(spark, values, kind="long"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, v {kind}")


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.one_of(st.none(), st.integers(-2, 3), st.integers(-2 ** 40, 2 ** 40)), min_size=0, max_size=50),
       k=st.integers(2, 7))
def test_ntile_buckets_equals_native(spark, values, k):
    df = _frame(spark, values)
    got = ntile_buckets(df, k, {"up": ("v", False), "down": ("v", True)}, "id")
    want = (df.withColumn("up", F.ntile(k).over(Window.orderBy(F.asc_nulls_last("v"), "id")))
            .withColumn("down", F.ntile(k).over(Window.orderBy(F.desc_nulls_first("v"), "id"))))
    assert sorted((r.id, r.up, r.down) for r in got.collect()) == sorted((r.id, r.up, r.down) for r in want.collect())


def test_ntile_buckets_heavy_ties_and_text_ids(spark):
    n = 6000
    df = spark.range(n).select(F.concat(F.lit("c-"), F.md5(F.col("id").cast("string"))).alias("who"),
                               F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(1).alias("v"))
    got = ntile_buckets(df, 5, {"b": ("v", False)}, "who")
    want = df.withColumn("b", F.ntile(5).over(Window.orderBy("v", "who")))
    assert got.exceptAll(want.select("who", "v", F.col("b").cast("long"))).count() == 0 and got.count() == n


def test_row_number_all_tied_is_balanced(spark):
    n = 20_000
    df = spark.range(n).select(F.col("id"), F.lit(1).alias("v"))
    ranked = global_row_number(df, ["v", "id"], "rn", num_partitions=8)
    rows = ranked.select("id", "rn").collect()
    assert sorted(r.rn for r in rows) == list(range(1, n + 1))
    assert all(r.rn == r.id + 1 for r in rows)
    # The range partitioning splits the tied rows over all partitions.
    sizes = (df.repartitionByRange(8, "v", "id").groupBy(F.spark_partition_id()).count().collect())
    assert max(r["count"] for r in sizes) < n / 4


@pytest.mark.parametrize("spread", [1, 300, 1 << 20, 1 << 50, 1 << 62])
def test_select_ranks(spark, spread):
    rng = random.Random(spread)
    values = sorted(rng.randint(-spread, spread) for _ in range(400))
    rows = spark.createDataFrame([(0, v) for v in values], "g int, key long")
    counts = rows.groupBy("g", "key").agg(F.count("*").alias("n"))
    ranks = [1, 2, 133, 200, 399, 400, 401]
    targets = spark.createDataFrame([(0, r, r) for r in ranks], "g int, t int, rank long")
    got = {r.t: (r.key, r.nth) for r in select_ranks(counts, targets, key_span(rows)).collect()}
    assert got == {r: (values[r - 1], r - values.index(values[r - 1])) for r in ranks if r <= 400}


@pytest.mark.parametrize("kind", ["double", "decimal(12,2)", "int"])
def test_order_key_sorts_like_the_value(spark, kind):
    raw = ["-1e300", "-2.5", "-1e-300", "0", "1e-300", "2.25", "1e300"] if kind == "double" else ["-12", "-1", "0", "3", "99"]
    df = spark.createDataFrame([(v,) for v in raw], "s string").select(F.col("s").cast(kind).alias("v"))
    rows = df.select("v", order_key(df, "v").alias("k")).collect()
    assert [r.k for r in rows] == sorted({r.k for r in rows})
    with pytest.raises(TypeError):
        order_key(spark.createDataFrame([("a",)], "v string"), "v")


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("kind", ["double", "long"])
def test_exact_percentile_equals_native(spark, p, kind):
    rng = random.Random(7)
    vals = [rng.choice([rng.random() * 100 - 50, 3.0, 3.0, None]) for _ in range(3000)]
    if kind == "long":
        vals = [None if v is None else int(v) for v in vals]
    df = _frame(spark, vals, kind)
    got = exact_percentile(df, "v", p).first()["value"]
    assert got == pytest.approx(df.agg(F.percentile("v", p)).first()[0], rel=1e-12, abs=1e-12)


def test_exact_percentile_small_inputs(spark):
    assert exact_percentile(_frame(spark, [], "double"), "v").first()["value"] is None
    assert exact_percentile(_frame(spark, [None, None], "double"), "v").first()["value"] is None
    assert exact_percentile(_frame(spark, [2.5], "double"), "v").first()["value"] == 2.5
    assert exact_percentile(_frame(spark, [7.0] * 99, "double"), "v", 0.3).first()["value"] == 7.0
    assert exact_percentile(_frame(spark, [0.25, 0.5], "double"), "v", per_unit=4).first()["value"] == 0.375


def test_exact_percentile_hot_value(spark):
    # One value holds a third of the rows and sits on the median.
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(50.0)).otherwise(F.rand(3) * 100).alias("x"))
    got = exact_percentile(df, "x", 0.5).first()["value"]
    assert got == pytest.approx(df.agg(F.percentile("x", 0.5)).first()[0], rel=1e-12)


def test_select_ranks_of_plain_rows(spark):
    """Rows need not be counted by value first."""
    rng = random.Random(3)
    values = sorted(rng.choice([7, rng.randint(0, 1 << 40)]) for _ in range(500))
    rows = spark.createDataFrame([(0, v, 1) for v in values], "g int, key long, n long")
    targets = spark.createDataFrame([(0, r, r) for r in (1, 200, 251, 500)], "g int, t int, rank long")
    got = {r.t: (r.key, r.nth) for r in select_ranks(rows, targets, key_span(rows)).collect()}
    assert got == {r: (values[r - 1], r - values.index(values[r - 1])) for r in (1, 200, 251, 500)}


def test_percentiles_of_several_columns_share_the_passes(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, rng.randint(-5, 5)]), rng.random(), None, rng.randint(0, 10 ** 12) / 1000) for _ in range(999)]
    df = spark.createDataFrame(rows, "a int, b double, c double, d double")
    got = exact_percentiles(df, {"a": ("a", .5, None), "b": ("b", .25, None), "c": ("c", .5, None), "d": ("d", .9, 1000)}).first()
    for name, p in (("a", .5), ("b", .25), ("d", .9)):
        assert got[name] == pytest.approx(df.agg(F.percentile(name, p)).first()[0], rel=1e-12)
    assert got["c"] is None


def test_median_shuffles_counts_only(spark):
    """No exchange of the plan, nor of the passes before it, carries values: only counts by digit."""
    df = spark.range(200_000).select((F.rand(5) * 1e6).alias("x"))
    sizes = []

    def watched(under, state, kind, real=ranking._at_digit):
        sizes.append(under.join(spark.createDataFrame([(s[0], s[2]) for s in state], "g int, prefix long").distinct(), ["g", "prefix"])
                     .groupBy("g", "prefix", "digit").count().groupBy("g", "prefix").count().agg(F.max("count")).first()[0])
        return real(under, state, kind)

    plain, ranking._at_digit = ranking._at_digit, watched
    try:
        plan = plan_text(exact_percentile(df, "x", per_unit=10 ** 6), "simple")
    finally:
        ranking._at_digit = plain
    assert len(sizes) == 3 and max(sizes) <= 1 << 16
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("prefix" in line or "digit" in line or "key" in line for line in exchanges)


@pytest.mark.parametrize("alphabet", ["ab", "aé\u0000z", "0123456789abcdef"])
def test_select_text_ranks(spark, alphabet):
    rng = random.Random(len(alphabet))
    ids = {"".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9))) for _ in range(400)}
    parts = [(0, i) for i in ids] + [(1, i) for i in ids if len(i) > 4]
    rows = spark.createDataFrame(parts, "g int, id string")
    orders = {g: sorted((i for h, i in parts if h == g), key=lambda s: s.encode()) for g in (0, 1)}
    targets = [(g, r) for g in (0, 1) for r in (1, 2, len(orders[g]) // 2, len(orders[g]), len(orders[g]) + 1)]
    few, ranking.FEW_IDS = ranking.FEW_IDS, 5
    try:
        got = select_text_ranks(rows, targets)
    finally:
        ranking.FEW_IDS = few
    assert got == {(g, r): orders[g][r - 1] for g, r in targets if r <= len(orders[g])}


@pytest.mark.parametrize("kind", ["string", "binary", "int", "double"])
def test_ntile_buckets_under_total_ties(spark, kind):
    """All rows tie: the ids alone decide, and none of them is sorted or shuffled."""
    n = 5000
    df = spark.range(n).select(F.md5(F.col("id").cast("string")).alias("s"), "id", F.lit(1).alias("v"))
    who = {"string": F.col("s"), "binary": F.col("s").cast("binary"), "int": F.col("id").cast("int"), "double": F.col("id") * 1.5}[kind]
    df = df.select(who.alias("who"), "v")
    few, ranking.FEW_IDS = ranking.FEW_IDS, 16
    try:
        got = ntile_buckets(df, 5, {"b": ("v", False), "d": ("v", True)}, "who")
    finally:
        ranking.FEW_IDS = few
    plan = plan_text(got, "simple")
    assert "Exchange" not in plan and "Sort" not in plan
    want = df.withColumn("b", F.ntile(5).over(Window.orderBy("v", "who")).cast("long"))
    assert got.select("who", "v", "b").exceptAll(want).count() == 0 and got.where("b <> d").count() == 0


def test_ntile_buckets_of_an_empty_frame(spark):
    assert ntile_buckets(_frame(spark, []), 3, {"b": ("v", False)}, "id").count() == 0
