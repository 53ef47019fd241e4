"""Column helpers: exact rounding, exact sums, guarded ratios, day arithmetic."""

from datetime import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tillroll.functions import (exact_round, exact_sum, fractional_days, month_start, pct, ratio,
                                whole_days)


def test_rounding_is_half_away_from_zero(spark):
    df = spark.createDataFrame([(4.225,), (-4.225,), (2.5,), (-2.5,), (None,)], "x double")
    got = [r[0] for r in df.select(exact_round("x", 2)).collect()]
    assert got == [4.23, -4.23, 2.5, -2.5, None]
    got0 = [r[0] for r in df.select(exact_round("x", 0)).collect()]
    assert got0 == [4.0, -4.0, 3.0, -3.0, None]


def test_exact_sum_and_guards(spark):
    df = spark.createDataFrame([(D("10.05"),), (D("-0.05"),), (None,)], "m decimal(12,2)")
    row = df.agg(exact_sum(df, "m").alias("s"), F.count("m").alias("n")).first()
    assert row.s == D("10.00")
    none = spark.createDataFrame([(None,)], "m decimal(12,2)")
    assert none.agg(exact_sum(none, "m")).first()[0] is None
    r = spark.range(1).select(ratio(F.lit(1), F.lit(0)).alias("a"), pct(F.lit(1), F.lit(0)).alias("b"),
                              pct(F.lit(1), F.lit(3), 2).alias("c")).first()
    assert r.a is None and r.b is None and r.c == 33.33


def test_day_arithmetic(spark):
    df = spark.createDataFrame([(dt(2020, 3, 5, 23), dt(2020, 1, 1)), (dt(2020, 1, 1), dt(2020, 1, 2, 12))],
                               "a timestamp_ntz, b timestamp_ntz")
    rows = df.select(fractional_days("a", "b").alias("f"), whole_days("a", "b").alias("w"),
                     month_start("a").alias("m")).collect()
    assert rows[0].w == 64 and abs(rows[0].f - (64 + 23 / 24)) < 1e-12
    assert rows[1].w == -1 and rows[1].f == -1.5        # truncated toward zero, like EXTRACT(DAY)
    assert str(rows[0].m) == "2020-03-01"


def test_exact_sum_keeps_the_columns_scale(spark):
    df = spark.createDataFrame([(D("0.0050"), D("1.1234567890"), 2), (D("0.0050"), D("0.1"), 3)],
                               "a decimal(12,4), b decimal(30,10), c int")
    row = df.agg(exact_sum(df, "a").alias("a"), exact_sum(df, "b").alias("b"), exact_sum(df, "c").alias("c")).first()
    assert (row.a, row.b, row.c) == (D("0.0100"), D("1.2234567890"), 5)
    floats = spark.createDataFrame([(0.29,)], "m double")
    with pytest.raises(TypeError):
        exact_sum(floats, "m")


def test_shares_are_rounded_once(spark):
    cases = [("4004999.99", "100000000.00", 4.00), ("4005000.00", "100000000.00", 4.01), ("-1", "8", -12.5),
             ("1", "3", 33.33), ("2", "3", 66.67), ("-0.005", "100", -0.01), ("0", "7", 0.0)]
    df = spark.createDataFrame([(D(a), D(b)) for a, b, _ in cases], "a decimal(20,4), b decimal(20,2)")
    assert [r[0] for r in df.select(pct("a", "b")).collect()] == [c for _, _, c in cases]
    assert df.select(ratio("a", F.lit(0))).first()[0] is None


def test_ratio_never_cuts_an_operand(spark):
    df = spark.createDataFrame([(D("0.12345678"), D("3"))], "a decimal(12,8), b decimal(12,8)")
    with pytest.raises(Exception, match="more than 6 decimals"):
        df.select(ratio("a", "b")).collect()
    assert df.select(ratio(F.lit(D("0.120000")), "b", 3)).first()[0] == 0.04
