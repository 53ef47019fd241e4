"""CSV landing (PostgreSQL COPY rules), Parquet layers, surrogate keys, streaming landing."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tests.conftest import ROOT, SF001
from tests.edge_data import BROKEN, KEYED, spark_frames
from tillroll import catalog
from tillroll.model import TABLES
from tillroll.sources.landing import (LOAD_ORDER, LandingError, ParquetShop, create_layers, land_all, land_csv,
                                      publish, register_table, write_table)
from tillroll.sources.testbind import TestShop
from tillroll.streaming import land_csv_stream

EDGE_CSV = (
    'product_id,product_category_name,product_name_length,product_description_length,'
    'product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm\n'
    'p1,"line one\nline ""two""",5,,1,2,3,4,5\n'
    'p2,"",6,7,1,2,3,4,5\n'
    'p3,,,7,1,2,3,4,5\n'
)


def test_csv_edge_fixture(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "products.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write(EDGE_CSV)
    rows = {r.product_id: r for r in land_csv(spark, path, "products").collect()}
    assert rows["p1"].product_category_name == 'line one\nline "two"'   # kept whole
    assert rows["p1"].product_description_length is None                 # unquoted empty integer
    assert rows["p2"].product_category_name == ""                        # quoted empty
    assert rows["p3"].product_category_name is None                      # unquoted empty
    assert rows["p3"].product_name_length is None


def test_csv_without_multiline_splits(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "customers.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n")
        for i in range(20000):
            f.write(f'c{i},u{i},0{i % 100},"city, {i % 7}",\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = land_csv(spark, path, "customers", multiline=False)
        assert df.rdd.getNumPartitions() > 1
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 20000 and rows[0].customer_city.startswith("city, ") and rows[0].customer_state is None


def _canonical(shop):
    t = shop.all_tables()
    t["orders"] = shop.orders()
    return t


def _write_csv(df, path):
    # Written the way the shop export is: header, quoted text, NULL as an empty field.
    (df.coalesce(1).write.mode("overwrite").option("header", "true")
       .option("escape", '"').option("nullValue", "").option("emptyValue", '""')
       .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))


def test_land_all_round_trip(spark, tmpdir_fresh):
    src = TestShop(spark, SF001)
    tables = _canonical(src)
    csv_dir = os.path.join(tmpdir_fresh, "csv")
    names = {}
    for name, df in tables.items():
        # Full file width in file order (missing attributes as NULL); ids are numbers in
        # the test tables and text in the model, so they are written as text.
        fields = TABLES[name].file_schema.fields
        out = df.select([(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(
            "string" if f.name.endswith("_id") else f.dataType).alias(f.name) for f in fields])
        _write_csv(out, os.path.join(csv_dir, name))
        names[name] = name
    layers = create_layers(spark, os.path.join(tmpdir_fresh, "warehouse"))
    land_all(spark, csv_dir, layers["raw"], names, check_keys=False)
    landed = ParquetShop(spark, layers["raw"])
    for name in LOAD_ORDER:
        a = landed.all_tables()[name]
        b = tables[name]
        if name == "order_reviews":
            keys = [r.review_sk for r in a.select("review_sk").collect()]
            assert sorted(keys) == list(range(1, len(keys) + 1))              # dense BIGSERIAL
            a, b = a.drop("review_sk"), b.drop("review_sk")
        b = b.select([(F.col(c) if c in b.columns else F.lit(None)).cast(a.schema[c].dataType).alias(c)
                      for c in a.columns])
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name
    # a job runs unchanged on the landed layer and its result can be published
    res = catalog.run_on(landed, "business_summary")
    path = publish(res, layers["analytics"], "business_summary")
    assert spark.read.parquet(path).count() == 1


def test_streaming_landing_two_batches(spark, tmpdir_fresh):
    header = ("review_id,order_id,review_score,review_comment_title,review_comment_message,"
              "review_creation_date,review_answer_timestamp\n")
    inbox = os.path.join(tmpdir_fresh, "inbox")
    os.makedirs(inbox)
    raw = os.path.join(tmpdir_fresh, "raw")
    ckpt = os.path.join(tmpdir_fresh, "ckpt")
    with open(os.path.join(inbox, "a.csv"), "w") as f:
        f.write(header + 'r1,o1,5,,"great\nthanks",2018-01-01 10:00:00,\nr1,o2,4,,,2018-01-02 10:00:00,\n')
    land_csv_stream(spark, "order_reviews", inbox, raw, checkpoint=ckpt).awaitTermination()
    with open(os.path.join(inbox, "b.csv"), "w") as f:
        f.write(header + "r3,o3,1,,,2018-01-03 10:00:00,\n")
    land_csv_stream(spark, "order_reviews", inbox, raw, checkpoint=ckpt).awaitTermination()
    landed = ParquetShop(spark, raw).order_reviews()
    rows = sorted(landed.collect(), key=lambda r: r.review_sk)
    assert [r.review_sk for r in rows] == [1, 2, 3]
    assert rows[2].review_id == "r3"
    assert rows[0].review_comment_message == "great\nthanks"
    assert "_batch" not in landed.columns


def test_land_all_bucketed_from_csv(spark, tmpdir_fresh):
    src = TestShop(spark, SF001)
    tables = _canonical(src)
    csv_dir = os.path.join(tmpdir_fresh, "csv")
    for name, df in tables.items():
        fields = TABLES[name].file_schema.fields
        out = df.select([(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(
            "string" if f.name.endswith("_id") else f.dataType).alias(f.name) for f in fields])
        _write_csv(out, os.path.join(csv_dir, name))
    raw = os.path.join(tmpdir_fresh, "raw")
    land_all(spark, csv_dir, raw, {t: t for t in LOAD_ORDER}, buckets=4, database="raw_landed_bucketed",
             check_keys=False)
    landed = ParquetShop(spark, raw, database="raw_landed_bucketed")
    got = catalog.run_on(landed, "business_summary").collect()
    want = catalog.run_on(src, "business_summary").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert spark.catalog.tableExists("order_items", "raw_landed_bucketed")


REVIEW_HEADER = ("review_id,order_id,review_score,review_comment_title,review_comment_message,"
                 "review_creation_date,review_answer_timestamp\n")


def _reviews(folder, name, ids):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(REVIEW_HEADER + "".join(f'{i},o,5,,"a\nb",2018-01-01 10:00:00,\n' for i in ids))


def test_review_keys_follow_file_and_place(spark, tmpdir_fresh):
    _reviews(tmpdir_fresh, "a.csv", ["a0"])
    _reviews(tmpdir_fresh, "b.csv", [f"b{i}" for i in range(40)])          # the larger file is read first
    _reviews(tmpdir_fresh, "c.csv", ["c0", "c1"])
    got = {r.review_sk: r.review_id for r in land_csv(spark, tmpdir_fresh, "order_reviews").collect()}
    want = ["a0", *[f"b{i}" for i in range(40)], "c0", "c1"]
    assert got == {k + 1: v for k, v in enumerate(want)}


def test_registering_again_moves_the_table(spark, tmpdir_fresh):
    for name, n in (("one", 3), ("two", 5)):
        spark.range(n).write.parquet(f"{tmpdir_fresh}/{name}")
        register_table(spark, f"{tmpdir_fresh}/{name}", "raw_moved", "t")
        assert spark.table("raw_moved.t").count() == n
    spark.range(2).write.mode("overwrite").saveAsTable("raw_moved.managed")
    with pytest.raises(ValueError):
        register_table(spark, f"{tmpdir_fresh}/one", "raw_moved", "managed")


def test_bucketed_write_has_one_file_a_bucket(spark, tmpdir_fresh):
    df = spark.range(0, 5000, 1, 16).select(F.col("id").alias("order_id"))
    out = write_table(df, tmpdir_fresh, "orders", bucket_by=("order_id", 8), database="raw_files")
    assert len([f for f in os.listdir(out) if f.endswith(".parquet")]) == 8
    assert spark.table("raw_files.orders").count() == 5000


def test_layers_are_created(spark, tmpdir_fresh):
    layers = create_layers(spark, f"{tmpdir_fresh}/shop")
    assert all(os.path.isdir(p) for p in layers.values())


def test_failed_write_keeps_the_old_table(spark, tmpdir_fresh):
    write_table(spark.range(3), tmpdir_fresh, "t")
    bad = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception):
        write_table(bad, tmpdir_fresh, "t")
    assert spark.read.parquet(f"{tmpdir_fresh}/t").count() == 3


def test_load_with_broken_keys_replaces_nothing(spark, tmpdir_fresh):
    frames = spark_frames(spark, KEYED)
    csv_dir, raw = os.path.join(tmpdir_fresh, "csv"), os.path.join(tmpdir_fresh, "raw")
    for name, df in frames.items():
        _write_csv(df.select(*TABLES[name].file_schema.names), os.path.join(csv_dir, name))
    names = {t: t for t in LOAD_ORDER}
    land_all(spark, csv_dir, raw, names)
    before = {t: ParquetShop(spark, raw).all_tables()[t].count() for t in LOAD_ORDER}
    for name, df in spark_frames(spark, BROKEN).items():
        _write_csv(df.select(*TABLES[name].file_schema.names), os.path.join(csv_dir, name))
    with pytest.raises(LandingError) as e:
        land_all(spark, csv_dir, raw, names)
    said = str(e.value)
    for part in ("customers: customer_id", "orders: order_id", "products: product_id", "order_payments: order_id",
                 "product_category_translation: product_category_name", "orders.customer_id", "order_items.order_id",
                 "order_items.product_id", "order_payments.order_id", "customer_unique_id is NULL"):
        assert part in said, part
    assert {t: ParquetShop(spark, raw).all_tables()[t].count() for t in LOAD_ORDER} == before
    assert not [f for f in os.listdir(tmpdir_fresh) if "__new" in f]


def test_stream_goes_on_in_a_new_session(tmpdir_fresh):
    """Two contexts, no checkpoint given: the second lands only what is new."""
    code = """
import sys
from tillroll.session import build_session
from tillroll.streaming import land_csv_stream
spark = build_session("local[2]", 2, extra={"spark.checkpoint.dir": sys.argv[1] + "/ckpt"})
for _ in range(int(sys.argv[2])):
    land_csv_stream(spark, "order_reviews", sys.argv[1] + "/inbox", sys.argv[1] + "/raw").awaitTermination()
print("ROWS", sorted(r.review_sk for r in spark.read.parquet(sys.argv[1] + "/raw/order_reviews").collect()))
"""
    def run(times):
        out = subprocess.run([sys.executable, "-c", code, tmpdir_fresh, str(times)], capture_output=True, text=True,
                             cwd=ROOT, timeout=240, env=os.environ | {"PYTHONPATH": ROOT})
        return next((line for line in out.stdout.splitlines() if line.startswith("ROWS")), out.stderr[-2000:])

    inbox = os.path.join(tmpdir_fresh, "inbox")
    _reviews(inbox, "a.csv", ["a0", "a1", "a2"])
    assert run(2) == "ROWS [1, 2, 3]"
    _reviews(inbox, "b.csv", ["b0"])
    assert run(1) == "ROWS [1, 2, 3, 4]"
