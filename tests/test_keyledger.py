"""Generated keys: the same numbers by batch, by stream, after a replay and beside new files."""

import os
import shutil

import pytest

from tests.test_landing import _reviews
from tillroll.sources.keyledger import read_ledger
from tillroll.sources.landing import ParquetShop, key_ledger, land_csv
from tillroll.streaming import land_csv_stream


def _keys(df):
    rows = {r.review_sk: r.review_id for r in df.collect()}
    assert sorted(rows) == list(range(1, len(rows) + 1))
    return rows


def _stream(spark, inbox, raw):
    land_csv_stream(spark, "order_reviews", inbox, raw).awaitTermination()
    return _keys(ParquetShop(spark, raw).order_reviews())


def test_batch_and_stream_give_the_same_keys(spark, tmpdir_fresh):
    inbox, raw = os.path.join(tmpdir_fresh, "inbox"), os.path.join(tmpdir_fresh, "raw")
    _reviews(inbox, "a.csv", [f"a{i}" for i in range(3)])
    _reviews(inbox, "c.csv", [f"c{i}" for i in range(50)])              # the larger file is read first
    _reviews(inbox, "d.csv", [])
    streamed = _stream(spark, inbox, raw)
    assert streamed == _keys(land_csv(spark, inbox, "order_reviews"))   # a first batch load
    _reviews(inbox, "b.csv", ["b0", "b1"])                              # late, though second by name
    streamed = _stream(spark, inbox, raw)
    assert [streamed[k] for k in (1, 54, 55)] == ["a0", "b0", "b1"]
    ledger = key_ledger(raw, "order_reviews")
    assert _keys(land_csv(spark, inbox, "order_reviews", key_ledger=ledger)) == streamed
    assert read_ledger(spark, ledger).count() == 4
    assert _keys(land_csv(spark, inbox, "order_reviews")) != streamed   # a load of its own goes by path


def test_a_replayed_batch_keeps_its_keys(spark, tmpdir_fresh):
    inbox, raw = os.path.join(tmpdir_fresh, "inbox"), os.path.join(tmpdir_fresh, "raw")
    _reviews(inbox, "a.csv", ["a0", "a1"])
    first = _stream(spark, inbox, raw)
    shutil.rmtree(os.path.join(raw, "_stream"))                          # progress is lost, data and ledger are not
    _reviews(inbox, "b.csv", ["b0"])
    assert _stream(spark, inbox, raw) == first | {3: "b0"}


def test_a_changed_file_is_told(spark, tmpdir_fresh):
    inbox, ledger = os.path.join(tmpdir_fresh, "inbox"), os.path.join(tmpdir_fresh, "ledger")
    _reviews(inbox, "a.csv", ["a0", "a1"])
    _keys(land_csv(spark, inbox, "order_reviews", key_ledger=ledger))
    _reviews(inbox, "a.csv", ["a0", "a1", "a2"])
    with pytest.raises(Exception, match="has changed since"):
        land_csv(spark, inbox, "order_reviews", key_ledger=ledger).collect()


def test_a_layer_from_before_the_ledger(spark, tmpdir_fresh):
    inbox, raw = os.path.join(tmpdir_fresh, "inbox"), os.path.join(tmpdir_fresh, "raw")
    _reviews(inbox, "a.csv", ["a0", "a1"])
    _stream(spark, inbox, raw)
    shutil.rmtree(key_ledger(raw, "order_reviews"))
    _reviews(inbox, "b.csv", ["b0"])
    assert _stream(spark, inbox, raw)[3] == "b0"
