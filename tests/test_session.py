"""Checkpoint directory handling and replay safety of the streaming sink."""

import os

from tillroll.session import ensure_checkpoint_dir
from tillroll.streaming.landing import _writer


def test_checkpoint_dir_comes_from_the_session(spark):
    configured = spark.sparkContext.getCheckpointDir()
    assert configured                                  # set by the session (or the test fixture)
    assert ensure_checkpoint_dir(spark) == configured  # never replaced by the library


def test_replayed_batch_replaces_its_output(spark, tmpdir_fresh):
    rows = [("r1", "o1", 5, None, None, None, None), ("r2", "o2", 3, None, None, None, None)]
    schema = ("review_id string, order_id string, review_score int, review_comment_title string, "
              "review_comment_message string, review_creation_date timestamp_ntz, "
              "review_answer_timestamp timestamp_ntz")
    batch = spark.createDataFrame(rows, schema)
    out = os.path.join(tmpdir_fresh, "order_reviews")
    write = _writer("order_reviews", out)
    write(batch, 0)
    write(spark.createDataFrame(rows[:1], schema), 1)
    write(spark.createDataFrame(rows[:1], schema), 1)      # batch 1 replayed after a failure
    landed = spark.read.parquet(out)
    assert landed.count() == 3
    assert sorted(r.review_sk for r in landed.collect()) == [1, 2, 3]
