"""Corpus pipeline: quality rules, near-duplicates, decontamination, secrets, tokens.

Each stage is ``fn(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet
and read again as the next stage's ``docs``.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import bpe, decontaminate, line_quality, secrets, simhash
from tillroll.session import ensure_checkpoint_dir

STAGES = [
    ("quality_rules", line_quality.stage),
    ("simhash_dedup", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("secret_scan", secrets.stage),
    ("byte_bpe", bpe.stage),
]
# Trained and iterative stages: SQL cannot express them; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between them lies in the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
