"""Small frames and plain versions that the operators are compared with."""

import random
import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, **extra):
    """documents-like frame: doc_id 0.., text, and constant extra columns."""
    rows = [(i, t, *extra.values()) for i, t in enumerate(texts)]
    ddl = "doc_id long, text string" + "".join(f", `{k}` {type(v).__name__.replace('str', 'string')}" for k, v in extra.items())
    return spark.createDataFrame(rows, ddl)


def docs_of(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def prose(seed, n):
    rng = random.Random(seed)
    words = "the of stone river carries light over old walls and people walk slowly home while rain falls on dark roofs".split()
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ed"]) for _ in range(n))
