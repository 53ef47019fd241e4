"""The pipeline: stages chained by hand, decisions that take effect, tables left alone."""

import corpus_pipeline as P
import pytest

from tests.llm.helpers import SF, docs_of
from tillroll.llm import decontaminate, line_quality, registry, secrets, simhash

STAGE_NAMES = ["quality_rules", "simhash_dedup", "decontamination", "secret_scan", "byte_bpe"]


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returned, as lists of rows."""
    docs, out = docs_of(spark), {}
    for name, stage in P.STAGES:
        rows = stage(spark, docs, SF)
        if name != STAGE_NAMES[-1]:
            assert rows.columns == docs.columns
        out[name] = rows.collect()
        docs = spark.createDataFrame(out[name], rows.schema)
    return out


def test_names():
    assert [n for n, _ in P.STAGES] == STAGE_NAMES and P.ORACLE_SQL is None and registry.QUERIES["pipeline"] is P.run


def test_stage_decisions(spark, stages):
    docs = docs_of(spark)
    verdict = {r.doc_id: r.kept for r in line_quality.op1_line_quality(spark, SF).collect()}
    assert {r.doc_id for r in stages["quality_rules"]} == {i for i, kept in verdict.items() if kept}
    kept = spark.createDataFrame(stages["quality_rules"], docs.schema)
    groups = {r.component_id for r in simhash.simhash_components(kept).collect()}
    assert sorted(r.doc_id for r in stages["simhash_dedup"]) == sorted(groups)
    left = spark.createDataFrame(stages["simhash_dedup"], docs.schema)
    bad = {r.id for r in decontaminate.leaks(left, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in stages["decontamination"]} == groups - bad
    assert [r.doc_id for r in stages["secret_scan"]] == [r.doc_id for r in stages["decontamination"]]
    clean = spark.createDataFrame(stages["secret_scan"], docs.schema)
    assert sum(r.n_spans for r in secrets.secret_scan(clean).collect()) == 0
    assert all(r.n_chars == len(r.text) for r in stages["secret_scan"])
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in stages["byte_bpe"])


def test_run_equals_the_chain(spark, stages):
    got = sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in P.run(spark, SF).collect())
    assert got == sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in stages["byte_bpe"])


def test_empty_documents(spark):
    docs = docs_of(spark).limit(0)
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name
