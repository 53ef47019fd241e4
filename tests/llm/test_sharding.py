"""Stratified shards: the law, the mixture, equality with SQL, edge cases."""

import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tests.llm.helpers import SF, docs_of, frame
from tests.oracle import canon
from tillroll.llm import sharding as S


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert canon(S.op4_stratified_shards(spark, SF).toPandas()) == canon(con.execute(S.OP4_SQL).df())


@pytest.mark.parametrize("bucket_rows", [20_000, 3])
def test_law_and_mixture(spark, monkeypatch, bucket_rows):
    """Counts at most one apart, slots gapless, every source spread evenly; many buckets change nothing."""
    monkeypatch.setattr(S, "BUCKET_ROWS", bucket_rows)
    docs = docs_of(spark)
    texts = {r.doc_id: r for r in docs.collect()}
    rows = S.stratified_shards(docs, shards=7).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r)
        raw = texts[r.doc_id].text.encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw) and r.law == "rows" and r.grown_shard is None
    sizes = [len(v) for v in by_shard.values()]
    assert len(by_shard) == 7 and max(sizes) - min(sizes) <= 1
    for part in by_shard.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    for source, n in Counter(r.source for r in rows).items():
        per = [sum(r.source == source for r in by_shard[k]) for k in range(7)]
        assert max(per) - min(per) <= 2 and sum(per) == n
    if bucket_rows == 3:
        monkeypatch.setattr(S, "BUCKET_ROWS", 20_000)
        assert sorted(map(str, S.stratified_shards(docs, shards=7).collect())) == sorted(map(str, rows))


def test_main_path_is_native(spark):
    plan = S.op4_stratified_shards(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edges(spark):
    assert S.stratified_shards(frame(spark, [], source="s")).count() == 0
    rows = spark.createDataFrame([(1, None, None, 9), (1, None, None, 9), (None, "", "a", 9), (2, "x", "", 9), (3, "é" * 9, "a", 9)],
                                 "doc_id long, text string, source string, shard int")
    got = S.stratified_shards(rows).collect()
    assert len({r.shard for r in got}) == 5 and {r.slot for r in got} == {0}
    assert sorted(r.size for r in got) == [8, 8, 8, 9, 26]


def test_written_shards(spark, tmpdir_fresh):
    docs = docs_of(spark)
    S.write_shards(docs, f"{tmpdir_fresh}/shards", shards=5)
    back = spark.read.parquet(f"{tmpdir_fresh}/shards")
    assert sorted(r.doc_id for r in back.collect()) == sorted(r.doc_id for r in docs.collect())
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [40] * 5
