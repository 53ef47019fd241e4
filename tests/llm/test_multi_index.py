import math

import numpy as np

from tests.llm.helpers import SF
from tillroll.llm import multi_index as M

DDL = "vec_id long, embedding array<double>, id string, `c1` int, `a.b` int"


def table(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], "x", 3, 1) for i, v in rows], DDL)


def plain(rows, every=20, k=20):
    out = {}
    for q, u in rows:
        if q % every == 0:
            near = sorted((-M.exact_scores(np.array([u]), np.array([v]))[0], i) for i, v in rows if i != q and len(v) == len(u))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def found(df, **more):
    out = {}
    for r in sorted(M.nearest(df, **more).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    hit = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in near}) for q, near in want.items())
    return hit / sum(map(len, want.values()))


def test_recall_of_the_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, got = plain(rows), {}
    for r in M.op13_multi_index(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    scores = {(q, i): s for q, near in plain(rows, k=10 ** 9).items() for i, s in near}
    assert all(scores[q, i] == s for q, near in got.items() for i, s in near)
    assert all(len(near) == 20 for near in got.values()) and recall(got, want) >= .9


def test_clusters_need_few_cells(spark):
    """On clustered rows of many lengths the walk stops early and still finds the neighbours."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * rng.uniform(.5, 2, size=(40, 1))
    x = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16)) * .15
    rows = list(enumerate(x.tolist()))
    df = table(spark, rows)
    used = M.prepare(df, "vec_id", "embedding")
    books = M.fit(used)
    index = M.index_rows(used, books)
    met = M.recall_at(index, books, M.cell_counts(index, books), 20)
    assert index.count() == 6000 and met[int(.97 * len(met))] < .5
    assert recall(found(df, query_every=100), plain(rows, 100)) >= .9


def test_full_recall_is_exact_with_copies_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(400, 6)), 1)
    x[::3] = x[0]
    rows = [(i, v) for i, v in enumerate(x.tolist()) if any(v)]
    monkeypatch.setattr(M, "BLOCK_ROWS", 30)
    monkeypatch.setattr(M, "GROUP_QUERIES", 5)
    monkeypatch.setattr(M, "QUERY_SLICE", 3)
    books = M.Book((np.zeros((1, 4)), np.zeros((1, 4))), (1.0, 1.0))
    monkeypatch.setattr(M, "fit", lambda rows: {6: books})            # one cell: everything is visited
    assert found(table(spark, rows)) == plain(rows)


def test_walk_is_in_order_and_complete():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 5, 7).astype(float), rng.normal(size=5)
    cells = list(M.walk(a, b))
    assert sorted(cells) == [(i, j) for i in range(7) for j in range(5)]
    assert np.all(np.diff([a[i] + b[j] for i, j in cells]) >= 0)


def test_rows_without_part_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0]), (20, [3.0]), (21, [2.0]), (40, [1.0, 2.0, 3.0])]
    junk = [(3, None), (4, []), (5, [0.0, 0.0]), (6, [math.nan, 1.0]), (7, [None, 1.0]), (8, [math.inf, 1.0]), (None, [1.0, 1.0]),
            (1, [9.0, 9.0]), (60, [0.0, 0.0])]
    assert found(table(spark, rows + junk)) == {0: [(1, .5), (2, -1.0)], 20: [(21, 6.0)]}
    assert found(table(spark, [])) == {} and found(table(spark, rows[:1])) == {}
