"""Approximate nearest neighbours by largest inner product: an inverted multi-index.

Every vector is cut into two halves.  Each half gets one coordinate more that lifts it
to the greatest half length of the table, so the distance between a query's half and a
row's half orders rows as their inner product does.  Each half has a codebook (Lloyd's
steps on at most ``SAMPLE`` rows by id hash); a row lies in the cell of its two nearest
centroids, and every row is indexed.

A query walks the centroid pairs by summed distance with a heap until the visited cells
hold the calibrated share of all rows; the rows of these cells are then scored exactly.
The share is measured, not guessed: for ``PROBES`` sampled queries the true neighbours
among all rows are found by brute force, and the smallest share is taken that finds
``RECALL`` of them.  ``recall_at`` gives the measured curve.

Rows are dealt by the first centroid, split by id hash into parts of about
``BLOCK_ROWS``; queries into groups of about ``GROUP_QUERIES``.  A cogroup holds one part
and one group, so neither a copied vector nor a crowded cell fills a task.

Edge cases: rows with a null id, a null, empty or zero vector or a null or non-finite
component take no part; of rows that repeat an id the least vector counts; rows of
different lengths never meet, and lengths outside of the ``DIMS`` commonest of the sample
are searched whole; ties go to the smaller id; fewer candidates give fewer rows; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.vectors import (all_groups, best, first_copies, group_of, groups_for, matrix, parts_of,
                                  sample_by_hash, single_rows, usable_rows)
from tillroll.session import ensure_checkpoint_dir

SAMPLE = 8_192
DIMS = 8
PROBES = 64
RECALL = 0.97
CELL_ROWS = 32                 # rows a cell is meant to hold
MOST_CENTROIDS = 64             # of a half, so a table has 4,096 cells at most
STEPS = 12
BLOCK_ROWS = 8_192
GROUP_QUERIES = 1_024
QUERY_SLICE = 128


@dataclass
class Book:
    """Codebooks of one vector length: centroids of both (lifted) halves and the halves' greatest lengths."""
    halves: tuple[np.ndarray, np.ndarray]
    reach: tuple[float, float]

    def cut(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (x.shape[1] + 1) // 2
        return x[:, :at], x[:, at:]

    def lifted(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.column_stack([h, np.sqrt(np.maximum(r * r - (h * h).sum(axis=1), 0))])
                for h, r in zip(self.cut(x), self.reach)]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(_distances(h, c).argmin(axis=1) for h, c in zip(self.lifted(x), self.halves))

    def distances(self, q: np.ndarray) -> list[np.ndarray]:
        """Of queries, whose added coordinate is zero, to the centroids of each half."""
        return [_distances(np.column_stack([h, np.zeros(len(h))]), c) for h, c in zip(self.cut(q), self.halves)]


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (centroids * centroids).sum(axis=1)[None, :] - 2 * (x @ centroids.T) + (x * x).sum(axis=1)[:, None]


def codebook(x: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """Lloyd's centroids of ``x`` from k distinct starting rows; an emptied one keeps its place."""
    rng = np.random.default_rng(seed)
    rows = np.unique(x, axis=0)
    centroids = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(STEPS):
        nearest = _distances(x, centroids).argmin(axis=1)
        count = np.bincount(nearest, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, nearest, x)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
    return centroids


def walk(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Centroid pairs by summed distance: the multi-sequence algorithm over both sorted lists."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db = first[a].tolist(), second[b].tolist()
    heap = [(da[0] + db[0], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        if j + 1 < len(db):                 # the right neighbour; the lower one enters only from the first column
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(da):
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    return np.cumsum(a * b, axis=1)[:, -1]


def fit(rows: DataFrame, cell_rows: int = CELL_ROWS) -> dict[int, Book]:
    """Codebooks for the commonest vector lengths of a bounded sample."""
    sample = sample_by_hash(rows, SAMPLE, "vec", "dim")
    dims = sample.column("dim").to_numpy()
    found, counts = np.unique(dims, return_counts=True)
    common = [int(d) for d in found[np.argsort(-counts, kind="stable")][:DIMS] if d >= 2]
    if not common:
        return {}

    def reach(part):
        return F.max(F.sqrt(F.aggregate(part, F.lit(0.0), lambda s, x: s + x * x)))

    at = ((F.col("dim") + 1) / 2).cast("int")
    size = {r["dim"]: r for r in rows.where(F.col("dim").isin(common)).groupBy("dim").agg(
        F.count("*").alias("n"), reach(F.slice("vec", F.lit(1), at)).alias("a"),
        reach(F.slice("vec", at + 1, F.col("dim") - at)).alias("b")).collect()}
    books = {}
    for dim in common:
        k = int(min(MOST_CENTROIDS, max(2, (size[dim]["n"] / cell_rows) ** 0.5)))
        book = Book((np.zeros((0, 0)), np.zeros((0, 0))), (size[dim]["a"], size[dim]["b"]))
        halves = book.lifted(matrix(sample.filter(pa.array(dims == dim)).column("vec")))
        if all(np.isfinite(h).all() for h in halves):
            books[dim] = Book((codebook(halves[0], k), codebook(halves[1], k)), book.reach)
    return books


def _cells_task(books: dict[int, Book]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            c1, c2 = np.zeros(len(dims), np.int32), np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                if (book := books.get(int(dim))) is not None:
                    mine = dims == dim
                    c1[mine], c2[mine] = book.cells(matrix(batch.filter(pa.array(mine)).column("vec")))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "vec", "dim")], pa.array(c1), pa.array(c2)],
                                             names=["id", "vec", "dim", "c1", "c2"])
    return run


def index_rows(rows: DataFrame, books: dict[int, Book]) -> DataFrame:
    """Every row with its cell (c1, c2) and its part of the first centroid's list."""
    cells = rows.select("id", "vec", "dim").mapInArrow(_cells_task(books), "id long, vec array<double>, dim int, c1 int, c2 int")
    return parts_of(cells, ["dim", "c1"], BLOCK_ROWS).checkpoint()


def _truth_task(probes: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Each task's best rows for every probe, by brute force."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                if int(dim) not in probes:
                    continue
                rows, (pid, q) = batch.filter(pa.array(dims == dim)), probes[int(dim)]
                ids, x = rows.column("id").to_numpy(), matrix(rows.column("vec"))
                near = q @ x.T
                near[pid[:, None] == ids[None, :]] = -np.inf
                top = np.argsort(-near, axis=1, kind="stable")[:, :k]
                flat = top.ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(pid, top.shape[1])), pa.array(ids[flat]), pa.array(np.take_along_axis(near, top, 1).ravel()),
                     rows.column("dim").take(pa.array(flat)), rows.column("c1").take(pa.array(flat)), rows.column("c2").take(pa.array(flat))],
                    names=["id", "other", "score", "dim", "c1", "c2"])
    return run


def recall_at(index: DataFrame, books: dict[int, Book], counts: dict[int, dict], k: int) -> np.ndarray:
    """Sorted shares of the table that a walk must visit to meet each true neighbour of the probes.

    The share at position p of the result finds (p + 1) / length of the neighbours.
    """
    sample = sample_by_hash(index.where(F.col("dim").isin(list(books))), PROBES, "id", "vec", "dim")
    dims = sample.column("dim").to_numpy()
    probes = {int(d): (sample.column("id").to_numpy()[dims == d], matrix(sample.filter(pa.array(dims == d)).column("vec")))
              for d in np.unique(dims)}
    found = best(index.mapInArrow(_truth_task(probes, k), "id long, other long, score double, dim int, c1 int, c2 int"),
                 ["id"], k).where("score > double('-Infinity')").collect()           # k rows a probe
    met: dict[tuple[int, int], dict[tuple[int, int], float]] = {}
    for dim, (pid, q) in probes.items():
        d1, d2 = books[dim].distances(q)
        total = sum(counts[dim].values())
        for i, one in enumerate(pid):
            seen, at = 0, {}
            for cell in walk(d1[i], d2[i]):
                seen += counts[dim].get(cell, 0)
                at[cell] = seen / total
            met[dim, int(one)] = at
    return np.sort([met[r["dim"], r["id"]][r["c1"], r["c2"]] for r in found])


def _walk_task(books: dict[int, Book], counts: dict[int, dict], share: float, k: int):
    """Queries to (query, first centroid, second centroids) of the cells that the walk visits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            source, c1, c2 = [], [], []
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                if (book := books.get(int(dim))) is None:
                    source.extend(mine), c1.extend([0] * len(mine)), c2.extend([[0]] * len(mine))
                    continue
                held = counts[int(dim)]
                enough = max(share * sum(held.values()), k + 1)
                d1, d2 = book.distances(matrix(batch.filter(pa.array(dims == dim)).column("vec")))
                for row, a, b in zip(mine, d1, d2):
                    seen, lists = 0, {}
                    for i, j in walk(a, b):
                        if n := held.get((i, j), 0):
                            lists.setdefault(i, []).append(j)
                            seen += n
                            if seen >= enough:
                                break
                    source.extend([row] * len(lists)), c1.extend(lists), c2.extend(lists.values())
            if source:
                at = pa.array(np.array(source, np.int64))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("id", "vec", "dim")],
                                                  pa.array(c1, pa.int32()), pa.array(c2, pa.list_(pa.int32()))],
                                                 names=["id", "vec", "dim", "c1", "lists"])
    return run


def _rerank_task(k: int):
    """Cogroup function: the k best rows of a part for every query of a group, among the cells it visits."""
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if rows.num_rows and queries.num_rows:
            rows = rows.sort_by("id")
            x, cell = matrix(rows.column("vec")), rows.column("c2").to_numpy()
            keep = first_copies(x + 0.0, k + 1)
            ids, x, cell = rows.column("id").to_numpy()[keep], x[keep], cell[keep]
            q, qid = matrix(queries.column("vec")), queries.column("id").to_numpy()
            lists = queries.column("lists").to_pylist()
            longest = np.linalg.norm(x, axis=1).max()
            for start in range(0, len(qid), QUERY_SLICE):
                at = slice(start, start + QUERY_SLICE)
                near = q[at] @ x.T
                wanted = np.zeros((len(near), int(cell.max()) + 1), bool)
                for i, own in enumerate(lists[at]):
                    wanted[i, [c for c in own if c < wanted.shape[1]]] = True
                near[~wanted[:, cell] | (qid[at, None] == ids[None, :])] = -np.inf
                for i, line in enumerate(near):
                    last = np.partition(line, -k)[-k] if len(line) > k else -np.inf
                    # a product in another order may differ in its last bits: what could, is compared exactly
                    slack = 1e-12 * longest * np.linalg.norm(q[start + i]) * x.shape[1]
                    who = np.flatnonzero((line >= last - slack) & (line > -np.inf))
                    score = exact_scores(q[start + i][None, :], x[who])
                    top = np.argsort(-score, kind="stable")[:k]
                    out[0].extend([qid[start + i]] * len(top))
                    out[1].extend(ids[who[top]])
                    out[2].extend(score[top])
        return pa.table({"id": pa.array(out[0], pa.int64()), "other": pa.array(out[1], pa.int64()),
                         "score": pa.array(out[2], pa.float64())})
    return run


def prepare(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    rows = usable_rows(df, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    return single_rows(rows)


def cell_counts(index: DataFrame, books: dict[int, Book]) -> dict[int, dict]:
    """Rows of every cell, 4,096 cells at most for each of at most ``DIMS`` lengths."""
    counts: dict[int, dict] = {d: {} for d in books}
    for r in index.where(F.col("dim").isin(list(books))).groupBy("dim", "c1", "c2").count().collect():
        counts[r["dim"]][r["c1"], r["c2"]] = r["count"]
    return counts


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", query_every: int = 20, k: int = 20,
            recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for ids divisible by ``query_every`` the ``k`` rows of largest inner product found."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = prepare(df, id_col, vec_col)
    books = fit(rows)
    index = index_rows(rows, books)
    counts = cell_counts(index, books)
    met = recall_at(index, books, counts, k) if books else np.zeros(0)
    share = float(met[max(0, int(np.ceil(recall * len(met))) - 1)]) if len(met) else 1.0
    asked = index.where(F.pmod("id", F.lit(query_every)) == 0)
    groups = groups_for(asked.count(), GROUP_QUERIES)
    key = ["group", "dim", "c1", "part"]
    visits = (asked.select("id", "vec", "dim").mapInArrow(
        _walk_task(books, counts, share, k), "id long, vec array<double>, dim int, c1 int, lists array<int>")
        .withColumn("group", group_of(groups)))
    parts = index.select("dim", "c1", "part").distinct()
    visits = visits.join(parts, ["dim", "c1"])
    found = (index.withColumn("group", all_groups(groups)).groupBy(*key)
             .cogroup(visits.select(*[F.col(c).alias(c) for c in visits.columns]).groupBy(*key))
             .applyInArrow(_rerank_task(k), "id long, other long, score double"))
    return best(found, ["id"], k).select(F.col("id").alias("query_id"), "rank", F.col("other").alias("vec_id"), "score")


def op13_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
