"""Hard negatives by angular triangle filtering, exact.

Vectors become integers floor(256 * x).  A few reference directions are chosen from a
bounded sample (``SAMPLE`` rows by id hash; they change the speed only) and every row
stores its angle to each of them.  For two rows the triangle inequality of angles puts
their angle between max |a_i - b_i| and min (a_i + b_i, 2 pi - a_i - b_i); the cosines,
times both norms and widened by more than all rounding (``SLACK``), bound the score.
Only pairs whose bounds meet a wanted window of scores are scored, in whole numbers.

Rows are dealt into blocks (nearest reference, split by id hash into parts of about
``BLOCK_ROWS``), anchors into groups of about ``GROUP_ANCHORS``; a cogroup holds one
block and one group, whatever the table or a label or a copied vector weighs.  An anchor
first meets its own block; what it finds there is the floor that other blocks must
reach, and blocks whose angle and norm ranges cannot reach it never see the anchor.

Four passes of one function: best same-label rows at home and everywhere, then, per
positive, best other-label rows within its window at home and everywhere.

Edge cases: rows with a null id, label or vector, an empty vector or a null or
non-finite component take no part; of rows that repeat an id the least (label, then
vector) counts; rows of different lengths never meet; ties go to the smaller id; a
window that holds fewer rows gives fewer, a negative positive score gives none; scores
beyond a long are held exactly for the order and published at the long's limit; a
table without anchors gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.vectors import (all_groups, best, first_copies, group_of, groups_for, matrix, parts_of,
                                  sample_by_hash, single_rows, usable_rows)
from tillroll.session import ensure_checkpoint_dir

SCALE = 256
REFERENCES = 12
SAMPLE = 2_048
SLACK = 2e-5                    # radians; float32 angles are off by less than 1e-6
BLOCK_ROWS = 8_192
GROUP_ANCHORS = 1_024
PAGE_BLOCKS = 256               # block ranges an anchor group is compared with in one task
PAIRS = 1 << 14                 # pairs scored at once
LOW, HIGH = -(1 << 63), (1 << 63) - 1
EXACT = float(1 << 53)


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 * x): doubles where these are exact, Python integers otherwise."""
    if not x.size or np.abs(x).max() < 1 << 40:
        return np.floor(SCALE * x)
    return np.array([[int(np.floor(v * SCALE)) if abs(v) < 1 << 40 else int(v) * SCALE for v in row] for row in x.tolist()],
                    dtype=object).reshape(x.shape)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b``, exact: long, or Python integers beyond."""
    if a.dtype != object and b.dtype != object:
        top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
        if top < EXACT:
            return np.einsum("ij,ij->i", a, b).astype(np.int64)
        if top < float(1 << 62):
            return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    return np.array([sum(int(x) * int(y) for x, y in zip(u, v)) for u, v in zip(a, b)], dtype=object)


def reference_directions(sample: pa.Table, n: int = REFERENCES) -> dict[int, np.ndarray]:
    """Unit vectors by dimension: farthest-first among the sampled rows as whole numbers."""
    dims = sample.column("dim").to_numpy()
    out = {}
    for dim in np.unique(dims):
        q = whole(matrix(sample.filter(pa.array(dims == dim)).column("vec"))).astype(np.float64)
        norm = np.linalg.norm(q, axis=1)
        q = q[(norm > 0) & np.isfinite(norm)] / norm[(norm > 0) & np.isfinite(norm), None]
        if len(q):
            chosen, near = [0], q @ q[0]
            while len(chosen) < n:
                chosen.append(int(np.argmin(near)))
                near = np.maximum(near, q @ q[chosen[-1]])
            out[int(dim)] = q[chosen]
    return out


def _angles_task(refs: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                q = whole(matrix(rows.column("vec")))
                wide = np.array([max(map(abs, r)) >= 1 << 26 for r in q.tolist()]) if q.dtype == object else (
                    np.abs(q).max(axis=1) >= 1 << 26)
                q = np.where(wide[:, None], 0, q).astype(np.float64)
                norm = np.linalg.norm(q, axis=1)
                at = refs.get(int(dim))
                if at is None:                      # a right angle bounds nothing
                    angles = np.full((len(q), REFERENCES), np.pi / 2)
                else:
                    cos = (q @ at.T) / np.where(norm > 0, norm, 1)[:, None]
                    angles = np.arccos(np.clip(cos, -1, 1))
                norm[wide] = np.inf                 # never pruned
                flat = pa.array(angles.astype(np.float32).ravel())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), rows.column("label"), rows.column("vec"), rows.column("dim"), pa.array(norm),
                     pa.ListArray.from_arrays(np.arange(0, flat.__len__() + 1, REFERENCES, dtype=np.int32), flat),
                     pa.array(angles.argmin(axis=1).astype(np.int32))],
                    names=["id", "label", "vec", "dim", "norm", "angles", "ref"])
    return run


def with_angles(rows: DataFrame, refs: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` plus norm, angles to the references and the nearest reference."""
    return rows.select("id", "label", "vec", "dim").mapInArrow(
        _angles_task(refs), "id long, label long, vec array<double>, dim int, norm double, angles array<float>, ref int")


def score_bounds(qa: np.ndarray, qn: np.ndarray, ra: np.ndarray, rn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Safe lower and upper bounds of all scores of queries (angles, norms) against rows."""
    apart = np.zeros((len(qa), len(ra)), np.float32)
    joined = np.full((len(qa), len(ra)), np.float32(np.pi))
    for i in range(qa.shape[1]):
        a, b = qa[:, i, None], ra[None, :, i]
        np.maximum(apart, np.abs(a - b), out=apart)
        total = a + b
        np.minimum(joined, np.minimum(total, np.float32(2 * np.pi) - total), out=joined)
    with np.errstate(invalid="ignore"):
        size = qn[:, None] * rn[None, :]
        high = size * (np.cos(np.maximum(apart - SLACK, 0)) + SLACK) + 1
        low = size * (np.cos(np.minimum(joined + SLACK, np.pi)) - SLACK) - 1
    free = ~np.isfinite(size)
    high[free], low[free] = np.inf, -np.inf
    return low, high


def _search_task(same: bool, k: int):
    """Cogroup function: the k best rows of a block for every query and window of a group."""
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if rows.num_rows and queries.num_rows:
            rows = rows.sort_by("id")
            x, label = whole(matrix(rows.column("vec"))), rows.column("label").to_numpy()
            if x.dtype == object:
                keep = np.arange(len(x))
            else:
                keep = first_copies(np.column_stack([x + 0.0, label.astype(np.float64)]), k + 1)
            ids, label, x = rows.column("id").to_numpy()[keep], label[keep], x[keep]
            ra = matrix(rows.column("angles"))[keep]
            rn = rows.column("norm").to_numpy()[keep]
            qx, qa = whole(matrix(queries.column("vec"))), matrix(queries.column("angles"))
            qn, qid = queries.column("norm").to_numpy(), queries.column("id").to_numpy()
            qlabel, want = queries.column("label").to_numpy(), queries.column("want").to_pylist()
            for start in range(0, len(qid), 64):
                at = slice(start, start + 64)
                low, high = score_bounds(qa[at], qn[at], ra, rn)
                fits = (qlabel[at, None] == label[None, :]) == same
                fits &= qid[at, None] != ids[None, :]
                near = np.zeros_like(fits)
                for i, windows in enumerate(want[at]):
                    for w in windows:
                        near[i] |= (high[i] >= w["lo"]) & (low[i] <= w["hi"])
                qi, ri = np.nonzero(fits & near)
                got = [scores(qx[at][qi[s:s + PAIRS]], x[ri[s:s + PAIRS]]) for s in range(0, len(qi), PAIRS)]
                got = np.concatenate(got) if got else np.zeros(0, np.int64)
                ends = np.searchsorted(qi, np.arange(len(want[at]) + 1))
                for i, windows in enumerate(want[at]):
                    mine, who = got[ends[i]:ends[i + 1]], ri[ends[i]:ends[i + 1]]
                    for w in windows:
                        inside = np.flatnonzero((mine >= w["lo"]) & (mine <= w["hi"]))
                        if mine.dtype == object:            # a limit stands for everything beyond
                            inside = np.flatnonzero([(w["lo"] == LOW or v >= w["lo"]) and (w["hi"] == HIGH or v <= w["hi"])
                                                     for v in mine])
                        top = inside[np.argsort(-mine[inside], kind="stable")[:k]]
                        out[0].extend([qid[start + i]] * len(top))
                        out[1].extend([w["no"]] * len(top))
                        out[2].extend(ids[who[top]])
                        out[3].extend(min(max(int(v), LOW), HIGH) for v in mine[top])
        return pa.table({"id": pa.array(out[0], pa.int64()), "no": pa.array(out[1], pa.int32()),
                         "other": pa.array(out[2], pa.int64()), "score": pa.array(out[3], pa.int64())})
    return run


def _block_ranges(rows: DataFrame) -> DataFrame:
    """Per block the least and greatest norm and angle to every reference."""
    spans = [f(F.col("angles")[i]).alias(f"{n}{i}") for i in range(REFERENCES) for n, f in (("lo", F.min), ("hi", F.max))]
    return rows.groupBy("dim", "ref", "part").agg(F.min("norm").alias("least"), F.max("norm").alias("most"), *spans)


def _reachable(anchors: DataFrame, ranges: DataFrame, groups: int) -> DataFrame:
    """Anchors joined to the blocks whose ranges can meet one of their windows: + block_ref, block_part.

    Both sides are dealt into (anchor group, page of blocks), so no key holds more
    than a group and a page.
    """
    pages = groups_for(ranges.count(), PAGE_BLOCKS)
    page = F.pmod(F.xxhash64("ref", "part", F.lit(17)), F.lit(pages)).cast("int")
    blocks = (ranges.withColumn("page", page).withColumn("group", all_groups(groups))
              .withColumnsRenamed({"ref": "block_ref", "part": "block_part", "dim": "block_dim"}))
    spread = anchors.drop("ref", "part").withColumn("page", all_groups(pages))
    angle = [F.col("angles")[i].cast("double") for i in range(REFERENCES)]
    apart = F.greatest(F.lit(0.0), F.greatest(*[F.greatest(F.col(f"lo{i}") - a, a - F.col(f"hi{i}")) for i, a in enumerate(angle)]) - SLACK)
    joined = F.least(*[F.greatest(F.least(F.col(f"hi{i}") + a, 2 * np.pi - F.col(f"lo{i}") - a), F.lit(0.0)) for i, a in enumerate(angle)])
    up, down = F.cos(apart) + SLACK, F.cos(F.least(joined + SLACK, F.lit(np.pi))) - SLACK
    high = F.col("norm") * F.when(up >= 0, F.col("most")).otherwise(F.col("least")) * up + 1
    low = F.col("norm") * F.when(down >= 0, F.col("least")).otherwise(F.col("most")) * down - 1
    free = (F.col("norm") == float("inf")) | (F.col("most") == float("inf"))
    meets = F.exists("want", lambda w: (w["lo"] <= high) & (w["hi"] >= low))
    return (spread.join(blocks, ["group", "page"])
            .where((F.col("dim") == F.col("block_dim")) & (free | meets))
            .select(*anchors.drop("ref", "part").columns, F.col("block_ref").alias("ref"), F.col("block_part").alias("part")))


def search(rows: DataFrame, anchors: DataFrame, same: bool, k: int, groups: int, ranges: DataFrame | None) -> DataFrame:
    """(id, no, other, score, rank): the k best rows of equal (or other) label per anchor and window.

    ``anchors`` carry ``want``: array<struct<no, lo, hi>>.  Without ``ranges`` an anchor
    meets only its own block.
    """
    placed = anchors if ranges is None else _reachable(anchors, ranges, groups)
    key = ["group", "dim", "ref", "part"]
    left = rows.withColumn("group", all_groups(groups)).groupBy(*key)
    right = placed.select(*[F.col(c).alias(c) for c in placed.columns]).groupBy(*key)     # columns of their own
    found = left.cogroup(right).applyInArrow(
        _search_task(same, k), "id long, no int, other long, score long")
    return best(found, ["id", "no"], k)


def _window(no, lo, hi):
    return F.struct(no.cast("int").alias("no"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


def hard_negatives(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                   anchor_every: int = 100, positives: int = 5, negatives: int = 10,
                   low_tenths: int = 3, high_tenths: int = 9) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For anchors (ids divisible by ``anchor_every``) and each of their ``positives`` best
    rows of the same label, the ``negatives`` best rows of other labels whose score is
    between ``low_tenths`` and ``high_tenths`` tenths of the positive's.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = usable_rows(df, id_col, vec_col, label_col).where(F.col(label_col).isNotNull())
    rows = single_rows(rows.select("id", F.col(label_col).cast("long").alias("label"), "vec", "dim"))
    refs = reference_directions(sample_by_hash(rows, SAMPLE, "vec", "dim"))
    rows = parts_of(with_angles(rows, refs), ["dim", "ref"], BLOCK_ROWS).checkpoint()
    ranges = _block_ranges(rows).checkpoint()
    anchors = rows.where(F.pmod("id", F.lit(anchor_every)) == 0)
    groups = groups_for(anchors.count(), GROUP_ANCHORS)
    anchors = anchors.withColumn("group", group_of(groups))

    def floors(found: DataFrame, k: int) -> DataFrame:
        return found.where(F.col("rank") == k).select("id", "no", F.col("score").alias("floor"))

    everything = F.array(_window(F.lit(0), F.lit(LOW), F.lit(HIGH)))
    home = search(rows, anchors.withColumn("want", everything), True, positives, groups, None)
    floor = floors(home, positives).select("id", "floor")
    wanted = (anchors.join(floor, "id", "left")
              .withColumn("want", F.array(_window(F.lit(0), F.coalesce("floor", F.lit(LOW)), F.lit(HIGH)))).drop("floor"))
    pos = search(rows, wanted, True, positives, groups, ranges)
    tenths = F.col("score").cast("decimal(20,0)")
    pos = (pos.where("score >= 0").select("id", F.col("rank").alias("no"), F.col("other").alias("positive_id"),
                                          F.col("score").alias("positive_score"),
                                          F.ceil(tenths * low_tenths / 10).cast("long").alias("lo"),
                                          F.floor(tenths * high_tenths / 10).cast("long").alias("hi")).checkpoint())

    def windows(bounds: DataFrame) -> DataFrame:
        per = bounds.groupBy("id").agg(F.collect_list(_window(F.col("no"), F.col("lo"), F.col("hi"))).alias("want"))
        return anchors.join(per, "id")              # at most ``positives`` windows an anchor

    home = search(rows, windows(pos), False, negatives, groups, None)
    lifted = (pos.join(floors(home, negatives), ["id", "no"], "left")
              .withColumn("lo", F.greatest("lo", F.coalesce("floor", "lo"))))
    neg = search(rows, windows(lifted), False, negatives, groups, ranges)
    return (neg.join(pos, ["id", "no"])
            .select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    shifted = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", shifted.alias("label")))
