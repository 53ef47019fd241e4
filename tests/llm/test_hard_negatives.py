import math
import random

import numpy as np
import pytest

from tests.llm.helpers import SF
from tillroll.llm import hard_negatives as H

DDL = "vec_id long, embedding array<double>, label int, id string, `vec.x` int, score long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1, 2) for i, v, y in rows], DDL)


def plain(rows, every=100, positives=5, negatives=10):
    """All pairs, from the definition."""
    kept = {}
    for i, v, y in rows:
        if i is None or y is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i not in kept or (y, v) < kept[i]:
            kept[i] = (y, v)
    whole = {i: (y, [math.floor(256 * x) for x in v]) for i, (y, v) in kept.items()}
    out = set()
    for a, (ya, va) in whole.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(va, v)), i, y) for i, (y, v) in whole.items() if i != a and len(v) == len(va))
        for s, p in [(-s, i) for s, i, y in scored if y == ya][:positives]:
            window = [(-t, i) for t, i, y in scored if y != ya and 30 * s <= -100 * t <= 90 * s][:negatives]
            out |= {(a, p, r + 1, n, s, t) for r, (t, n) in enumerate(window)}
    return out


def found(df, every=100):
    got = [tuple(r) for r in H.hard_negatives(df, anchor_every=every).collect()]
    assert len(got) == len(set(got))
    return set(got)


def unit(rng, dim):
    v = [rng.gauss(0, 1) for _ in range(dim)]
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    centres = [unit(rng, 8) for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, .2) for c in centres[i % 6]] if seed == 1 else [x * rng.choice([1, 1, 5]) for x in unit(rng, 8)],
             rng.randrange(4)) for i in range(600)]
    want = plain(rows, 20)
    assert want and found(table(spark, rows), 20) == want


def test_small_blocks_and_pages_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, unit(rng, 6), rng.randrange(3)) for i in range(500)]
    for name, value in (("BLOCK_ROWS", 20), ("GROUP_ANCHORS", 7), ("PAGE_BLOCKS", 4), ("PAIRS", 50)):
        monkeypatch.setattr(H, name, value)
    assert found(table(spark, rows), 10) == plain(rows, 10)


def test_a_third_are_copies_with_ties(spark):
    rng = random.Random(4)
    copy = unit(rng, 5)
    rows = [(i, copy if i % 3 == 0 else [round(x, 1) for x in unit(rng, 5)], rng.randrange(3)) for i in range(300)]
    assert found(table(spark, rows), 10) == plain(rows, 10)


def test_rows_without_part(spark):
    rng = random.Random(5)
    rows = [(i, unit(rng, 4), i % 2) for i in range(60)]
    rows += [(100, None, 1), (101, [], 1), (102, [1.0, None, 0.0, 0.0], 1), (103, [math.nan, 0.0, 0.0, 0.0], 0),
             (104, [math.inf, 0.0, 0.0, 0.0], 0), (None, [1.0, 0.0, 0.0, 0.0], 0), (106, [1.0, 0.0, 0.0, 0.0], None),
             (107, [0.0] * 4, 1), (200, [0.0] * 4, 1), (108, [1.0, 2.0], 1), (300, [1.0, 2.0], 1), (109, [1.0, 1.9], 0),
             (5, unit(rng, 4), 0), (0, unit(rng, 4), 1)]
    assert found(table(spark, rows), 10) == plain(rows, 10)
    assert found(table(spark, rows[:1]), 1) == set()
    assert found(table(spark, []), 1) == set()


def test_scores_beyond_doubles_are_exact(spark):
    rng = random.Random(6)
    rows = [(i, [x * (1e6 if i % 3 else 7e6) for x in unit(rng, 3)], i % 2) for i in range(60)]
    assert found(table(spark, rows), 10) == plain(rows, 10)
    big = [[1e300, 1.0], [3.0, -2.0]]
    q = H.whole(np.array(big))
    assert H.scores(q[:1], q[1:])[0] == int(1e300) * 256 * 256 * 3 - 2 * 256 * 256
    assert found(table(spark, [(0, big[0], 0), (1, big[0], 0), (2, big[1], 1)]), 10) == set()


def test_bounds_hold():
    rng = np.random.default_rng(7)
    x = np.floor(256 * rng.normal(size=(200, 16)) * rng.choice([.01, 1, 30], size=(200, 1)))
    refs = rng.normal(size=(12, 16))
    refs /= np.linalg.norm(refs, axis=1)[:, None]
    norm = np.linalg.norm(x, axis=1)
    angles = np.arccos(np.clip((x @ refs.T) / np.maximum(norm, 1)[:, None], -1, 1)).astype(np.float32)
    low, high = H.score_bounds(angles, norm, angles, norm)
    s = x @ x.T
    assert (low <= s).all() and (s <= high).all()
    assert (high < norm[:, None] * norm[None, :] * .999).any()


def test_query_equals_all_pairs(spark):
    rows = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {tuple(r) for r in H.op11_hard_negatives(spark, SF).collect()}
    assert got == plain(rows)
