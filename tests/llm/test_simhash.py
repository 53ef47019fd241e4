"""SimHash fingerprints, bit-sliced comparison and components against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tests.llm.helpers import SF, WORD, docs_of, frame, prose, rows_of
from tillroll.llm import simhash as H
from tillroll.llm.graph import connected_components


def plain_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_roots(values, radius):
    """Smallest value reachable over pairs within the radius."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


EDGE = [None, "", " \n", "One", "A b C", "a b c d", "É é A a B b", prose(1, 200), prose(1, 200).upper(), "w " * 50, "a\u00a0b c"]


def test_fingerprints():
    assert H.fingerprints(pa.array(EDGE, pa.string())).tolist() == [plain_fp(t) for t in EDGE]


def test_fingerprints_over_several_chunks(monkeypatch):
    monkeypatch.setattr(H, "_SHINGLES_AT_ONCE", 7)
    assert H.fingerprints(pa.array(EDGE, pa.string())).tolist() == [plain_fp(t) for t in EDGE]


def clustered(seed, n, centres):
    rng = random.Random(seed)
    mids = [rng.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < n:
        v = rng.choice(mids)
        for _ in range(rng.randrange(7)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    return sorted(out)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_near_counts_bits(radius):
    rng = np.random.default_rng(radius)
    values = rng.integers(0, 2 ** 63, 200, dtype=np.uint64) & rng.integers(0, 2 ** 63, 200, dtype=np.uint64) & rng.integers(
        0, 2 ** 63, 200, dtype=np.uint64) & rng.integers(0, 2 ** 63, 200, dtype=np.uint64)
    rows = H.planes(values)
    hit = H._set_bits(H.near(rows, np.zeros(rows.shape[1], np.uint64), radius))
    assert [i for i in hit if i < 200] == [i for i, v in enumerate(values.tolist()) if v.bit_count() <= radius]


@pytest.mark.parametrize("n", [2, 20, 31, 200])
def test_run_links_span_the_groups(n):
    values = clustered(n, n, 4)
    arr = np.array(values, np.uint64)
    for links in (H.short_run_links(arr, np.zeros(n, np.int64), 4) if n <= 32 else None, H.long_run_links(arr, 4)):
        if links is not None:
            root = {v: v for v in values}

            def find(v):
                while root[v] != v:
                    v = root[v]
                return v
            for a, b in zip(arr[links[0]].tolist(), arr[links[1]].tolist()):
                assert (a ^ b).bit_count() <= 4
                x, y = sorted((find(a), find(b)))
                root[y] = x
            assert {v: find(v) for v in values} == plain_roots(values, 4)
    assert len(H.long_run_links(arr, 4)[0]) < n                          # spans, never all pairs


@pytest.mark.parametrize("hot", [4096, 16])
def test_components_equal_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(H, "HOT_BUCKET", hot)
    values = clustered(5, 300, 6)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = H.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    found = {r.node: r.root for r in connected_components(links).collect()}
    want = plain_roots(values, 4)
    back = {s: v for s, v in zip(signed, values)}
    groups = lambda pairs: sorted(sorted(g) for g in {k: [v for v, r in pairs if r == k] for _, k in pairs}.values())
    assert groups([(v, back[found.get(s, s)]) for s, v in zip(signed, values)]) == groups(list(want.items()))


def test_documents(spark):
    texts = {r.doc_id: r.text for r in docs_of(spark).collect()}
    fps = {i: plain_fp(t) for i, t in texts.items()}
    roots = plain_roots(sorted(set(fps.values())), 4)
    least = {}
    for i, f in fps.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    rows = rows_of(H.op7_simhash_dedup(spark, SF))
    assert set(rows) == set(texts)
    for i, row in rows.items():
        assert row.fingerprint == f"{fps[i]:016x}" and row.component_id == least[roots[fps[i]]]


def test_chain_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(3, 3), (50, 60), (60, 50), (50, None)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 60: 50}


def test_edges(spark):
    assert H.simhash_components(frame(spark, [])).count() == 0
    rows = spark.createDataFrame([(5, "", 1), (3, None, 1), (None, "x y z w v", 2), (9, "x y z w v", 2), (9, "x y z w v", 2),
                                  (None, "alone here now", 3)], "doc_id long, text string, fp int")
    got = [(r.doc_id or 0, r.component_id or 0) for r in H.simhash_components(rows).collect()]
    assert sorted(got) == [(0, 0), (0, 9), (3, 3), (5, 3), (9, 9), (9, 9)]
    kept = H.stage(spark, rows, SF).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 3, 9]
    with pytest.raises(ValueError):
        H.fingerprint_links(spark.createDataFrame([], "fp long"), 5)


def test_stage_keeps_one_text_of_every_component(spark):
    """Null ids join no components and an id on two texts stands for both."""
    far = [prose(seed, 60) for seed in range(5)]
    assert len(set(plain_roots({plain_fp(t) for t in far}, 4).values())) == 5
    rows = [(None, far[0]), (None, far[0]), (None, far[1]), (None, far[2]), (7, far[2]), (8, far[3]), (8, far[4]), (9, far[4])]
    kept = H.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    want = [(None, far[0]), (None, far[1]), (7, far[2]), (8, far[3]), (8, far[4])]
    assert sorted(((r.doc_id or 0, r.text) for r in kept)) == sorted((i or 0, t) for i, t in want)
