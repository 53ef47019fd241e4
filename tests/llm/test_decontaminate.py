"""Decontamination against a plain search over every window of an item's length."""

import random
import re
from collections import Counter

import pytest

from tests.llm.helpers import SF, docs_of, frame, prose, rows_of
from tillroll.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def bag(ws):
    return Counter(" ".join(ws[i:i + 5]) for i in range(len(ws) - 4))


def similarity(a, b):
    weight = lambda c: sum(len(s.replace(" ", "")) * n for s, n in c.items())
    total = weight(a) + weight(b)
    return 2 * weight(a & b) / total if total else 0.0


def plain_best(text, items):
    """Best similarity of any window of item length, over all items."""
    ws, best = words(text), (0.0, None)
    for item_id, item in sorted(items.items()):
        iw = words(item)
        if len(iw) < 5:
            continue
        target = bag(iw)
        mine = bag(ws)
        if not mine & target:
            continue
        for start in range(max(1, len(ws) - len(iw) + 1)):
            s = similarity(bag(ws[start:start + len(iw)]), target)
            if s > best[0]:
                best = (s, item_id)
    return best


ITEM = prose(7, 40) + " Zebra crossing, number nine."
ITEMS = {1: ITEM, 2: prose(8, 60), 3: "too short", 4: None, 5: ITEM}


def edited(text, *at):
    ws = text.split()
    for k in at:
        ws[k] = "xyzzy"
    return " ".join(ws)


CASES = [None, "", "   ", ITEM, ITEM.upper(), "before " * 30 + ITEM + " after" * 30, edited(ITEM, 20), edited(ITEM, 5, 20, 35),
         " ".join(ITEM.split()[:20]), ITEM.replace(" ", "\n"), prose(8, 60) + " " + ITEM, prose(9, 400), "a b c d e",
         edited(ITEM, 0, 1, 2), "x " + ITEM.replace("Zebra", "Zebra the"), " ".join(ITEM.split()[:-1])]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(list(ITEMS.items()), "item_id long, text string")


def test_cases(spark, benchmark):
    got = rows_of(D.decontaminate(frame(spark, CASES), benchmark))
    for i, text in enumerate(CASES):
        best, item = plain_best(text, ITEMS)
        assert got[i].contaminated == (best >= 0.8), (i, best, got[i])
        if best >= 0.8:
            assert got[i].best_item == item and got[i].best_similarity == pytest.approx(best, abs=1e-12)
    assert [got[i].contaminated for i in (3, 4, 5, 6, 8)] == [True, True, True, True, False]


def test_documents(spark):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs_of(spark).collect()}
    rows = rows_of(D.op8_decontaminate(spark, SF))
    assert set(rows) == set(texts)
    for i, row in rows.items():
        assert row.contaminated == (plain_best(texts[i], items)[0] >= 0.8)


def test_shuffled_route_equals_broadcast(spark, benchmark, monkeypatch):
    docs = frame(spark, CASES)
    want = sorted(map(str, D.leaks(docs, benchmark).collect()))
    monkeypatch.setattr(D, "BROADCAST_SHINGLES", 0)
    monkeypatch.setattr(D, "BROADCAST_TEXTS", 0)
    assert sorted(map(str, D.leaks(docs, benchmark).collect())) == want and want


def test_blocks_cover_the_radius(spark):
    """Any two values within RADIUS bits share one of the blocks; blocks cover all 64 bits."""
    row = spark.createDataFrame([(-1,)], "fp long").select(D.blocks("fp").alias("b")).first()
    assert len(row.b) == D.RADIUS + 1 and sum(x.value.bit_count() for x in row.b) == 64


def test_main_path_is_native(spark, benchmark):
    plan = D.decontaminate(frame(spark, CASES), benchmark)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edges(spark, benchmark):
    assert D.decontaminate(frame(spark, []), benchmark).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in D.decontaminate(frame(spark, [ITEM]), none).collect()] == [False]
    rows = spark.createDataFrame([(None, ITEM, 1), (None, "clean text", 2), (4, ITEM, 3), (4, ITEM, 3), (4, "clean", 4)],
                                 "doc_id long, text string, words int")
    got = sorted((r.doc_id or 0, r.contaminated) for r in D.decontaminate(rows, benchmark).collect())
    assert got == [(0, False), (0, True), (4, False), (4, True), (4, True)]


def test_items_with_another_tail(spark):
    """Leaked items whose end is replaced by short words, repeated or not, are found if the windows say so."""
    items = {k: prose(100 + k, 60) for k in range(8)}
    tails = ("x", "0 1", "one two three four five six seven")
    texts = [" ".join(t.split()[:60 - n] + (tail.split() * n)[:n]) for t in items.values() for tail in tails for n in (6, 12, 16)]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = rows_of(D.decontaminate(frame(spark, texts), bench))
    want = [plain_best(t, items)[0] >= 0.8 for t in texts]
    assert [got[i].contaminated for i in range(len(texts))] == want and 30 < sum(want) < len(want)


def test_equal_ids_of_items(spark):
    """One id on two texts: each text is an item, and neither's shingles count for the other."""
    bench = spark.createDataFrame([(1, prose(1, 40)), (1, prose(2, 40)), (2, prose(1, 40))], "item_id long, text string")
    got = rows_of(D.decontaminate(frame(spark, [prose(1, 40), prose(2, 40), prose(1, 20) + " " + prose(2, 20)]), bench))
    assert [(got[i].contaminated, got[i].n_items) for i in range(3)] == [(True, 2), (True, 1), (False, 0)]


def test_shifted_items_are_found(spark):
    """Items with words put in or taken out, so that no single start lines up with both ends: none is lost."""
    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    items = {k: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 60))) for k in range(60)}
    texts = []
    for k, item in items.items():
        for _ in range(12):
            ws = item.split()
            for _ in range(rng.randint(1, 2)):
                at, n = rng.randrange(len(ws)), rng.randint(1, 3)
                if rng.random() < .5:
                    ws[at:at] = [rng.choice(vocabulary) for _ in range(n)]
                else:
                    del ws[at:at + n]
            texts.append(" ".join([*(rng.choice(vocabulary) for _ in range(20)), *ws, *(rng.choice(vocabulary) for _ in range(20))]))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = rows_of(D.decontaminate(frame(spark, texts), bench))
    best = [plain_best(t, items)[0] for t in texts]
    assert [got[i].contaminated for i in range(len(texts))] == [b >= 0.8 for b in best]
    assert [got[i].best_similarity for i, b in enumerate(best) if b >= 0.8] == pytest.approx([b for b in best if b >= 0.8], abs=1e-12)
    assert sum(0.8 <= b < 0.9 for b in best) > 100


def test_fingerprints_are_weighted_majorities(spark):
    rng = random.Random(3)
    rows = [(g, rng.getrandbits(64) - (1 << 63), rng.randint(1, 30)) for g in range(5) for _ in range(30)]
    got = {r.g: r.fp for r in D.with_fingerprints(spark.createDataFrame(rows, "g int, h long, w long"), "g").collect()}
    for g, fp in got.items():
        mine = [(h % (1 << 64), w) for x, h, w in rows if x == g]
        total = sum(w for _, w in mine)
        assert fp % (1 << 64) == sum(1 << k for k in range(64) if 2 * sum(w for h, w in mine if h >> k & 1) > total)
