"""Quality rules: base counts against a plain version, Viterbi against enumeration, edge cases."""

from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import SF, WORD, docs_of, frame, prose, rows_of
from tillroll.llm import crf, line_quality as Q


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    wins = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, w in enumerate(wins):
        if wins.count(w) > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": dup, "n_repeat_words": len(hit)}


EDGE = [None, "", " \n\t ", "one", "a b c d e f g h a b c d e f g h", "x\nx\n x\nx", "\u00a0 é\u2003ü #*$", "w " * 300,
        "a\x0bb\x0cc\rd", prose(1, 50) + "\n" + prose(1, 50) + "\n\n", "\n" * 50, "x " * 7 + "y"]


def test_base_counts_equal_plain_version():
    got = Q.judge(pa.array(EDGE, pa.string()), Q.PRIOR, 0.5)
    for i, text in enumerate(EDGE):
        for name, value in plain(text).items():
            assert got[name][i].as_py() == value, (i, name)


def test_counts_on_documents(spark):
    docs = docs_of(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for doc_id, row in rows_of(Q.op1_line_quality(spark, SF)).items():
        want = plain(texts[doc_id])
        assert {k: row[k] for k in want} == want
        failed = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert row.base_failed == failed and (not failed or not row.kept)


def test_verdict_follows_content_share(spark):
    for row in rows_of(Q.op1_line_quality(spark, SF)).values():
        assert row.kept == (not row.base_failed and row.content_share >= 0.5)


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_is_the_best_of_all_sequences(seed):
    rng = np.random.default_rng(seed)
    unary, stay = rng.normal(size=9).tolist(), float(rng.normal())
    score = lambda y: sum(u for u, s in zip(unary, y) if s) + stay * sum(a == b for a, b in zip(y, y[1:]))
    best = max(product((0, 1), repeat=9), key=score)
    assert score(crf.viterbi(unary, stay)) == pytest.approx(score(best))
    assert crf.viterbi([], 1.0) == []


def test_gradient_and_training():
    rng = np.random.default_rng(0)
    x, y, mask = rng.normal(size=(3, 4, 2)), rng.integers(0, 2, (3, 4)).astype(float), np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]])
    x, y = x * mask[:, :, None], y * mask
    w, p0 = np.array([0.3, -0.4]), np.zeros(2)
    value = lambda w, s: crf._likelihood(w, s, x, y, mask, p0, 0.0, 1.0)
    _, gw, gs = value(w, 0.2)
    for i in range(2):
        d = np.eye(2)[i] * 1e-5
        assert gw[i] == pytest.approx((value(w + d, 0.2)[0] - value(w - d, 0.2)[0]) / 2e-5, abs=1e-6)
    assert gs == pytest.approx((value(w, 0.2 + 1e-5)[0] - value(w, 0.2 - 1e-5)[0]) / 2e-5, abs=1e-6)
    assert crf.fit([], Q.PRIOR) == Q.PRIOR


def test_held_out_labels(spark):
    """Trained on some labelled texts, the verdict agrees with the labels of the others."""
    docs, labels = docs_of(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = Q.train(docs, labels.where("doc_id % 2 = 0"))
    rows = Q.line_quality(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) / len(rows) > 0.95
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) / len(good) > 0.98


def test_edges(spark):
    none = Q.line_quality(frame(spark, []))
    assert none.count() == 0 and "kept" in none.columns
    clash = Q.line_quality(frame(spark, [prose(2, 40), None, prose(2, 40)], kept="x", n_words="y"))
    got = rows_of(clash)
    assert got[0].n_words == 40 and got[0].kept is True and got[1].kept is False and got[0][2:] == got[2][2:]
    assert Q.train(frame(spark, ["a b"]), spark.createDataFrame([], "doc_id long, quality int")) == Q.PRIOR
    long = "\n".join(prose(i, 30) for i in range(3000))
    assert rows_of(Q.line_quality(frame(spark, [long])))[0].n_words == 90000
