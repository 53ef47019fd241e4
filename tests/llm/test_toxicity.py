"""Toxicity: folding, matching against a plain scan, held-out accuracy, edge cases."""

import re

import pytest

from tests.llm.helpers import SF, frame, prose, rows_of
from tillroll.llm import toxicity as X

LEX = X.Lexicon((("=idiot", 5.0), ("^moron", 4.0), ("^low", 2.0), ("=lowest", 3.0)), ("lowest price", "lowland"), 0.05)


def test_folding():
    assert X.fold("1D10T m0r0n іdіоt ｉｄｉｏｔ $tupid") == "idiot moron idiot idiot stupid"
    assert X.fold("2024 costs 10$ a1") == "2024 costs 10$ a1"


def plain_hits(folded):
    out = []
    for m in re.finditer(r"[^\W\d_]+", folded):
        weights = [w for e, w in LEX.entries if (m[0] == e[1:] if e[0] == "=" else m[0].startswith(e[1:]))]
        safe = any(p.start() <= m.start() < p.end() for phrase in LEX.exceptions
                   for p in re.finditer(rf"(?<![^\W\d_]){phrase}(?![^\W\d_])", folded))
        if weights and not safe:
            out.append((m.start(), max(weights)))
    return out


@pytest.mark.parametrize("text", ["", "an idiot, idiots and morons", "lowest of the low", "lowest price for lowlands in the lowland",
                                  "slow yellow", "IDIOT.idiot-moronic", "the lowest prices"])
def test_matching_equals_plain_scan(text):
    assert X.matcher(LEX).hits(X.fold(text)) == plain_hits(X.fold(text))


def test_length_normalisation():
    m = X.matcher(LEX)
    assert m.score("idiot " + "fine " * 40) > m.score("idiot " + "fine " * 400) > 0 == m.score("fine " * 40)
    assert 0 < m.score("idiot") < 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = X.op9_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    precision, recall = hit / sum(r.predicted for r in rows), hit / sum(r.toxic for r in rows)
    assert precision > 0.9 and recall > 0.9
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_held_out_rows_teach_nothing(spark):
    import zlib
    docs = frame(spark, [("idiot " if i % 2 else "") + prose(i, 30) for i in range(80)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    out = {i for i in range(80) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {r.doc_id for r in docs.where(X.held_out()).collect()} == out
    lex = X.learn(docs, labels)
    assert ("=idiot" in dict(lex.entries)) and X.learn(docs, labels.where(X.held_out())) == X.Lexicon()
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - toxic, toxic) as toxic")
    assert X.learn(docs, flipped) == lex


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lex = X.learn(frame(spark, [None, ""]), none)
    assert lex == X.Lexicon()
    got = rows_of(X.toxicity(frame(spark, [None, "", "idiot", "idiot"], score=1), LEX))
    assert got[0].score == got[1].score == 0 and got[2].score == got[3].score > 0
    assert X.toxicity(frame(spark, []), LEX).count() == 0
    assert rows_of(X.toxicity(frame(spark, ["fine " * 500_000 + "idiot"]), LEX))[0].score > 0
