"""Licence scans: equality with SQL, Dice against a plain version, edge cases."""

import re
from collections import Counter

import duckdb

from tests.llm.helpers import SF, docs_of, frame, rows_of
from tests.oracle import canon
from tillroll.llm import licenses as L

MIT = L.TEMPLATES["MIT"][2]
CASES = [None, "", "MIT", "Intro\nReleased under the MIT License.\nmore", "released UNDER the  mit licence", "** Released under the MIT License! **",
         MIT, MIT.replace(" ", "\n", 30).replace("free of charge", "gratis"), "x\n\n" + MIT.replace(", ", ",\n") + "\n\ny",
         "Licensed under CC BY-NC 4.0.\nAll rights reserved.\nAll rights reserved.", "under the " * 50, "All rights reserved " * 3]


def plain_units(text):
    text = text or ""
    return text.split("\n") + [u for u in re.split(r"\n[ \t\r]*\n", text) if "\n" in u.strip(" ")]


def bag(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return Counter(zip(w, w[1:]))


def plain(text):
    found = []
    for unit in plain_units(text):
        mine, best = bag(unit), None
        for name, texts in L.TEMPLATES.items():
            for t in texts:
                other = bag(t)
                if mine:
                    d = 2 * sum((mine & other).values()) / (sum(mine.values()) + sum(other.values()))
                    if d >= 0.8:
                        best = min(best or (0, ""), (-d, name))
        if best:
            found.append(best)
    return len(found), ",".join(sorted({n for _, n in found}))


def test_cases(spark):
    got = rows_of(L.license_scan(frame(spark, CASES, license="mine")))
    for i, text in enumerate(CASES):
        assert (got[i].n_matches, got[i].licenses) == plain(text), (i, got[i])
    assert got[3].license == "MIT" and got[3].dice == 1.0 and got[8].license == "MIT" and got[0].license is None


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = L.op5_license_scan(spark, sf).toPandas()
    assert canon(got) == canon(con.execute(L.OP5_SQL).df()) and (got.n_matches > 0).sum() > 20


def test_documents(spark):
    texts = {r.doc_id: r.text for r in docs_of(spark).collect()}
    for i, row in rows_of(L.op5_license_scan(spark, SF)).items():
        assert (row.n_matches, row.licenses) == plain(texts[i])


def test_main_path_is_native(spark):
    plan = L.op5_license_scan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edges(spark):
    assert L.license_scan(frame(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "All rights reserved."), (None, None), (1, "All rights reserved."), (1, "All rights reserved.")],
                                 "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_matches) for r in L.license_scan(rows).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1)]
