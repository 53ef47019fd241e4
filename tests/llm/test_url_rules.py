"""URL rules: curated rules against a plain version, mined rules, inverted index, edge cases."""

import itertools
import random
import re
import time

import pytest

from tests.llm.helpers import SF
from tillroll.llm import url_rules as U

URLS = [None, "", "no scheme", "http://", "https://Example.COM/en/1", "http://www.example.com/en/x?y#z", "http://a.b.www.example.com/en/",
        "http://badexample.com/en/", "http://example.com/EN/1", "http://x.net/es/1", "http://x.net/fr", "http://net/es/", "http://x.org/en/",
        "ftp://u@h.net:80/fr/", "x://y://z.net/es/", "http://example.com?en/", "http://é.com/en/", "http://x.com", "http://x.com/"]


def plain(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.split(r"[/?#]", rest)[0])
    path = re.split(r"[?#]", rest[len(host):])[0]
    fits = [(len(h + p), h + p, v) for v, h, p in U.CURATED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


def test_curated_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    none = spark.createDataFrame([], "items array<string>, verdict string, confidence double, support double, rule_id long")
    got = {r.page_id: r for r in U.judge_urls(pages, none).collect()}
    for i, url in enumerate(URLS):
        host, path, rule, verdict = plain(url)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), url


def test_pages(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = U.op2_url_rules(spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(urls)
    for r in rows:
        host, path, rule, verdict = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert rule is None or r.verdict == verdict


@pytest.fixture(scope="module")
def mined(spark):
    """Blocked: casino hosts under /play/ only; casino news and other play pages are fine."""
    rows = [(f"http://{h}{i}.org/{p}/{i}", h == "casino-" and p == "play")
            for h in ("casino-", "garden-", "river-") for p in ("play", "news", "shop") for i in range(40)]
    frame = spark.createDataFrame(rows, "url string, blocked boolean")
    return U.mine_rules(frame.withColumn("host", U.host_of(frame.url)).withColumn("path", U.path_of(frame.url)))


def test_mined_rules_are_the_planted_combination(mined):
    block = [set(r["items"]) for r in mined.collect() if r.verdict == "block"]
    assert block and all({"word:casino"} < s or len(s) >= 2 for s in block)
    assert any({"word:casino", "word:play"} == s or {"word:casino", "path:play"} == s for s in block)


def test_index_equals_plain_subset_test(spark, mined):
    urls = [f"http://{h}{i}.org/{p}/{q}" for h in ("casino-", "garden-", "lake-") for i in (1, 99) for p in ("play", "news", "x/play")
            for q in ("", "?play=1")] + [None, "casino"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    frame = frame.withColumn("host", U.host_of(frame.url)).withColumn("path", U.path_of(frame.url))
    rules = mined.collect()
    toks = {r.url: set(r.t) for r in frame.select("url", U.tokens("host", "path", "url").alias("t")).collect()}
    want = {}
    for u, t in toks.items():
        fit = [(r.confidence, r.support, r.verdict) for r in rules if set(r["items"]) <= t]
        if fit and u is not None:
            want[u] = max(fit)[2]
    assert {r.url: r.mined for r in U.match_rules(frame.where("url is not null").distinct(), mined).collect()} == want and want


def test_edges(spark):
    pages = spark.createDataFrame([], "page_id long, url string, host string")
    empty = U.mine_rules(U.labelled_urls(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert empty.count() == 0 and U.judge_urls(pages, empty).count() == 0
    twice = spark.createDataFrame([(1, "http://x.net/es/", "h"), (1, "http://x.net/es/", "h"), (None, None, "h")],
                                  "page_id long, url string, host string")
    got = sorted((r.page_id or 0, r.verdict) for r in U.judge_urls(twice, empty).collect())
    assert got == [(0, "allow"), (1, "block"), (1, "block")]


def judged(spark, rows, urls):
    """Rules mined from (url, blocked) rows and the verdicts of ``urls``."""
    frame = spark.createDataFrame(rows, "url string, blocked boolean")
    rules = U.mine_rules(frame.withColumn("host", U.host_of(frame.url)).withColumn("path", U.path_of(frame.url)))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return rules.collect(), [r.verdict for r in U.judge_urls(pages, rules).orderBy("page_id").collect()]


def test_many_redundant_rules_push_out_no_other(spark, monkeypatch):
    """Eight sites of 12 tokens give 2,384 sure block rules; a weaker site and its exception stay."""
    sites = [".".join(c * 2 + d * 2 for d in "uvwxyz") for c in "abcdefgh"]
    rows = [(f"http://{s}/{i}", True) for s in sites for i in range(30)]
    rows += [(f"http://weak.org/{i}", True) for i in range(96)] + [(f"http://weak.org/good/{i}", False) for i in range(24)]
    rows += [(f"http://fine.org/{i}", False) for i in range(300)]
    urls = ["http://weak.org/x", "http://weak.org/good/x", "http://fine.org/x", *(f"http://{s}/" for s in sites)]
    want = ["block", "allow", "allow"] + ["block"] * 8
    rules, verdicts = judged(spark, rows, urls)
    assert verdicts == want
    sets = [(set(r["items"]), r) for r in rules]
    assert not any(s < t and q.verdict == r.verdict and q.confidence >= r.confidence for s, q in sets for t, r in sets)
    monkeypatch.setattr(U, "BROADCAST_RULES", 0)
    assert judged(spark, rows, urls)[1] == want


def test_combination_with_a_frequent_token(spark):
    """/en/ is on most urls; one site is bad only there."""
    rows = [(f"http://site.org/en/{i}", True) for i in range(40)] + [(f"http://site.org/fr/{i}", False) for i in range(40)]
    rows += [(f"http://fine.org/en/{i}", False) for i in range(100)]
    rules, verdicts = judged(spark, rows, ["http://site.org/en/x", "http://site.org/fr/x", "http://fine.org/en/x"])
    assert verdicts == ["block", "allow", "allow"] and any("path:en" in r["items"] and r.verdict == "block" for r in rules)


def plain_rules(rows, min_urls, confidence):
    """All token sets with a verdict that is surer than in each of their parts, for sets that every token narrows."""
    toks = [(frozenset(t), b) for t, b in rows]
    on = {}
    for i, (t, _) in enumerate(toks):
        for x in t:
            on.setdefault(x, set()).add(i)
    items = {}
    for x, where in on.items():
        if min_urls <= len(where) < len(toks):
            items.setdefault(frozenset(where), set()).add(x)
    names = {where: min(xs) for where, xs in items.items()}
    sure = {}
    for size in range(1, len(items) + 1):
        for some in itertools.combinations(items, size):
            where = frozenset.intersection(*some)
            for v in ("block", "allow"):
                yes = sum(toks[i][1] == (v == "block") for i in where)
                if len(where) >= min_urls:
                    sure[frozenset(names[w] for w in some), v] = (yes / len(where) if yes >= min_urls else 0, yes / len(toks))
    return {(s, v): (c, p) for (s, v), (c, p) in sure.items() if c >= confidence
            and not any(sure[frozenset(q), v][0] >= c for k in range(1, len(s)) for q in itertools.combinations(s, k))}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rules_equal_a_plain_miner(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(U, "MIN_URLS", 4)
    urls = []
    for _ in range(150):
        parts = [p for p in ("play", "news", "deep", "deeper") if rng.random() < .5]
        host = rng.choice(["casino", "garden", "river"])
        urls.append((f"http://{host}.org/" + "/".join(parts), rng.random() < (.9 if host == "casino" and "play" in parts else .2)))
    frame = spark.createDataFrame(urls, "url string, blocked boolean")
    frame = frame.withColumn("host", U.host_of(frame.url)).withColumn("path", U.path_of(frame.url))
    rows = [(r.t, r.blocked) for r in frame.select("blocked", U.tokens("host", "path", "url").alias("t")).collect()]
    got = {(frozenset(r["items"]), r.verdict): (r.confidence, r.support) for r in U.mine_rules(frame, 0.001, .6).collect()}
    want = plain_rules(rows, 4, .6)
    assert got.keys() == want.keys() and len(got) > 5
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_a_deep_folder_is_one_item(spark):
    """Thirty urls of one folder twelve segments deep: mined at once, and any of its tokens tells the site."""
    deep = "/".join("seg" + c for c in "abcdefghijkl")
    rows = [(f"http://bad.org/{deep}/{i}", True) for i in range(30)] + [(f"http://fine{i}.org/x/{i}", False) for i in range(300)]
    began = time.time()
    rules, verdicts = judged(spark, rows, [f"http://bad.org/{deep}/9", "http://new.org/sega/1", "http://fine.org/x/1"])
    assert time.time() - began < 60
    block = [r for r in rules if r.verdict == "block"]
    assert len(block) == 1 and len(block[0].members[0]) >= 26 and verdicts == ["block", "block", "allow"]


def test_null_and_repeated_urls_skip_no_row(spark):
    pages = spark.createDataFrame([(i, None if i % 3 else "http://a.org/x") for i in range(300)], "page_id long, url string")
    none = spark.createDataFrame([], U.RULE_COLUMNS)
    assert [r.page_id for r in U.judge_urls(pages, none).orderBy("page_id").collect()] == list(range(300))
