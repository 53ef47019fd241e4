import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.helpers import SF, docs_of
from tillroll.llm import spelling as S


def plain_counts(docs):
    lower, out = str.maketrans(S.UPPER, S.LOWER), Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def plain_near(words):
    near, cut = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            cut[k, w[:k] + w[k + 1:]].add(w)
            if (x := w[:k] + w[k + 1:]) in words:
                near[w].add(x)
                near[x].add(w)
    for same in cut.values():
        for w in same:
            near[w] |= same - {w}
    return near


def plain(n):
    near, form = plain_near(n), {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def rows_of(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("alphabet,leaf", [("ab", 3), ("ab", 10_000), ("abcdé", 10), ("aÿ", 40)])
def test_forms_equal_all_pairs(spark, alphabet, leaf):
    rng = random.Random(len(alphabet) + leaf)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 8))): int(rng.paretovariate(.4)) % 10 ** 9 for _ in range(500)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = plain(words)
    assert any(r[1] and r[2] != r[1] for r in want)                 # a chain of forms
    assert rows_of(S.spelling_forms(df, leaf)) == want


def test_composition_accepts_each_pair_once():
    rng = random.Random(5)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(300)}
    pairs = [frozenset(p) for p in S.Acceptor(sorted(words)).pairs()]
    near = plain_near(words)
    assert len(pairs) == len(set(pairs)) and set(pairs) == {frozenset((a, b)) for a in words for b in near[a]}


def test_acceptor_is_minimal():
    a = S.Acceptor(sorted(["tapes", "taps", "topes", "tops"]))
    assert len(a.arcs) == 6            # t, a|o, p, e, s: both middles and all ends are shared


def test_long_words_in_a_leaf():
    long = "a" * 50_000
    found = S.near_words({long: 5, long + "a": 7, "b" + long: 1})
    assert found[long][0] == 2 and found[long + "a"] == [2, 5, long] and found[long][2] == long + "a"


def test_edges(spark):
    ddl = "doc_id long, text string, word string, n int, run string, `h.x` int"
    texts = [(1, "Strasse STRASSE strasse straße straße"), (2, None), (None, "weather weathers weather WEATHER"), (3, ""),
             (3, "Überall Überall überall short short"), (4, "x" * 2_000 + " " + "x" * 2_000), (4, "×÷×÷×÷×÷ ×÷×÷×÷×÷ naïveté naïveté")]
    texts += [(9, "gardens gardens"), (9, "gardens gardens")] + [(i, "gardener gardener") for i in range(20, 60)]
    df = spark.createDataFrame([(i, t, "w", 1, "r", 2) for i, t in texts], ddl)
    assert rows_of(S.spelling_variants(df)) == plain(plain_counts(texts))
    assert rows_of(S.spelling_variants(df.limit(0))) == set()


def test_query_equals_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in docs_of(spark).collect()]
    assert rows_of(S.op12_spelling_variants(spark, SF)) == plain(plain_counts(docs))
