"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts and digit or
symbol substitutions inside words (``1d10t``) become plain letters.  Lexicon entries are
whole words or word beginnings; an entry counts where a word begins, once a word and
with the largest weight that fits.  Exception phrases cancel entries inside them.  The
sum of weights over the number of words (at least MIN_WORDS) gives

    score = x / (x + scale),   x = sum of weights / words,

0.3 being the cut that separates the training texts best.

Training counts words and word beginnings in a bounded sample of labelled texts, keeps
entries far more frequent in toxic ones, and learns as exceptions the longer words that
contain an entry yet occur rather in clean texts.  Only text and label are used.

Edge cases: a null, empty or wordless text has score 0; without labelled texts of both
kinds the lexicon holds nothing and every score is 0; repeated rows get equal scores; an
empty table gives an empty result; input columns named like an output column are
replaced; texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.arrowtools import append_columns, worker_cache
from tillroll.session import ensure_checkpoint_dir

# Bounds of the model: labelled texts it is fitted on, and entries of the lexicon.
TRAIN_TEXTS = 20_000
MAX_ENTRIES = 500
# Entries need this many (and this share) of the toxic training texts, and this log ratio of their rates in toxic and in
# clean texts, less two standard errors; that lower bound is the weight.
MIN_TOXIC_TEXTS = 4
MIN_TOXIC_SHARE = 0.005
MIN_WEIGHT = 1.0
PREFIXES = range(3, 9)
MIN_WORDS = 30
CUT = 0.3

# Look-alikes of Latin letters, and digits or signs written for letters.
HOMOGLYPHS = str.maketrans({
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "α": "a", "β": "b", "ε": "e",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
})
SUBSTITUTES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
# Harmless phrases around words that often insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "sore loser")

_HOMOGLYPH = re.compile("[" + "".join(map(chr, HOMOGLYPHS)) + "]")
_FULL_WIDTH = re.compile("[！-～]")
_SUBSTITUTE = re.compile(r"(?<!\d)[013457@$!]+(?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Lexicon:
    """Entries (``^stem`` a word beginning, ``=word`` a whole word) with weights, exceptions, scale of the score."""

    entries: tuple[tuple[str, float], ...] = ()
    exceptions: tuple[str, ...] = EXCEPTIONS
    scale: float = 1.0


def fold(text: str) -> str:
    """Lower case with look-alike letters and substitutions undone (length may change by case folding only)."""
    low = text.lower()
    if not low.isascii():
        if _FULL_WIDTH.search(low):
            low = low.translate({c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}).lower()
        if _HOMOGLYPH.search(low):
            low = low.translate(HOMOGLYPHS)
    return _SUBSTITUTE.sub(lambda m: m.group().translate(SUBSTITUTES), low)


class Matcher:
    """Aho-Corasick automaton over the entries and exceptions of a lexicon."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.scale = lexicon.scale
        self.machine = ahocorasick.Automaton()
        kinds: dict[str, list[tuple[str, float]]] = {}
        for entry, weight in lexicon.entries:
            kinds.setdefault(entry[1:], []).append((entry[0], weight))
        for phrase in lexicon.exceptions:
            kinds.setdefault(phrase, []).append(("!", 0.0))
        for string, uses in kinds.items():
            self.machine.add_word(string, (len(string), uses))
        if kinds:
            self.machine.make_automaton()
        self.empty = not lexicon.entries

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """(start of word, weight) of every word that an entry fits and no exception covers."""
        if self.empty:
            return []
        best: dict[int, float] = {}
        safe: list[tuple[int, int]] = []
        n = len(folded)
        for last, (size, uses) in self.machine.iter(folded):
            start, end = last - size + 1, last + 1
            if start and folded[start - 1].isalpha():
                continue
            whole = end == n or not folded[end].isalpha()
            for kind, weight in uses:
                if kind == "!":
                    if whole:
                        safe.append((start, end))
                elif kind == "^" or whole:
                    best[start] = max(best.get(start, 0.0), weight)
        return [(s, w) for s, w in sorted(best.items()) if not any(a <= s < b for a, b in safe)]

    def rate(self, text: str | None) -> float:
        if not text:
            return 0.0
        folded = fold(text)
        found = self.hits(folded)
        return sum(w for _, w in found) / max(len(folded.split()), MIN_WORDS) if found else 0.0

    def score(self, text: str | None) -> float:
        x = self.rate(text)
        return x / (x + self.scale) if x else 0.0


def matcher(lexicon: Lexicon) -> Matcher:
    made = worker_cache("toxicity")
    key = repr(lexicon)
    if key not in made:
        made.clear()
        made[key] = Matcher(lexicon)
    return made[key]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no lexicon is learned from: crc32 of the id as text leaves 2 modulo 4 (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_texts(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_TEXTS) -> DataFrame:
    """(text, toxic) of at most ``limit`` labelled, not held-out ids (smallest id hashes first)."""
    picked = (labels.where("doc_id is not null and toxic is not null").where(~held_out())
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    return (docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
            .select("text", "toxic"))


def _features(batches):
    """Occurrences and texts of every word and word beginning, by label, of a task's texts."""
    counts: dict[str, Counter] = {}
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            side = "t" if toxic else "c"
            words = Counter(_WORD.findall(fold(text)))
            found: Counter = Counter()
            for word, n in words.items():
                if len(word) >= PREFIXES.start:
                    found["=" + word] += n
                    for k in PREFIXES:
                        if k < len(word):
                            found["^" + word[:k]] += n
            found["#"] = sum(words.values())                       # all words
            for feature, n in found.items():
                c = counts.setdefault(feature, Counter())
                c[side] += n
                c[side + "d"] += 1
    names = list(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), *(pa.array([counts[f][k] for f in names], pa.int64()) for k in ("t", "td", "c", "cd"))],
        names=["feature", "t", "td", "c", "cd"])


def learn(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_TEXTS) -> Lexicon:
    """Lexicon fitted on at most ``limit`` labelled texts that are not held out."""
    ensure_checkpoint_dir(docs.sparkSession)
    sample = training_texts(docs, labels, limit).repartition(8).checkpoint()
    counts = (sample.mapInArrow(_features, "feature string, t long, td long, c long, cd long")
              .groupBy("feature").agg(*[F.sum(k).alias(k) for k in ("t", "td", "c", "cd")])).checkpoint()
    total = counts.where("feature = '#'").first()
    if not total or not total["t"] or not total["c"]:
        return Lexicon()
    t_rate = (F.col("t") + 0.5) / total["t"]
    c_rate = (F.col("c") + 0.5) / total["c"]
    rated = (counts.where("feature <> '#'").withColumn("ratio", F.log(t_rate / c_rate))
             .withColumn("weight", F.col("ratio") - 2 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))))
    strong = rated.where((F.col("td") >= max(MIN_TOXIC_TEXTS, MIN_TOXIC_SHARE * total["td"])) & (F.col("weight") >= MIN_WEIGHT))
    top = strong.orderBy(F.desc("weight"), F.desc(F.length("feature")), "feature").limit(8 * MAX_ENTRIES).collect()     # bounded
    entries: list[tuple[str, float]] = []
    for row in top:
        kind, stem = row["feature"][0], row["feature"][1:]
        overlaps = any(e[0] == "^" and stem.startswith(e[1:]) or kind == "^" and e[1:].startswith(stem)
                       for e, _ in entries)
        if not overlaps and len(entries) < MAX_ENTRIES:
            entries.append((row["feature"], round(float(row["weight"]), 4)))
    stems = [e[1:] for e, _ in entries if e[0] == "^"]
    exceptions: tuple[str, ...] = EXCEPTIONS
    if stems:
        inside = F.lit(False)
        for size in sorted({len(s) for s in stems}):
            inside = inside | F.substring("feature", 2, size).isin([s for s in stems if len(s) == size])
        harmless = rated.where(F.col("feature").startswith("=")).where(inside).where(
            (F.col("ratio") < 0) & (F.col("cd") >= 3)).orderBy(F.desc("c"), "feature").limit(8 * MAX_ENTRIES).collect()
        exceptions += tuple(r["feature"][1:] for r in harmless)
    return calibrate(sample, Lexicon(tuple(entries), exceptions))


def calibrate(sample: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Sets the scale so that the cut with the best F1 on ``sample`` (bounded) gets score 0.3."""
    def rates(batches):
        use = matcher(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([use.rate(t) for t in batch.column("text").to_pylist()], pa.float64()),
                 batch.column("toxic").cast(pa.int64())], names=["x", "toxic"])

    rows = sample.mapInArrow(rates, "x double, toxic long").collect()                       # numbers, bounded
    x, y = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows])
    order = np.argsort(-x, kind="stable")
    x, y = x[order], y[order]
    caught = np.cumsum(y)
    f1 = 2 * caught / (np.arange(1, len(y) + 1) + y.sum())
    f1[(np.append(x[1:], -1.0) == x) | (x <= 0)] = 0.0                                      # only between different rates
    k = int(np.argmax(f1))
    if x[k] <= 0:
        return lexicon
    below = x[k + 1] if k + 1 < len(x) else 0.0
    cut = math.sqrt(x[k] * below) if below > 0 else x[k] / 2
    return Lexicon(lexicon.entries, lexicon.exceptions, cut * (1 - CUT) / CUT)


def toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``score`` (0 to 1)."""
    def run(column: pa.Array) -> dict[str, pa.Array]:
        use = matcher(lexicon)
        return {"score": pa.array([use.score(t) for t in column.to_pylist()], pa.float64())}

    return append_columns(docs, text_col, "score double", run, owner="toxicity")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lexicon = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs.select("doc_id", "text"), lexicon).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
