"""Spelling variants by finite-state composition, exact and without listing candidate pairs.

The vocabulary V is an acceptor A.  Composed with the one-edit transducer E (copy a code
point, or once replace, delete or insert one) and with A again it accepts just the pairs
of words that differ by one edit.  Before the edit both copies of A have read the same
prefix, so a state of the composition is (p, before, p) or, behind the edit, (p, after, q),
and there only equal suffixes are read.  The composition is cut at its initial states:

* A prefix read by more than ``LEAF_WORDS`` words is split by its next code point, until
  every partition (leaf) holds at most so many words.  Of each leaf the minimised acceptor
  is built in a task, its composition is walked and the accepted pairs are added up per
  word; the edits of a state are made once, however many prefixes lead to it.
* An edit above the leaves, at place i of a word, leaves a prefix and a suffix that must
  both be equal: words meet on (i, word without its code point i), where a replaced code
  point joins words that lost one each, and an insertion joins a word that lost one with
  a whole word.  One place has at most one code point of the alphabet for each member, so
  a meeting has at most as many members as the alphabet has code points, plus one.

The common prefix of two words is shorter than the leaf's or not, so every pair is found
once: at its first differing code point.  Only sums and the best neighbour of each word
are shuffled on, never the pairs.

Edge cases: null and empty texts have no words; a null id reads as the empty text in the
deletion rule; ties of the count go to the smaller word in code-point order; repeated rows
count each; a form needs ten times the word's count, so chains of forms rise and end; an
empty table gives an empty result; extra columns are ignored.  A task's memory grows with
``LEAF_WORDS`` times the longest word.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import ensure_checkpoint_dir

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH = 7
LEAST_COUNT = 2
DELETE_EVERY = 31
FORM_TIMES = 10
LEAF_WORDS = 2_000
LEVELS = 3                      # prefix lengths looked at in one round
HOT_BROADCAST = 100_000         # split prefixes up to this number go to every task


class Acceptor:
    """Minimal acyclic acceptor of sorted distinct words: ``arcs[state]`` maps code points to states."""

    def __init__(self, words: list[str]):
        arcs: list[dict[str, int]] = [{}]
        final = [False]
        for word in words:
            at = 0
            for c in word:
                if c not in arcs[at]:
                    arcs[at][c] = len(arcs)
                    arcs.append({})
                    final.append(False)
                at = arcs[at][c]
            final[at] = True
        known: dict[tuple, int] = {}
        same = [0] * len(arcs)
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        for state in range(len(arcs) - 1, -1, -1):          # children have greater numbers
            key = (final[state], *((c, same[t]) for c, t in arcs[state].items()))
            if key not in known:
                known[key] = len(self.arcs)
                self.arcs.append({c: same[t] for c, t in arcs[state].items()})
                self.final.append(final[state])
            same[state] = known[key]
        self.start = same[0]

    def common(self, a: int, b: int, unless: str = "") -> Iterator[str]:
        """Suffixes accepted from both states, but for those that begin with ``unless``."""
        if self.final[a] and self.final[b]:
            yield ""
        path: list[str] = []
        open_ = [self._shared(a, b, unless)]
        while open_:
            step = next(open_[-1], None)
            if step is None:
                open_.pop()
                if path:
                    path.pop()
                continue
            c, x, y = step
            path.append(c)
            if self.final[x] and self.final[y]:
                yield "".join(path)
            open_.append(self._shared(x, y))

    def _shared(self, a: int, b: int, unless: str = "") -> Iterator[tuple[str, int, int]]:
        left, right = self.arcs[a], self.arcs[b]
        if len(right) < len(left):
            return ((c, left[c], t) for c, t in right.items() if c in left and c != unless)
        return ((c, t, right[c]) for c, t in left.items() if c in right and c != unless)

    def edits(self, state: int) -> list[tuple[str, str]]:
        """Pairs of suffixes of ``state`` that differ by an edit right at their first code point."""
        out = []
        arcs = list(self.arcs[state].items())
        for i, (c, x) in enumerate(arcs):
            for d, y in arcs[i + 1:]:
                out += [(c + z, d + z) for z in self.common(x, y)]
            out += [(c + z, z) for z in self.common(x, state, unless=c)]
        return out

    def pairs(self) -> Iterator[tuple[str, str]]:
        """All accepted pairs of the composition with the one-edit transducer, each once."""
        made: dict[int, list[tuple[str, str]]] = {}
        path: list[str] = []
        open_ = [(self.start, iter(self.arcs[self.start].items()))]
        fresh = True
        while open_:
            state, arcs = open_[-1]
            if fresh:
                if state not in made:
                    made[state] = self.edits(state)
                if made[state]:
                    prefix = "".join(path)
                    for u, v in made[state]:
                        yield prefix + u, prefix + v
            step = next(arcs, None)
            fresh = step is not None
            if step is None:
                open_.pop()
                if path:
                    path.pop()
            else:
                path.append(step[0])
                open_.append((step[1], iter(self.arcs[step[1]].items())))


def near_words(counts: dict[str, int]) -> dict[str, list]:
    """word -> [near words, best count, best word] of the words that have a near word among ``counts``."""
    found: dict[str, list] = {}
    for u, v in Acceptor(sorted(counts)).pairs():
        for word, other in ((u, v), (v, u)):
            n = counts[other]
            best = found.setdefault(word, [0, 0, ""])
            best[0] += 1
            if n > best[1] or n == best[1] and other < best[2]:
                best[1:] = n, other
    return found


def _leaf_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, word, n) rows sorted by leaf; one leaf is held at a time."""
    def done(counts: dict[str, int]) -> pa.RecordBatch:
        found = near_words({w[cut:]: n for w, n in counts.items()}) if len(counts) > 1 else {}
        return pa.RecordBatch.from_arrays(
            [pa.array([leaf + w for w in found], pa.string()), pa.array([b[0] for b in found.values()], pa.int64()),
             pa.array([b[1] for b in found.values()], pa.int64()), pa.array([leaf + b[2] for b in found.values()], pa.string())],
            names=["word", "n_near", "best_n", "best"])

    leaf, cut, counts = None, 0, {}
    for batch in batches:
        for key, word, n in zip(*(batch.column(c).to_pylist() for c in ("leaf", "word", "n"))):
            if key != leaf:
                if len(counts) > 1:
                    yield done(counts)
                leaf, cut, counts = key, len(key), {}
            counts[word] = n
    if len(counts) > 1:
        yield done(counts)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", delete_every: int = DELETE_EVERY) -> DataFrame:
    """(word, n): lower-cased runs of at least ``LEAST_LENGTH`` letters with their counts, ``LEAST_COUNT`` at least.

    Of a run whose CRC-32 with the id is divisible by ``delete_every`` one code point is
    deleted (0: of none).
    """
    run = F.explode(F.regexp_extract_all(docs[f"`{text_col}`"], F.lit(f"([{LETTERS}]{{{LEAST_LENGTH},}})"), F.lit(1)))
    rows = docs.select(F.coalesce(docs[f"`{id_col}`"].cast("string"), F.lit("")).alias("id"), run.alias("run"))
    rows = rows.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    word = F.col("run")
    if delete_every:
        rows = rows.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
        at = F.pmod("h", F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.col("h") % delete_every == 0, cut).otherwise(F.col("run"))
    return (rows.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT))


def with_depth(words: DataFrame, leaf_words: int = LEAF_WORDS) -> DataFrame:
    """``words`` (word, n) plus ``depth``: the length of the shortest prefix that at most ``leaf_words`` words share.

    A word that is itself shared too often gets one more than its length.  A few lengths
    a round; only words whose prefixes were all split go on to the next.
    """
    done, level = None, 0
    now = words.select("word", "n")
    while True:
        lengths = F.sequence(F.lit(level), F.least(F.lit(level + LEVELS - 1), F.length("word")))
        prefixes = (now.where(F.length("word") >= level).select("word", F.explode(lengths).alias("l"))
                    .withColumn("prefix", F.substring("word", F.lit(1), F.col("l"))))
        hot = prefixes.groupBy("prefix").agg(F.count("*").alias("m")).where(F.col("m") > leaf_words).select("prefix").checkpoint()
        split = hot.count()
        small = F.broadcast(hot) if split <= HOT_BROADCAST else hot
        depth = prefixes.join(small, "prefix", "left_semi").groupBy("word").agg((F.max("l") + 1).alias("depth"))
        placed = now.join(depth, "word", "left").withColumn("depth", F.coalesce("depth", F.lit(level))) if split else (
            now.withColumn("depth", F.lit(level)))
        placed = placed.checkpoint()
        level += LEVELS
        ended = placed.where(F.col("depth") < level)
        done = ended if done is None else done.unionByName(ended)
        now = placed.where(F.col("depth") >= level).select("word", "n")
        if not split or now.isEmpty():
            return done


def _edits_in_leaves(placed: DataFrame) -> DataFrame:
    rows = placed.where(F.col("depth") <= F.length("word")).select(
        F.substring("word", F.lit(1), F.col("depth")).alias("leaf"), "word", "n")
    return (rows.repartition("leaf").sortWithinPartitions("leaf", "word")
            .mapInArrow(_leaf_task, "word string, n_near long, best_n long, best string"))


def _edits_above_leaves(placed: DataFrame) -> DataFrame:
    """The same sums for edits at a place above the word's leaf, found on (place, word without it)."""
    n = F.length("word")
    place = F.explode(F.sequence(F.lit(0), F.least(F.col("depth") - 1, n)))
    at = placed.where("depth > 0").select("word", "n", place.alias("i"))
    rest = F.substring("word", F.col("i") + 2, F.length("word"))
    lost = F.struct(F.concat(F.substring("word", F.lit(1), F.col("i")), rest).alias("left"), F.lit(False).alias("whole"),
                    (F.substring("word", F.col("i") + 1, F.lit(1)) != F.substring("word", F.col("i") + 2, F.lit(1))).alias("ends"))
    kept = F.struct(F.col("word").alias("left"), F.lit(True).alias("whole"), F.lit(False).alias("ends"))
    one = at.withColumn("m", F.explode(F.when(F.col("i") < F.length("word"), F.array(lost, kept)).otherwise(F.array(kept))))
    # at most the alphabet's size and one more
    met = (one.groupBy("i", "m.left").agg(F.collect_list(F.struct("word", "n", "m.whole", "m.ends")).alias("all"))
           .where(F.size("all") > 1).withColumn("own", F.explode("all")))
    own = F.col("own")
    others = F.filter("all", lambda o: (o["word"] != own["word"]) & (
        (~o["whole"] & ~own["whole"]) | (o["whole"] & own["ends"]) | (own["whole"] & o["ends"])))
    best = F.array_min(F.transform(others, lambda o: F.struct((-o["n"]).alias("less"), o["word"].alias("other"))))
    return (met.select(own["word"].alias("word"), F.size(others).cast("long").alias("n_near"), best.alias("b"))
            .where("n_near > 0").select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.other").alias("best")))


def near_summary(words: DataFrame, leaf_words: int = LEAF_WORDS) -> DataFrame:
    """(word, n, n_near, best, best_n) of every word: its near words' number and the most frequent of them."""
    placed = with_depth(words, leaf_words)
    sums = _edits_in_leaves(placed).unionByName(_edits_above_leaves(placed)).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b"))
    return (words.join(sums, "word", "left")
            .select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("b.best").alias("best"),
                    (-F.col("b.less")).alias("best_n")))


def spelling_forms(words: DataFrame, leaf_words: int = LEAF_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n).

    Forms have ever greater counts, so their chains end; links are doubled each round.
    """
    ensure_checkpoint_dir(words.sparkSession)
    words = words.select("word", "n").checkpoint()
    is_form = F.col("best_n") >= FORM_TIMES * F.col("n")
    rows = near_summary(words, leaf_words).select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", "n_near", F.when(is_form, F.col("best_n")).alias("form_n")).checkpoint()
    links = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                          F.col("next").isNotNull().alias("moved")).checkpoint()
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return (rows.join(links, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      delete_every: int = DELETE_EVERY, leaf_words: int = LEAF_WORDS) -> DataFrame:
    """``spelling_forms`` of the words of ``docs``."""
    return spelling_forms(word_counts(docs, id_col, text_col, delete_every), leaf_words)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
