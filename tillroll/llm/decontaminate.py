"""Benchmark decontamination with DataFrame functions only.

A text is contaminated by a benchmark item if one of its windows of the item's length
(in words) has a weighted-shingle similarity of 0.8 or more with the item:

    2 * sum_s weight(s) * min(count in window, count in item)
    / sum_s weight(s) * (count in window + count in item)

over 5-word shingles s, weight(s) being the letters and digits of s.

1. Texts and items that share too few shingles are left out: the shared weight of a
   window that reaches 0.8 is at least two thirds of the item's.  The bound is kept per
   text and item, then per start of an item-sized window; every start that keeps it is a
   window, whether an item shingle lines up with it or not, so this loses nothing.
2. SimHash: every such window gets a 64-bit fingerprint of its weighted shingles (a bit
   is 1 if the shingles whose hash has it weigh more than half), as every item has.
3. Multi-index Hamming blocks: the bits are cut into RADIUS + 1 blocks; fingerprints
   within RADIUS bits agree in one of them at least, so a join on (item, block, value)
   finds them all, and the distance is then counted.
4. The exact similarity verifies every window found.

RADIUS is chosen by measurement (``tests/llm/test_decontaminate.py``, README): edited,
cut and shifted items whose best window is just above 0.8 all lie within it.

Texts are told by their hash, so copies are looked at once, and only numbers (hashes,
places, weights, counts) are shuffled.

Words are runs of letters and digits, lower-cased.  Edge cases: null and empty texts are
clean; items that are null or under 5 words cannot be judged and flag nothing; repeated
rows get equal results; rows with one id and several texts are judged each on its own
text; ties of the similarity go to the smaller item; an empty table on either side leaves every
row clean; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import ensure_checkpoint_dir

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
RADIUS = 28
# Item shingles up to this number are broadcast (about 50 bytes each); more are shuffle-joined.
BROADCAST_SHINGLES = 500_000
# Texts with windows up to this number are broadcast to the scan (about 30 bytes each); more are shuffle-joined.
BROADCAST_TEXTS = 500_000


def words_of(text: Column) -> Column:
    """Lower-cased words; an empty array for null."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def shingle_hashes(words: str, size: int = SHINGLE_WORDS) -> Column:
    """Hashes of the shingles of the array column ``words``, in order; none for fewer words."""
    picked = ", ".join(f"{words}[i + {k}]" for k in range(size))
    return F.expr(f"CASE WHEN size({words}) < {size} THEN cast(array() AS array<bigint>) "
                  f"ELSE transform(sequence(0, size({words}) - {size}), i -> xxhash64({picked})) END")


def shingle_weights(words: str, size: int = SHINGLE_WORDS) -> Column:
    """Letters and digits of each shingle, in order."""
    picked = " + ".join(f"length({words}[i + {k}])" for k in range(size))
    return F.expr(f"CASE WHEN size({words}) < {size} THEN cast(array() AS array<bigint>) "
                  f"ELSE transform(sequence(0, size({words}) - {size}), i -> cast({picked} AS bigint)) END")


def blocks(fp: str, radius: int = RADIUS) -> Column:
    """Array of (number, value) of the ``radius`` + 1 blocks of a fingerprint."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.expr("array(" + ", ".join(
        f"struct({k} AS block, shiftrightunsigned({fp}, {a}) & {(1 << (b - a)) - 1}L AS value)"
        for k, (a, b) in enumerate(zip(cuts, cuts[1:]))) + ")")


def with_fingerprints(shingles: DataFrame, *by: str) -> DataFrame:
    """(by..., weight, fp) of groups of weighted shingles (h, w)."""
    sums = [F.sum(F.when(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(1)) == 1, F.col("w")).otherwise(F.lit(0))).alias(f"b{k}")
            for k in range(64)]
    bits = [F.when(2 * F.col(f"b{k}") > F.col("weight"), F.lit(1 << k if k < 63 else -(1 << 63)).cast("long"))
            .otherwise(F.lit(0).cast("long")) for k in range(64)]
    # bits do not overlap, so their sum is their union; added as a balanced tree
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2])]
    return shingles.groupBy(*by).agg(F.sum("w").alias("weight"), *sums).select(*by, "weight", bits[0].alias("fp"))


def item_table(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, length, hashes, weights, weight) of items of 5 words or more."""
    return (items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("item_words"))
            .where(F.size("item_words") >= SHINGLE_WORDS).distinct()
            .select("item_id", F.size("item_words").alias("length"), shingle_hashes("item_words").alias("hashes"),
                    shingle_weights("item_words").alias("weights"))
            .withColumn("item_no", F.xxhash64("item_id", "hashes"))          # an id may stand on several texts
            .withColumn("item_weight", F.aggregate("weights", F.lit(0).cast("long"), lambda a, w: a + w)))


def _reaches(shared: Column) -> Column:
    """The least shared weight of a window of similarity 0.8: 2 s / (s + item) >= 0.8."""
    return 3 * shared >= 2 * F.col("item_weight")


def windows(docs: DataFrame, items: DataFrame, text_col: str, broadcast: bool) -> DataFrame:
    """(text_hash, item_no, item_id, item_weight, start, last) of the item-sized windows that could reach 0.8.

    ``start`` and ``last`` are the places of the window's first and last shingle.  Only
    numbers are exploded: the hash of the text, and place and hash of each shingle.
    """
    item = ["item_no", "item_id", "length", "item_weight"]
    anchors = items.select(*item, F.posexplode_outer(F.arrays_zip("hashes", "weights")).alias("at", "s")).select(
        *item, "at", F.col("s.hashes").alias("h"), F.col("s.weights").alias("w"))
    rows = docs.select(F.xxhash64(text_col).alias("text_hash"), words_of(F.col(text_col)).alias("words"))
    # Outer generators: from inner ones Catalyst infers a filter on the array's size and, pushing it
    # to the scan, would split the text anew for every shingle.
    places = (rows.select("text_hash", F.size("words").alias("n"), shingle_hashes("words").alias("hashes"))
              .select("text_hash", "n", F.posexplode_outer("hashes").alias("p", "h")))
    hits = (places.join(F.broadcast(anchors) if broadcast else anchors, "h")
            .select("text_hash", "n", *item, "p", "at", "w").distinct().checkpoint())
    enough = (hits.select("text_hash", "item_no", "item_weight", "at", "w").distinct()
              .groupBy("text_hash", "item_no", "item_weight").agg(F.sum("w").alias("s")).where(_reaches(F.col("s"))))
    spots = hits.join(enough, ["text_hash", "item_no"], "left_semi").select("text_hash", "n", *item, "p", "w").distinct()
    span = F.least("n", "length") - SHINGLE_WORDS                           # from a window's first shingle to its last
    start = F.explode(F.sequence(F.greatest(F.lit(0), F.col("p") - span), F.least(F.col("p"), F.col("n") - SHINGLE_WORDS - span)))
    return (spots.withColumn("start", start).groupBy("text_hash", "n", *item, "start").agg(F.sum("w").alias("s"))
            .where(_reaches(F.col("s"))).select("text_hash", "item_no", "item_id", "item_weight", "start",
                                                (F.col("start") + span).alias("last")).checkpoint())


def window_shingles(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """(text_hash, lo, shingles) of the texts with windows: their shingles (h, w) from the first window to the last."""
    spans = found.groupBy("text_hash").agg(F.min("start").alias("lo"), F.max("last").alias("hi"))
    few = F.broadcast(spans) if spans.count() <= BROADCAST_TEXTS else spans
    rows = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).join(few, "text_hash")
    rows = rows.select("text_hash", "lo", "hi", words_of(F.col("text")).alias("words"))
    # the words of the span alone
    rows = rows.select("text_hash", "lo", F.slice("words", F.col("lo") + 1, F.col("hi") - F.col("lo") + SHINGLE_WORDS).alias("words"))
    both = F.arrays_zip(shingle_hashes("words").alias("h"), shingle_weights("words").alias("w"))
    # copies of a text have the same shingles
    return rows.select("text_hash", "lo", both.alias("shingles")).groupBy("text_hash").agg(
        F.min("lo").alias("lo"), F.any_value("shingles").alias("shingles")).checkpoint()


def text_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
               item_text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(text_hash, item_id, start, similarity) of every verified window; ``start`` counts words from 0."""
    ensure_checkpoint_dir(docs.sparkSession)
    items = item_table(benchmark, item_id, item_text).checkpoint()
    n = items.agg(F.sum(F.size("hashes"))).first()[0] or 0
    small = n <= BROADCAST_SHINGLES
    hint = F.broadcast if small else (lambda df: df)
    found = windows(docs, items, text_col, small)
    shingles = window_shingles(docs, found, text_col)

    def inside(some: DataFrame, *by: str) -> DataFrame:
        """Shingles of windows, dealt by text: sums over a window need no further shuffle."""
        own = F.slice("shingles", F.col("start") - F.col("lo") + 1, F.col("last") - F.col("start") + 1)
        span = ["text_hash", "start", "last"]
        return some.select(*by, *span).join(shingles, "text_hash").select(*by, *span, F.inline_outer(own))

    spots = found.select("text_hash", "start", "last").distinct()
    prints = with_fingerprints(inside(spots), "text_hash", "start", "last").drop("weight")
    item_shingles = items.select("item_no", F.inline_outer(F.arrays_zip(F.col("hashes").alias("h"), F.col("weights").alias("w"))))
    item_blocks = with_fingerprints(item_shingles, "item_no").select("item_no", F.col("fp").alias("item_fp")).select(
        "item_no", "item_fp", F.inline_outer(blocks("item_fp", radius)))
    near = (found.join(prints, ["text_hash", "start", "last"]).select(*found.columns, "fp", F.inline_outer(blocks("fp", radius)))
            .join(hint(item_blocks), ["item_no", "block", "value"])
            .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
            .select(*found.columns).distinct())
    item = ["item_no", "item_id", "item_weight"]
    window = ["text_hash", "start", *item]
    counted = inside(near, *item).groupBy(*window, "h", "w").agg(F.count("*").alias("c"))
    of_item = item_shingles.groupBy("item_no", "h").agg(F.count("*").alias("of_item"))
    both = counted.join(hint(of_item), ["item_no", "h"], "left")
    exact = both.groupBy(*window).agg(F.sum(F.col("w") * F.col("c")).alias("weight"),
                                      F.sum(F.col("w") * F.least("c", F.coalesce("of_item", F.lit(0)))).alias("shared"))
    return (exact.withColumn("similarity", 2.0 * F.col("shared") / (F.col("weight") + F.col("item_weight")))
            .where(F.col("similarity") >= MIN_SIMILARITY).select("text_hash", "item_id", "start", "similarity"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, text_hash, item_id, start, similarity) of every verified window of every row."""
    found = _few(text_leaks(docs, benchmark, text_col, item_id, item_text))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"))
    return rows.join(found, "text_hash").select("id", "text_hash", "item_id", "start", "similarity")


def _few(per_text: DataFrame) -> DataFrame:
    """Contaminated texts, one row each: broadcast up to a counted bound, so that copies of one text stay where they are."""
    per_text = per_text.checkpoint()
    return F.broadcast(per_text) if per_text.count() <= BROADCAST_TEXTS else per_text


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, contaminated, n_items, best_item, best_similarity) of every row of ``docs``."""
    per_text = (text_leaks(docs, benchmark, text_col).groupBy("text_hash")
                .agg(F.countDistinct("item_id").alias("n_items"),
                     F.max(F.struct("similarity", (-F.col("item_id")).alias("minus"))).alias("best"))
                .withColumnRenamed("text_hash", "of_hash"))
    per_text = _few(per_text)
    rows = docs.select(F.col(id_col).alias("row_id"), F.xxhash64(text_col).alias("row_hash"))
    return rows.join(per_text, rows.row_hash == per_text.of_hash, "left").select(
        F.col("row_id").alias(id_col), F.col("best").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), (-F.col("best.minus")).alias("best_item"),
        F.col("best.similarity").alias("best_similarity"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                         spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated rows go."""
    bad = _few(text_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("text_hash").distinct())
    return docs.join(bad, F.xxhash64(docs.text) == bad.text_hash, "left_anti")
