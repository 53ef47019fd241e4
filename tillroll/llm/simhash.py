"""SimHash near-duplicates with bit-sliced comparison.

A text's fingerprint holds, for each of 64 bits, the majority over the XXH64 values of
its word shingles.  Two fingerprints link if at most ``radius`` bits differ.

The 64 bits are cut into 7 blocks; fingerprints within 4 bits agree on at least 3 of
them, so every link shows among fingerprints that are equal on one of the 35 choices of
3 blocks.  Distinct fingerprints are dealt out by (choice, value of its blocks) and
compared inside each such bucket on bit planes: plane b holds bit b of many
fingerprints side by side in 64-bit words, carry-save adders count the differing bits
of 64 comparisons per word operation, and words all of whose comparisons have passed
the radius are abandoned.  A bucket gives only links that span its groups, never all
pairs.  Buckets above ``HOT_BUCKET`` fingerprints are cut into chunks and every pair of
chunks is compared in a group of its own, so no task holds a whole hot bucket.

Edge cases: a text without words (null, empty, white space) has fingerprint zero and
links like any other; repeated rows and equal texts share a fingerprint and a
component; a component without any non-null id has a null component id; an empty table
gives an empty result; texts are read whole; input columns named like an output column
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.arrowtools import append_columns, text_bytes, worker_cache
from tillroll.llm.graph import connected_components
from tillroll.session import ensure_checkpoint_dir

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
# 7 blocks, any 3 of which must agree: 7 - 3 = 4 differing bits spoil at most 4 blocks.
BLOCK_BITS = (9, 9, 9, 9, 9, 9, 10)
EQUAL_BLOCKS = 3
# Fingerprints of a bucket that one task compares at most; larger buckets go in chunk pairs.
HOT_BUCKET = 4096
# Runs up to this length are compared by shifting the planes, longer ones by search.
SHIFT_RUN = 32
_SHINGLES_AT_ONCE = 1 << 18
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def fingerprints(column: pa.Array, words_each: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit fingerprints of a batch of texts."""
    import xxhash

    raw, off = text_bytes(column)
    n = len(off) - 1
    low = _FOLD[raw].tobytes()
    words: list[bytes] = []
    counts = np.zeros(n, np.int64)
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        found = low[a:b].split()
        counts[i] = len(found)
        words += found
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(lens + 1) - 1                                   # of each word in ``joined``
    begin = end - lens
    first = np.cumsum(counts) - counts                              # first word of each text
    shingles = np.where(counts >= words_each, counts - words_each + 1, np.minimum(counts, 1))
    width = np.minimum(counts, words_each)
    doc = np.repeat(np.arange(n), shingles)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[doc]
    ones = np.zeros((n, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(doc), _SHINGLES_AT_ONCE):
        d, w = doc[k:k + _SHINGLES_AT_ONCE], at[k:k + _SHINGLES_AT_ONCE]
        a, b = begin[w].tolist(), end[w + width[d] - 1].tolist()
        h = np.fromiter((digest(joined[x:y], SEED) for x, y in zip(a, b)), np.uint64, len(d))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        ones[d[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view("<u8").ravel()


def planes(values: np.ndarray) -> np.ndarray:
    """[64, words] bit planes: bit j of word k of row b is bit b of value 64 k + j."""
    size = -(-len(values) // 64) * 64
    padded = np.zeros(size, np.uint64)
    padded[:len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def near(differ: np.ndarray, dead: np.ndarray, radius: int) -> np.ndarray:
    """Packed mask of the comparisons with at most ``radius`` set bits over the 64 rows of ``differ``.

    Eight rows at a time go through a tree of carry-save adders into vertical counters
    of 4 bits (``radius`` under 8); ``over`` marks what has left their range or was
    ``dead`` at the start.  Words with every comparison beyond the radius are dropped.
    """
    def add3(a, b, c):                                              # carry-save: sum and carry
        u = a ^ b
        return u ^ c, (a & b) | (u & c)

    columns = np.flatnonzero(dead != _FULL)
    out = np.zeros(len(dead), np.uint64)
    over = dead[columns]
    c1, c2, c4 = (np.zeros(len(columns), np.uint64) for _ in range(3))
    for r in range(0, 64, 8):
        x = differ[r:r + 8, columns]
        s1, k1 = add3(x[0], x[1], x[2])
        s2, k2 = add3(x[3], x[4], x[5])
        s3, k3 = add3(x[6], x[7], c1)
        c1, k4 = add3(s1, s2, s3)
        t1, q1 = add3(k1, k2, k3)
        t2, q2 = t1 ^ k4, t1 & k4
        c2, q3 = t2 ^ c2, t2 & c2
        u, e1 = add3(q1, q2, q3)
        c4, e2 = u ^ c4, u & c4
        over = over | e1 | e2
        alive = np.flatnonzero((over | beyond(c1, c2, c4, radius)) != _FULL)
        if len(alive) < len(columns):                               # abandon the others
            columns, over, c1, c2, c4 = columns[alive], over[alive], c1[alive], c2[alive], c4[alive]
            if not len(columns):
                return out
    out[columns] = ~(over | beyond(c1, c2, c4, radius))
    return out


def beyond(c1, c2, c4, radius: int) -> np.ndarray:
    """Mask of the counters c1 + 2 c2 + 4 c4 that exceed ``radius`` (0 to 7)."""
    out = np.zeros(len(c1), np.uint64)
    for value in range(radius + 1, 8):
        out |= ((c1 if value & 1 else ~c1) & (c2 if value & 2 else ~c2) & (c4 if value & 4 else ~c4))
    return out


def _set_bits(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))


def short_run_links(values: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked index pairs inside runs (equal ``run``) of at most SHIFT_RUN values."""
    rows = planes(values)
    left, right = [], []
    for d in range(1, min(SHIFT_RUN, len(values))):
        same = np.zeros(rows.shape[1] * 64, bool)
        same[:len(run) - d] = run[d:] == run[:-d]
        if not same.any():
            break
        words, bits = divmod(d, 64)
        moved = np.zeros_like(rows)
        moved[:, :rows.shape[1] - words] = rows[:, words:]
        if bits:
            low = moved >> np.uint64(bits)
            low[:, :-1] |= moved[:, 1:] << np.uint64(64 - bits)
            moved = low
        hit = _set_bits(near(rows ^ moved, ~np.packbits(same, bitorder="little").view("<u8"), radius))
        left.append(hit), right.append(hit + d)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def long_run_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the groups of one run: each value found is searched from once.

    Only values that no group has yet are compared, so a dense run costs little more
    than its length.
    """
    index = np.arange(len(values))
    left, right = [], []
    stack: list[int] = []
    rows = planes(values)
    open_ = np.zeros(rows.shape[1] * 64, bool)
    open_[:len(index)] = True
    remaining = built = len(index)
    while remaining or stack:
        if remaining < built // 2:                                  # keep the planes to what is open
            index = index[open_[:len(index)]]
            rows = planes(values[index])
            open_ = np.zeros(rows.shape[1] * 64, bool)
            open_[:len(index)] = True
            built = max(remaining, 1)
        if not stack:
            k = int(np.flatnonzero(open_)[0])
            open_[k] = False
            remaining -= 1
            stack.append(int(index[k]))
        if not remaining:
            break
        at = stack.pop()
        bits = np.where((values[at] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), _FULL, np.uint64(0))
        hit = _set_bits(near(rows ^ bits[:, None], ~np.packbits(open_, bitorder="little").view("<u8"), radius))
        if len(hit):
            open_[hit] = False
            remaining -= len(hit)
            found = index[hit]
            left.append(np.full(len(found), at)), right.append(found)
            stack += found.tolist()
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def bucket_links(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among ``values`` with equal ``keys`` (sorted by key)."""
    run = np.cumsum(np.concatenate([[0], (keys[1:] != keys[:-1])]).astype(np.int64))
    length = np.bincount(run)[run]
    a, b = [], []
    short = np.flatnonzero((length > 1) & (length <= SHIFT_RUN))
    if len(short):
        i, j = short_run_links(values[short], run[short], radius)
        a.append(values[short][i]), b.append(values[short][j])
    for r in np.unique(run[length > SHIFT_RUN]):
        members = values[np.searchsorted(run, r):np.searchsorted(run, r, side="right")]
        i, j = long_run_links(members, radius)
        a.append(members[i]), b.append(members[j])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _link_task(radius: int):
    """mapInArrow function over (key, fp) rows sorted by key; holds whole runs only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(keys, values):
            a, b = bucket_links(keys, values, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        worker_cache("simhash")
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))              # where the last, unfinished run begins
            if cut:
                held.append((keys[:cut], values[:cut]))
                yield links(*(np.concatenate(x) for x in zip(*held)))
                held = []
            elif held and held[-1][0][-1] != keys[0]:
                yield links(*(np.concatenate(x) for x in zip(*held)))
                held = []
            held.append((keys[cut:], values[cut:]))
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held)))
    return run


def block_masks(bits: tuple[int, ...] = BLOCK_BITS, equal: int = EQUAL_BLOCKS) -> list[int]:
    """Bit masks of every choice of ``equal`` blocks."""
    starts = np.concatenate([[0], np.cumsum(bits)])
    blocks = [((1 << b) - 1) << int(s) for b, s in zip(bits, starts)]
    return [reduce(int.__or__, chosen) for chosen in combinations(blocks, equal)]


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that span the groups of the distinct fingerprints ``fps`` (column fp)."""
    if not 0 <= radius <= len(BLOCK_BITS) - EQUAL_BLOCKS:
        raise ValueError(f"the blocks cover a radius of 0 to {len(BLOCK_BITS) - EQUAL_BLOCKS} bits")
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks()]
    # the key mixes the choice with the bits of its blocks; a rare clash of keys only adds comparisons
    keyed = fps.select("fp", F.explode(F.array(*[
        F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])).alias("key"))
    task = _link_task(radius)

    def compared(rows: DataFrame, *by: str) -> DataFrame:
        return rows.repartition(*by).sortWithinPartitions(*by).select("key", "fp").mapInArrow(task, "a long, b long")

    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_BUCKET).checkpoint()
    if hot.isEmpty():
        return compared(keyed, "key").distinct()
    cold = keyed.join(hot, "key", "left_anti")
    chunks = F.ceil(F.col("n") / (HOT_BUCKET // 2)).cast("int")
    mine = F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.col("chunks"))
    pairs = (keyed.join(hot, "key").withColumn("chunks", chunks).withColumn("mine", mine)
             .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
             .select("fp", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key")))
    return compared(cold, "key").unionByName(compared(pairs, "key")).distinct()


def with_fingerprint(docs: DataFrame, text_col: str = "text", words_each: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` plus ``fp``, the fingerprint as a signed 64-bit integer."""
    return append_columns(docs, text_col, "fp long",
                          lambda column: {"fp": pa.array(fingerprints(column, words_each).view(np.int64))})


def rooted_fingerprints(rows: DataFrame, order: Column, radius: int = RADIUS) -> DataFrame:
    """(fp, least, root) of the distinct fingerprints of ``rows``: least ``order`` and root of the component."""
    fps = rows.groupBy("fp").agg(F.min(order).alias("least")).checkpoint()
    roots = connected_components(fingerprint_links(fps.select("fp"), radius))
    return (fps.join(roots, fps.fp == roots.node, "left")
            .select("fp", "least", F.coalesce("root", "fp").alias("root")).checkpoint())


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       words_each: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) of every row: the smallest id reachable over links."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text",
                            words_each).select("id", "fp").checkpoint()
    rooted = rooted_fingerprints(rows, F.col("id"), radius)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = simhash_components(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every component one row stays, the one with the smallest doc_id.

    Rows without an id come last, equal ids go by the hash of the text; a component is
    told by its root fingerprint, so ids that are null or repeated join no components.
    Only partial minima are shuffled: many rows of one id or text meet in no task.
    """
    ensure_checkpoint_dir(spark)
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    rows = with_fingerprint(hashed).select("doc_id", "hash", "fp")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")
    first = rooted_fingerprints(rows, order).groupBy("root").agg(F.min("least").alias("least"))
    # as a struct the key equals itself with a null id too
    chosen = first.select(F.struct("least.doc_id", "least.hash").alias("_key"))
    key = F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("_key")
    single = docs.groupBy(key).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return single.join(chosen, "_key", "left_semi").select("row.*")
