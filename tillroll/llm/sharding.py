"""Proportional stratified interleaving into shards, with DataFrame functions only.

Within each source the rows are shuffled by a seeded hash and ranked; the fractional
rank (2 * rank - 1) / (2 * rows of the source) spreads every source evenly over 0..1.
All rows are put in order of it and cut into shards whose row counts differ by one at
most, so every shard holds each source in its share of the whole (law ``rows``).

No step holds a whole source or the whole table in one task: rows are dealt into many
buckets of the shuffle hash (then of the fractional rank), ranked inside their bucket,
and the rows of earlier buckets come from a table of counts, one row a bucket.

Edge cases: a null source is a source of its own, a null text counts as empty; rows
that agree in id, text and source are interchangeable and get neighbouring ranks; ties of the fractional
rank go by hash, then id; fewer rows than shards leave shards empty; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARDS = 24
SEED = 42
OVERHEAD = 8
# Buckets of one pass: about this many rows each.
BUCKET_ROWS = 2_000


def shuffle_key(id_col: str, seed: int = SEED) -> Column:
    """32 hex digits that shuffle the rows: the MD5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def _with_rank(rows: DataFrame, group: list[str], bucket: str, order: list, out: str) -> DataFrame:
    """``out``: position from 1 inside ``group`` by (bucket, order); buckets are in order."""
    counts = rows.groupBy(*group, bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*group, bucket).orderBy(*order)
    ranked = rows.withColumn("_nth", F.row_number().over(inside))
    return (ranked.join(offsets, [*group, bucket])
            .withColumn(out, F.col("_nth") + F.col("_before")).drop("_nth", "_before"))


def stratified_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                      shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(id, source, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("stratum"),
        F.col(source_col).alias("source"), shuffle_key(id_col, seed).alias("h"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"))
    per_source = rows.groupBy("stratum").agg(F.count("*").alias("_rows"))
    total = per_source.agg(F.sum("_rows")).first()[0] or 0
    buckets = min(1 << 16, max(1, -(-total // BUCKET_ROWS)))
    tie = [F.asc_nulls_first("id"), F.asc("text_crc32"), F.asc("size")]

    by_hash = rows.withColumn("_bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)))
    ranked = _with_rank(by_hash, ["stratum"], "_bucket", [F.asc("h"), *tie], "rank").drop("_bucket")
    spread = (ranked.join(per_source, "stratum")
              .withColumn("fraction", (2 * F.col("rank") - 1) / (2 * F.col("_rows")))
              .withColumn("_bucket", F.floor(F.col("fraction") * buckets)).withColumn("_all", F.lit(0)))
    placed = _with_rank(spread, ["_all"], "_bucket", [F.asc("fraction"), F.asc("h"), *tie, F.asc("stratum")], "place")
    at = F.col("place") - 1
    out = placed.withColumn("shard", F.expr(f"(place - 1) * {shards}L div {max(total, 1)}L").cast("int"))
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")      # places before the shard
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "text_crc32",
                      F.lit("rows").alias("law"), "shard", (at - first).cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", **kw) -> DataFrame:
    """Writes every row of ``docs`` into the folder of its shard below ``path`` and returns the placement.

    ``docs`` must have unique, non-null ids.
    """
    placed = stratified_shards(docs, id_col, **kw)
    place = placed.select(F.col(id_col).alias("_id"), "shard", "slot")
    rows = docs.drop("shard", "slot").join(place, F.col(id_col) == F.col("_id")).drop("_id")
    rows.repartition("shard", F.floor(F.col("slot") / BUCKET_ROWS)).sortWithinPartitions("shard", "slot") \
        .write.partitionBy("shard").parquet(path)
    return placed


def op4_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = stratified_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


# The CRC-32 runs bit-free over a table of 256 values derived from the polynomial.
OP4_SQL = """
WITH RECURSIVE crc_table(i, v, k) AS (
    SELECT i, i::UINTEGER, 0 FROM range(256) t(i)
  UNION ALL
    SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UINTEGER) ELSE v >> 1 END, k + 1 FROM crc_table WHERE k < 8
),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc_table WHERE k = 8),
sized AS (
    SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size,
           md5('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
           xor(list_reduce(
               list_prepend(4294967295::UINTEGER, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                                                                 lambda x: ('0x' || x)::UINTEGER)),
               lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::UINTEGER) AS crc
    FROM documents, tab
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id, crc, size) AS rank,
           count(*) OVER (PARTITION BY source) AS rows_of_source, count(*) OVER () AS total FROM sized
),
placed AS (
    SELECT *, row_number() OVER (ORDER BY (2 * rank - 1) / (2 * rows_of_source), h, doc_id, crc, size, source) - 1 AS place
    FROM ranked
)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, (place * 24 // total)::INTEGER AS shard,
       (row_number() OVER (PARTITION BY place * 24 // total ORDER BY place) - 1)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard
FROM placed
"""
