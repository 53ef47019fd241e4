"""The ledger of generated keys: which numbers the records of each landed file have.

One row a file: (file, path, bytes, records, first_key).  A file that the ledger knows
keeps its numbers whoever loads it - a batch load, a stream, a replay after a failure, a
later session - and new files go on after the largest number, in the order of their
paths.  Keys are dense and, within a file, in the order of its records.  Data rows are
never sorted or numbered by a window: a record's key is its file's first key plus its
place in the file (``csvsplit``), and only one row a file is put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tillroll.sources.csvsplit import block_table, file_list, read_csv
from tillroll.session import ensure_checkpoint_dir

COLUMNS = "file long, path string, bytes long, records long, first_key long"


class KeyLedgerError(ValueError):
    """A landed file has changed since its keys were given out."""


def read_ledger(spark: SparkSession, ledger: str | None) -> DataFrame:
    """The stored ledger; empty where there is none yet."""
    if ledger:
        try:
            return spark.read.schema(COLUMNS).parquet(ledger)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], COLUMNS)


def assign_keys(files: DataFrame, known: DataFrame, after: int = 0) -> DataFrame:
    """``files`` (file, path, bytes, records) plus first_key and ``fresh``: whether the ledger lacks it.

    New files go on after the ledger's largest key, and after ``after``.  A known file of another size or number of records raises when it is read.
    """
    old = known.select("file", F.col("bytes").alias("_bytes"), F.col("records").alias("_records"), "first_key")
    top = known.agg(F.coalesce(F.max(F.col("first_key") + F.col("records")), F.lit(1))).first()[0]
    top = max(top, after + 1)
    both = files.join(old, "file", "left")
    same = (F.col("bytes") == F.col("_bytes")) & (F.col("records") == F.col("_records"))
    kept = both.where("first_key IS NOT NULL").select(*files.columns, F.when(same, F.col("first_key")).otherwise(
        F.raise_error(F.concat(F.col("path"), F.lit(" has changed since its keys were given out")))
        .cast("long")).alias("first_key"), F.lit(False).alias("fresh"))
    # one row a file, not a record
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    new = both.where("first_key IS NULL").select(
        *files.columns, (F.coalesce(F.sum("records").over(before), F.lit(0)) + top).alias("first_key"), F.lit(True).alias("fresh"))
    return kept.unionByName(new)


def keyed_csv(spark: SparkSession, path: str | list[str], schema, options: dict[str, str], name: str,
              ledger: str | None = None, after: int = 0) -> DataFrame:
    """The records of the files with their key ``name`` first; see ``assign_keys`` for ``after``.

    With ``ledger`` the numbers of new files are stored there before the frame is
    returned, so whatever is interrupted later finds the same numbers again.
    """
    ensure_checkpoint_dir(spark)
    blocks = block_table(spark, path)
    per_file = blocks.groupBy("file").agg(F.sum("records").alias("records"))
    files = (file_list(spark, path).join(per_file, "file", "left")
             .select("file", "path", "bytes", F.coalesce("records", F.lit(0)).cast("long").alias("records")))
    keys = assign_keys(files, read_ledger(spark, ledger), after).checkpoint()
    if ledger and not keys.where("fresh").isEmpty():
        keys.where("fresh").drop("fresh").coalesce(1).write.mode("append").parquet(ledger)
    based = blocks.join(keys.select("file", F.col("first_key").alias("base")), "file")      # one row a block
    rows = read_csv(spark, path, schema, options, based)
    return rows.select(F.col("_number").alias(name), *[f"`{c}`" for c in schema.names])
