"""Land CSV files as they arrive in a directory, with the batch landing's rules.

The source project reloads everything with one script; this is the same load
made incremental.  The stream itself only carries the names of new files (their
contents are not read by it); a ``foreachBatch`` sink lands the files of a micro-batch
with ``land_csv`` - so one large file is read by many tasks here too - into a directory
of their own, ``<table>/_batch=<id>``, with overwrite.  A batch replayed after a failure
therefore replaces its own output instead of duplicating it, and the stream's progress
log (beside the table, in ``_stream/<table>`` of the layer, unless given) records which
files were taken, also for a later session.

Reviews get their ``review_sk`` from the layer's key ledger: dense, by file path within a
batch and by place in the file, the same numbers after a replay, in a later session, and
in a batch load that keeps the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from tillroll.model import TABLES
from tillroll.operators.ranking import number_in_place
from tillroll.session import ensure_checkpoint_dir
from tillroll.sources.keyledger import read_ledger
from tillroll.sources.landing import key_ledger, land_csv

BATCH_COL = "_batch"
# Fixed value: the columns of Spark's binaryFile source.
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _previous_max(spark: SparkSession, out: str, batch_id: int, key: str) -> int:
    """Largest key landed by earlier batches; 0 if nothing has landed.

    Keys grow with the batch number, so only the newest earlier batch that has rows
    is read (partition pruning on the batch directory).
    """
    try:
        landed = spark.read.parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    earlier = landed.where(F.col(BATCH_COL) < batch_id)
    while (newest := earlier.agg(F.max(BATCH_COL)).first()[0]) is not None:
        top = earlier.where(F.col(BATCH_COL) == newest).agg(F.max(key)).first()[0]
        if top is not None:
            return top
        earlier = earlier.where(F.col(BATCH_COL) < newest)
    return 0


def _writer(table: str, out: str):
    """Sink of streams whose rows are parsed already (not files): reviews are numbered in place, after earlier batches."""
    def write(batch: DataFrame, batch_id: int) -> None:
        df = batch
        if table == "order_reviews":
            offset = _previous_max(batch.sparkSession, out, batch_id, "review_sk")
            df = number_in_place(batch, "review_sk").withColumn("review_sk", F.col("review_sk") + F.lit(offset))
            df = df.select("review_sk", *batch.columns)
        df.write.mode("overwrite").parquet(f"{out}/{BATCH_COL}={batch_id}")
    return write


def _file_writer(table: str, raw_dir: str):
    """Sink of a stream of file names."""
    out = f"{raw_dir}/{table}"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        paths = sorted(r.path for r in batch.collect())          # names of the batch's files
        if not paths:
            return
        ledger, after = None, 0
        if table == "order_reviews":
            ledger = key_ledger(raw_dir, table)
            if read_ledger(spark, ledger).isEmpty():             # a layer from before there were ledgers
                after = _previous_max(spark, out, batch_id, "review_sk")
        land_csv(spark, paths, table, key_ledger=ledger, keys_after=after).write.mode("overwrite").parquet(f"{out}/{BATCH_COL}={batch_id}")
    return write


def land_csv_stream(spark: SparkSession, table: str, in_dir: str, raw_dir: str,
                    checkpoint: str | None = None, available_now: bool = True,
                    max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start landing ``table`` from CSV files appearing in ``in_dir`` into ``raw_dir/table``.

    ``available_now`` processes everything present and stops (scheduled runs);
    otherwise the query keeps polling the directory.
    """
    if table not in TABLES:
        raise KeyError(table)
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    src = reader.load(in_dir).select("path")
    raw_dir = raw_dir.rstrip("/")
    ensure_checkpoint_dir(spark)
    ckpt = checkpoint or f"{raw_dir}/_stream/{table}"
    w = src.writeStream.foreachBatch(_file_writer(table, raw_dir)).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
