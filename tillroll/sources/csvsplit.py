"""CSV files whose quoted fields may span lines, read by many tasks a file.

A file is scanned as plain lines in blocks.  Whether a line break stands inside quotes
depends on how many quotes came before it, so:

1. every block is counted by itself: its quotes, and how many records begin in it if it
   begins outside of quotes, and if it begins inside;
2. one row a block, put in order, gives each block its true state and the number of the
   first record that begins in it;
3. every block then cuts its lines into records.  A record that runs into later blocks is
   put together from its pieces (two a block at most), and only blocks with such pieces
   are read for them.

Records are parsed by ``from_csv`` with the caller's options.  Each has a number, dense
from 0 within its file and in the order of the file, known without any shuffle.

Rules (those of a COPY): a doubled quote stands for a quote; a line break inside quotes
is kept as it is (LF or CRLF), one outside ends the record; empty lines are skipped and
the first record is the header.  A quote inside an unquoted field, text behind a closing
quote and an unclosed quote fail the load.  Empty files have no records.  Compressed
files are one block each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.session import ensure_checkpoint_dir

QUOTE, COMMA, RETURN = 34, 44, 13
# One row a block goes to every task: 24 bytes each, so this is under 50 MB.
MOST_BLOCKS = 2_000_000


class CsvError(ValueError):
    """The file is no CSV by the rules of this module."""


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with the file's hash and the block's offset; CR stays at the line's end."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("value").cast("binary").alias("line"), F.xxhash64("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_block_start").alias("start"))


def file_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, path, bytes) of every file; contents are not read."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("path"),
                        F.col("length").alias("bytes"))


class _Block:
    """Lines of one batch that stand in one block: quotes before each line, and the line ends."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        self.offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        size = self.offsets[-1] - self.offsets[0]
        data = column.buffers()[2]
        self.bytes = (np.frombuffer(data, np.uint8)[self.offsets[0]:self.offsets[-1]] if size else np.zeros(0, np.uint8))
        self.offsets = self.offsets - self.offsets[0]
        self.quotes = np.flatnonzero(self.bytes == QUOTE)
        self.before = np.searchsorted(self.quotes, self.offsets)       # quotes before each line; last: all
        ends, starts = self.offsets[1:], self.offsets[:-1]
        bare = ends - starts == 1
        self.empty = ends == starts
        if bare.any():
            at = np.flatnonzero(bare)
            self.empty[at] = self.bytes[starts[at]] == RETURN

    def inside(self, parity: int) -> np.ndarray:
        """Whether each line begins inside quotes, if the first one's state is ``parity``."""
        return ((self.before[:-1] + parity) & 1).astype(bool)

    def check(self, parity: int) -> None:
        """Opening quotes begin a field, closing ones end it."""
        if not len(self.quotes):
            return
        opening = ((np.arange(len(self.quotes)) + parity) & 1) == 0
        around = np.concatenate([[COMMA], self.bytes, [COMMA]])         # shifted by one
        first = np.zeros(len(self.bytes) + 1, bool)
        first[self.offsets] = True                                      # a line's first byte, or the end of one
        prev, after = around[self.quotes], around[self.quotes + 2]
        begins = first[self.quotes] | (prev == COMMA) | (prev == QUOTE)
        returned = (after == RETURN) & first[np.minimum(self.quotes + 2, len(self.bytes))]
        ends = first[self.quotes + 1] | (after == COMMA) | (after == QUOTE) | returned
        if not (begins[opening].all() and ends[~opening].all()):
            raise CsvError("a quote stands inside a field that does not begin with one, or text follows a closing quote")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Consecutive rows of one block: (file, start, rows)."""
    if batch.num_rows == 0:
        return
    file, start = batch.column("file").to_numpy(), batch.column("start").to_numpy()
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield int(file[a]), int(start[a]), batch.slice(a, b - a)


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(at, n):
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*at, *n)],
                                          names=["file", "start", "quotes", "closed", "open"])
    at, n = None, [0, 0, 0]
    for batch in batches:
        for file, start, rows in _runs(batch):
            if at != (file, start):
                if at is not None:
                    yield row(at, n)
                at, n = (file, start), [0, 0, 0]
            lines = _Block(rows.column("line"))
            inside = lines.inside(n[0])
            n[1] += int((~inside & ~lines.empty).sum())
            n[2] += int((inside & ~lines.empty).sum())
            n[0] += len(lines.quotes)
    if at is not None:
        yield row(at, n)


def block_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, start, open, ends_open, first, records) of every block, checkpointed.

    ``open``: it begins inside quotes; ``first``: number of the first record that begins
    in it, the header being -1; ``records``: how many do, without the header.
    """
    ensure_checkpoint_dir(spark)
    # a block lies in one task, so the sums only add what a task has counted
    counted = _lines(spark, path).mapInArrow(_count_blocks, "file long, start long, quotes long, closed long, open long")
    in_file = Window.partitionBy("file").orderBy("start")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    state = counted.withColumn("open", F.when(F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1, F.struct("open"))).select(
        "file", "start", "quotes", F.col("open").isNotNull().alias("is_open"), F.coalesce(F.col("open.open"), "closed").alias("n"))
    placed = state.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - 1)
    return placed.select(
        "file", "start", F.col("is_open").alias("open"), ((F.col("quotes") % 2 == 1) != F.col("is_open")).alias("ends_open"), "first",
        (F.col("n") - F.when((F.col("first") == -1) & (F.col("n") > 0), 1).otherwise(0)).alias("records")).checkpoint()


def _records(pieces: bool):
    """The whole records of every block, or the pieces of those that run over its ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, quotes, number, header, cut, held = None, 0, 0, 0, False, []

        def out(file, start, rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([file] * len(rows), pa.int64()), pa.array([start] * len(rows), pa.int64()),
                 pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                names=["file", "start", "number", "record"])

        def ended():
            """The record still held at a block's end: whole, if the block ends outside of quotes."""
            if held and number > header and pieces == (cut or quotes % 2 == 1):
                return [(number, b"\n".join(held))]
            return []

        for batch in batches:
            for file, start, rows in _runs(batch):
                if at != (file, start):
                    if at is not None and (last := ended()):
                        yield out(*at, last)
                    at, held = (file, start), []
                    quotes = int(rows.column("is_open")[0].as_py())
                    number, cut = int(rows.column("first")[0].as_py()) - 1, bool(quotes)
                    header = int(rows.column("base")[0].as_py()) - 1
                lines = _Block(rows.column("line"))
                lines.check(quotes & 1)
                inside = lines.inside(quotes & 1)
                begins = np.flatnonzero(~inside & ~lines.empty)
                line = rows.column("line")
                found = []
                # lines up to the first beginning go on with the record held; empty ones outside are none
                edges = [0, *begins.tolist(), len(inside)]
                for k in range(len(edges) - 1):
                    a, b = edges[k], edges[k + 1]
                    if k:
                        if held and number > header and pieces == cut:
                            found.append((number, b"\n".join(held)))
                        number, cut, held = number + 1, False, []
                    if b - a == 1:
                        if k or inside[a]:
                            held.append(line[a].as_py())
                    elif b > a:
                        keep = inside[a:b] | ((np.arange(b - a) == 0) & bool(k))
                        held.extend(line[a + int(i)].as_py() for i in np.flatnonzero(keep))
                quotes += len(lines.quotes)
                if found:
                    yield out(file, start, found)
        if at is not None and (last := ended()):
            yield out(*at, last)
    return run


def csv_records(spark: SparkSession, path: str | list[str], blocks: DataFrame | None = None) -> DataFrame:
    """(file, number, record): every record of the files, without the headers, as text.

    A column ``base`` of ``blocks`` is added to its file's numbers.
    """
    blocks = block_table(spark, path) if blocks is None else blocks
    n = blocks.count()
    if n > MOST_BLOCKS:
        raise CsvError(f"{n} blocks: raise spark.sql.files.maxPartitionBytes")
    unclosed = blocks.groupBy("file").agg(F.max_by("ends_open", "start").alias("open")).where("open")
    if not unclosed.isEmpty():
        raise CsvError("a quote is never closed")
    base = F.col("base") if "base" in blocks.columns else F.lit(0)
    table = blocks.select("file", "start", F.col("open").alias("is_open"), (F.col("first") + base).alias("first"),
                          base.cast("long").alias("base"), "ends_open")
    lines = _lines(spark, path)
    columns = "file long, start long, number long, record binary"

    def cut(which: DataFrame, pieces: bool, how: str) -> DataFrame:
        # the block table is never the larger side's size: one row a block
        known = lines.join(F.broadcast(which.drop("ends_open")), ["file", "start"], how)
        known = known.select("line", "file", "start", F.coalesce("is_open", F.raise_error(F.lit(
            "the files were split differently while records were counted")).cast("boolean")).alias("is_open"), "first", "base")
        return known.mapInArrow(_records(pieces), columns)

    whole = cut(table, False, "left").select("file", "number", "record")
    crossing = table.where("is_open OR ends_open")
    if not crossing.isEmpty():
        parts = cut(crossing, True, "inner").groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("start", "record"))).alias("p"))
        joined = parts.select("file", "number", F.array_join(F.transform("p", lambda p: p["record"].cast("string")), "\n")
                              .cast("binary").alias("record"))
        whole = whole.unionByName(joined)
    text = F.col("record").cast("string")
    return whole.select("file", "number", F.when(text.endswith("\r"), F.substring(text, F.lit(1), F.length(text) - 1))
                                             .otherwise(text).alias("record"))


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, options: dict[str, str],
             blocks: DataFrame | None = None) -> DataFrame:
    """The typed columns of ``schema`` plus ``_file`` and ``_number`` of every record."""
    parsed = {k: v for k, v in options.items() if k not in ("header", "multiLine", "encoding")}
    rows = csv_records(spark, path, blocks)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    row = rows.select(F.col("file").alias("_file"), F.col("number").alias("_number"), F.from_csv("record", ddl, parsed).alias("r"))
    return row.select("_file", "_number", *[F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields])
