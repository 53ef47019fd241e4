"""Helpers around Arrow batches: byte-bounded slices, raw text bytes, appended columns."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Text bytes handled at once inside a task; a longer text forms a slice of its own.
SLICE_BYTES = 1 << 20


def bounded_slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` whose ``column`` holds about ``max_bytes`` bytes at most."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (nulls empty) and the n + 1 offsets between them."""
    arr = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    if len(arr) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def append_columns(df: DataFrame, text_col: str, ddl: str,
                   fn: Callable[[pa.Array], dict[str, pa.Array]], slice_bytes: int = SLICE_BYTES,
                   owner: str = "") -> DataFrame:
    """``df`` plus the columns of ``ddl`` that ``fn`` derives from ``text_col``.

    Works slice by slice within each task, without a shuffle.  A column of ``df``
    whose name is in ``ddl`` is replaced by the new one.  ``owner`` names the
    operator whose worker cache stays.
    """
    out = T.StructType.fromDDL(ddl)
    new = out.names
    kept = [c for c in df.columns if c not in new or c == text_col]
    base = df.select(*[df[f"`{c}`"] for c in kept])
    schema = T.StructType([f for f in base.schema.fields if f.name not in new] + out.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(owner)
        for batch in batches:
            for part in bounded_slices(batch, text_col, slice_bytes):
                cols = fn(part.column(text_col))
                passed = [n for n in part.schema.names if n not in new]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in passed] + [cols[n] for n in new],
                                                 names=passed + new)
        pa.default_memory_pool().release_unused()

    return base.mapInArrow(run, schema)


def longs(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64), pa.int64())


def worker_cache(owner: str) -> dict:
    """A dictionary that lives as long as the Python process, across the tasks of a worker.

    A worker keeps the cache of one operator at a time: what others left is dropped,
    so the stages of a pipeline do not add up in memory.
    """
    kept = sys.__dict__.setdefault("_tillroll_worker_cache", {})
    for other in [k for k in kept if k != owner]:
        del kept[other]
    return kept.setdefault(owner, {})
