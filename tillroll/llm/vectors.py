"""Helpers of the vector operators: usable rows, matrices from Arrow lists, bounded grids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable_rows(df: DataFrame, id_col: str, vec_col: str, *more: str) -> DataFrame:
    """(id, vec array<double>, dim, more...) of the rows with an id and a non-empty, wholly finite vector."""
    vec = df[f"`{vec_col}`"].cast("array<double>")
    finite = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return (df.where(F.coalesce(finite, F.lit(False)) & (F.size(vec) > 0) & df[f"`{id_col}`"].isNotNull())
            .select(df[f"`{id_col}`"].cast("long").alias("id"), vec.alias("vec"), F.size(vec).alias("dim"),
                    *[df[f"`{c}`"].alias(c) for c in more]))


def single_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with every id once: of rows that repeat an id the least one (by all columns) stays.

    Only ids are shuffled to find the repeated ones; rows with an id of their own stay where they are.
    """
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id").checkpoint()
    if twice.isEmpty():
        return rows
    names = rows.columns
    least = rows.join(twice, "id", "left_semi").groupBy("id").agg(
        F.min(F.struct(*[c for c in names if c != "id"])).alias("row"))
    return rows.join(twice, "id", "left_anti").select(*names).unionByName(least.select("id", "row.*").select(*names))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The lists of one length of ``column`` as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sample_by_hash(rows: DataFrame, n: int, *columns: str) -> pa.Table:
    """At most ``n`` rows, those of the smallest hash of the id: the same rows at every run and layout."""
    return rows.orderBy(F.xxhash64("id"), "id").limit(n).select(*columns).toArrow()


def parts_of(rows: DataFrame, key: list[str], rows_each: int) -> DataFrame:
    """``rows`` plus ``part``: groups of ``key`` are split by the id's hash into parts of about ``rows_each`` rows."""
    counts = rows.groupBy(*key).agg(F.ceil(F.count("*") / rows_each).cast("int").alias("_parts"))
    return (rows.join(counts, key).withColumn("part", F.pmod(F.xxhash64("id", F.lit(11)), F.col("_parts")).cast("int"))
            .drop("_parts"))


def groups_for(count: int, each: int) -> int:
    return max(1, -(-count // each))


def group_of(groups: int):
    """The query group of an id, 0 .. groups - 1."""
    return F.pmod(F.xxhash64("id", F.lit(13)), F.lit(groups)).cast("int")


def all_groups(groups: int):
    """Explodes a row into one copy for each query group."""
    return F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))


def best(found: DataFrame, by: list[str], k: int, score: str = "score", tie: str = "other") -> DataFrame:
    """The ``k`` rows of the highest score of each group, with ``rank``; ties go to the smaller ``tie``."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_copies(values: np.ndarray, copies: int) -> np.ndarray:
    """Positions of the first ``copies`` occurrences of every distinct row of ``values``, in order.

    Equal vectors have equal scores, so of many only the ones that come first by the
    tie rule can be among the ``copies`` best; the rest need no score.
    """
    flat = np.ascontiguousarray(values).view(np.dtype((np.void, values.shape[1] * values.itemsize))).ravel()
    _, group = np.unique(flat, return_inverse=True)
    order = np.argsort(group, kind="stable")
    ordered = group[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    nth = np.arange(len(ordered)) - np.repeat(starts, np.diff(np.r_[starts, len(ordered)]))
    return np.sort(order[nth < copies])
