"""Connected components of an edge table, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.session import ensure_checkpoint_dir


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): ``root`` is the component's smallest node.

    Alternates large-star and small-star steps until the edge set no longer changes;
    the number of rounds grows with the logarithm of the longest chain.  Every round is
    checkpointed in the shared folder, so lineage stays short and a lost executor costs
    no earlier round.  Self loops and repeated edges are harmless; null ends are dropped.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    now = _oriented(edges.select("a", "b")).checkpoint()
    print_of = _fingerprint(now)
    while True:
        now = _small_star(_large_star(now)).checkpoint()
        last, print_of = print_of, _fingerprint(now)
        if print_of == last:
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"),
                           F.expr("sum(cast(xxhash64(b, a) as decimal(38,0)))")).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (both.where("b > a").join(least, "a").where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = _oriented(edges)
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
