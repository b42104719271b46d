"""Connected components of an edge table, without any node's neighbours in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.session import cut_lineage


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))
    ).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step; the smallest neighbour per node is a partial aggregate, then a join.

    Large: each node hands its larger neighbours to its smallest neighbour.
    Small: each node hands itself and its smaller neighbours to the smallest one.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    turned = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    seen = both.union(turned) if large else turned.where("v < u")
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = seen.join(least, "u")
    if large:
        made = joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        rest = joined.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        made = rest.union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return made.where("a < b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of the edges (a, b) of bigints; root is the smallest node.

    Alternating star steps until nothing changes: a logarithmic number of
    rounds in practice, each cut off by a checkpoint. Null ends, loops and
    repeated edges are ignored; an empty table gives an empty result.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = cut_lineage(e)
    before = _signature(e)
    for _ in range(rounds):
        if before[0] == 0:
            break
        e = cut_lineage(_star(_star(e, True), False))
        now = _signature(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots)
