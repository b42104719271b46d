"""Ranks and running counts that no single hot group can overload.

A plain window sends a whole group to one task. Here a group is first cut into
pieces of bounded size; each piece is ranked alone, and the pieces' sizes (one
small row each) are summed up to give every piece its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlframe.session import cut_lineage


def _with_offsets(df: DataFrame, group: list[str], piece: str, out: str, order: list[Column]) -> DataFrame:
    inside = W.partitionBy(*group, piece).orderBy(*order)
    ranked = df.withColumn("_pos", F.row_number().over(inside))
    sizes = df.groupBy(*group, piece).agg(F.count(F.lit(1)).alias("_n"))
    before = (
        W.partitionBy(*group).orderBy(piece).rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col(piece).alias("_p"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    same = F.col(piece) == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return ranked.join(offsets, same).select(
        *df.columns, (F.col("_before") + F.col("_pos")).alias(out)
    )


def salted_rank(
    df: DataFrame, group: list[str], key: str, out: str = "rank", digits: int = 3
) -> DataFrame:
    """1-based rank in each group, ordered by (hash prefix of `key`, `key`).

    The order is arbitrary but fixed; `16 ** digits` pieces share a group, so a
    piece's size grows with the group: give more digits for larger ones.
    """
    piece = df.withColumn("_piece", F.substring(F.md5(F.col(key).cast("string")), 1, digits))
    return _with_offsets(piece, group, "_piece", out, [F.col(key)]).drop("_piece")


def running_index(
    df: DataFrame, group: list[str], seq: str, out: str = "rank", width: int = 100_000
) -> DataFrame:
    """1-based position in each group along a unique integer `seq`.

    Rows are range-partitioned by group and number into pieces of about `width`
    rows, however far apart the numbers lie. The pieces are written once: their
    bounds come from a sample, so ranks and sizes must see the same ones.
    """
    pieces = max(1, -(-df.count() // width))
    ranged = df.repartitionByRange(pieces, *[F.col(g) for g in group], F.col(seq))
    piece = cut_lineage(ranged.withColumn("_piece", F.spark_partition_id()))
    return _with_offsets(piece, group, "_piece", out, [F.col(seq)]).drop("_piece")
