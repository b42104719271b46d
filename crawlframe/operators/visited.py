"""The visited set of a crawl as a stored table, so that no level moves what earlier ones found.

A node has a slot, a number drawn from its hash. The set is a bucketed table by slot,
in folders of slot ranges, and each level appends to it. Beside it stands a Bloom
filter of the same layout: one 64-bit word per slot, in which a node sets four bits.

A level's candidates are dealt out by slot once. The words they meet tell most new ones
at once; only candidates whose bits are all set are looked up, and only in the ranges they
fall into. Both tables are read in their buckets, so neither is shuffled again. All of it is
built-in functions; only the numbers of the ranges to read reach the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.session import cut_lineage, scratch

#: Nodes a slot is laid out for: with four bits each, one in sixty new nodes is looked up in vain.
PER_SLOT = 6
#: Slot ranges; each is a folder.
RANGES = 16


class Visited:
    """Nodes found so far, with what is told of them (column `node` and any others)."""

    def __init__(self, spark, expected: int, buckets: int | None = None):
        """`expected` nodes set the number of slots; more only cost more lookups."""
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.slots = max(RANGES, expected // PER_SLOT + 1)
        self.path = scratch(spark, "visited")
        self.name = f"crawlframe_visited_{uuid.uuid4().hex}"
        self.empty = True

    # --- the layout ---------------------------------------------------------------

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64("node"), F.lit(self.slots))

    def _range(self) -> Column:
        return F.floor(F.col("slot") * RANGES / self.slots).cast("int")

    @staticmethod
    def _bits() -> Column:
        h = F.xxhash64(F.lit("bits"), "node")
        bits = F.lit(0).cast("bigint")
        for k in range(4):
            at = F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int")
            bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
        return bits

    def dealt(self, nodes: DataFrame) -> DataFrame:
        """Rows with their slot, all of a slot in one partition; later steps by slot need no exchange."""
        return nodes.withColumn("slot", self._slot()).repartition(self.buckets, "slot")

    def _store(self, df: DataFrame, table: str) -> None:
        (
            df.withColumn("part", self._range()).write.mode("append").format("parquet")
            .option("path", f"{self.path}/{table}").option("compression", "zstd")
            .partitionBy("part").bucketBy(self.buckets, "slot").sortBy("slot").saveAsTable(f"{self.name}_{table}")
        )

    def _read(self, table: str, parts: list[int] | None = None) -> DataFrame:
        df = self.spark.table(f"{self.name}_{table}")
        return df if parts is None else df.filter(F.col("part").isin(parts))

    # --- its use ----------------------------------------------------------------------

    def add(self, level: DataFrame) -> None:
        """Append rows whose nodes are new and distinct; `level` must be stored, for it is read twice."""
        self._store(self.dealt(level), "nodes")
        bits = level.select(self._slot().alias("slot"), self._bits().alias("bits"))
        self._store(bits.groupBy("slot").agg(F.bit_or("bits").alias("word")).repartition(self.buckets, "slot"), "words")
        self.empty = False

    def flagged(self, candidates: DataFrame) -> DataFrame:
        """Dealt candidates with `maybe`: whether the filter has all bits of the node."""
        words = self._read("words").groupBy("slot").agg(F.bit_or("word").alias("word"))
        own = self._bits()
        return candidates.join(words, "slot", "left").select(
            *candidates.columns, F.coalesce(own.bitwiseAND(F.col("word")) == own, F.lit(False)).alias("maybe"))

    def lookup(self, maybe: DataFrame, parts: list[int]) -> DataFrame:
        """Rows of `maybe` whose node is not in the set, reading only the given ranges."""
        known = self._read("nodes", parts).select(F.col("slot").alias("_slot"), F.col("node").alias("_node"))
        # Equality in two halves: joined by slot alone, both sides keep their layout.
        same = (F.col("slot") == F.col("_slot")) & (F.col("node") >= F.col("_node")) & (F.col("node") <= F.col("_node"))
        return maybe.join(known, same, "left_anti")

    def unseen(self, candidates: DataFrame) -> DataFrame:
        """Candidates (distinct nodes, dealt) that the set does not hold; the result is stored."""
        if self.empty:
            return cut_lineage(candidates)
        flagged = cut_lineage(self.flagged(candidates))
        maybe = flagged.filter("maybe").drop("maybe")
        parts = sorted(r["part"] for r in maybe.select(self._range().alias("part")).distinct().collect())
        fresh = flagged.filter("not maybe").drop("maybe")
        if not parts:
            return fresh
        # A checkpoint keeps no layout, so the few rows to look up are dealt again.
        again = maybe.repartition(self.buckets, "slot")
        return fresh.unionByName(cut_lineage(self.lookup(again, parts)))

    def nodes(self) -> DataFrame:
        """The set as plain files, which outlive the catalog's entries."""
        return self.spark.read.parquet(f"{self.path}/nodes").drop("slot", "part")

    def close(self) -> None:
        """Forget the tables' names; their files stay where they are."""
        for table in ("nodes", "words"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")
