"""File names that stay: a stored registry of what was given to whom.

A name is a base and a number: `x_3` is number 3 of `x`, a name without such an ending
is number 0 of itself. Per base the registry keeps the taken numbers as ranges, so a stem with a
million pages is a row or two, and the next free number is found without ranking
older names again. Each batch appends its names and ranges under folders of hash buckets
and is named by a manifest; a batch reads only the buckets that its own stems fall into. A batch that
is run again gets the names it got before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.operators.ranking import salted_rank
from crawlframe.session import cut_lineage
from crawlframe.sources.commits import commit, committed

GIVEN = "stem string, url string, name string, bucket int"
TAKEN = "base string, lo bigint, hi bigint, bucket int"
#: Numbers that are turned into ranges together.
SPAN = 4_096
_NUMBERED = r"^(.+)_([1-9]\d{0,8})$"


def base_of(name: Column) -> Column:
    return F.when(name.rlike(_NUMBERED), F.regexp_extract(name, _NUMBERED, 1)).otherwise(name)


def number_of(name: Column) -> Column:
    return F.when(name.rlike(_NUMBERED), F.regexp_extract(name, _NUMBERED, 2).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def free_number(ranges: Column, nth: Column) -> Column:
    """The `nth` number from 1 up that lies in none of the ascending, disjoint ranges."""
    return F.aggregate(ranges, nth, lambda n, r: F.when(n >= r["lo"], n + r["hi"] - r["lo"] + 1).otherwise(n))


def merged(ranges: Column) -> Column:
    """Ranges (any order, overlapping) as ascending, disjoint ones."""
    none = F.expr("cast(array() as array<struct<lo:bigint,hi:bigint>>)")

    def step(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
            last["lo"].alias("lo"), F.greatest(last["hi"], r["hi"]).alias("hi"))))
        return F.when((F.size(acc) > 0) & (r["lo"] <= last["hi"] + 1), joined).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(F.array_sort(ranges), none, step)


class NameRegistry:
    """Names given under `root`; any number of batches, one at a time."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _bucket(self, of: str) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(self.buckets)).cast("int")

    def _read(self, table: str, schema: str, parts: list[int] | None = None) -> DataFrame:
        folders = [f"{self.root}/{run}/{table}" for run in committed(self.spark, self.root).values()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        # One read of all batches; each folder is a root of its own, so its buckets are a column.
        df = self.spark.createDataFrame([], schema)
        for folder in folders:
            df = df.unionByName(self.spark.read.schema(schema).parquet(folder))
        return df if parts is None else df.filter(F.col("bucket").isin(parts))

    def names(self) -> DataFrame:
        """All names given so far: stem, url, name."""
        return self._read("given", GIVEN).select("stem", "url", "name")

    def _parts(self, rows: DataFrame, of: str) -> list[int]:
        return sorted(r["b"] for r in rows.select(self._bucket(of).alias("b")).distinct().collect())

    def _ranges(self, bases: DataFrame) -> DataFrame:
        """Per base of `bases`: its taken numbers from 1 up as ranges, and whether 0 is taken."""
        known = self._read("taken", TAKEN, self._parts(bases, "base")).join(bases, "base", "left_semi")
        return known.groupBy("base").agg(merged(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))

    def assign(self, batch: DataFrame, batch_id: str, url: str = "url", stem: str = "stem") -> DataFrame:
        """(stem, url, name) for each distinct row of the batch; known rows keep the names they have.

        The first new page of a stem gets the stem itself if it is free, the others the first free
        numbers, in a fixed order of their hashes.
        """
        rows = cut_lineage(batch.select(F.col(stem).alias("stem"), F.col(url).alias("url")).distinct())
        given = self._read("given", GIVEN, self._parts(rows, "stem")).select("stem", "url", "name")
        if batch_id not in committed(self.spark, self.root):
            fresh = cut_lineage(rows.join(given, ["stem", "url"], "left_anti"))
            self._give(fresh, batch_id)
            given = self._read("given", GIVEN, self._parts(rows, "stem")).select("stem", "url", "name")
        return rows.join(given, ["stem", "url"])

    def _give(self, fresh: DataFrame, batch_id: str) -> None:
        stems = fresh.select("stem").distinct().select(
            "stem", base_of(F.col("stem")).alias("own_base"), number_of(F.col("stem")).alias("own_number"))
        asked = cut_lineage(stems.select(F.explode(F.array("stem", "own_base")).alias("base")).distinct())
        taken = cut_lineage(self._ranges(asked))
        own = stems.join(taken.select(F.col("base").alias("own_base"), F.col("ranges").alias("own_ranges")), "own_base", "left")
        free = ~F.exists(F.coalesce("own_ranges", F.expr("cast(array() as array<struct<lo:bigint,hi:bigint>>)")),
                         lambda r: (r["lo"] <= F.col("own_number")) & (F.col("own_number") <= r["hi"]))
        stems = cut_lineage(own.select("stem", "own_base", "own_number", free.alias("plain")))
        # Plain names that this batch takes are out of reach for the numbers of their base.
        claimed = stems.filter("plain").select(F.col("own_base").alias("base"), F.array(F.struct(
            F.col("own_number").alias("lo"), F.col("own_number").alias("hi"))).alias("ranges"))
        every = taken.unionByName(claimed).groupBy("base").agg(merged(F.flatten(F.collect_list("ranges"))).alias("ranges"))
        ranked = salted_rank(fresh, ["stem"], "url", "_rank").join(stems.select("stem", "plain"), "stem").join(
            every.select(F.col("base").alias("_base"), "ranges"), F.col("stem") == F.col("_base"), "left")
        above = F.transform(F.filter(F.coalesce("ranges", F.expr("cast(array() as array<struct<lo:bigint,hi:bigint>>)")),
                                     lambda r: r["hi"] >= 1), lambda r: F.struct(F.greatest(r["lo"], F.lit(1)).alias("lo"), r["hi"]))
        nth = F.col("_rank") - F.when(F.col("plain"), 1).otherwise(0)
        number = F.when(F.col("plain") & (F.col("_rank") == 1), F.lit(0).cast("bigint")).otherwise(
            free_number(above, nth.cast("bigint")))
        named = cut_lineage(ranked.select("stem", "url", number.alias("number"))).withColumn("name", F.when(
            F.col("number") == 0, F.col("stem")).otherwise(F.concat("stem", F.lit("_"), F.col("number").cast("string"))))
        run = uuid.uuid4().hex
        named.select("stem", "url", "name", self._bucket("stem").alias("bucket")).hint("rebalance", "bucket").write.partitionBy(
            "bucket").parquet(f"{self.root}/{run}/given")
        spots = named.select(base_of(F.col("name")).alias("base"), number_of(F.col("name")).alias("k"))
        singles = spots.groupBy("base", F.floor(F.col("k") / SPAN).alias("span")).agg(F.collect_list("k").alias("ks"))
        lines = singles.select("base", F.explode(merged(F.transform("ks", lambda k: F.struct(
            k.alias("lo"), k.alias("hi"))))).alias("r")).select("base", "r.lo", "r.hi", self._bucket("base").alias("bucket"))
        lines.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{run}/taken")
        commit(self.spark, self.root, batch_id, run)
