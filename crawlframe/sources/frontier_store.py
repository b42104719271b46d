"""The frontier as a stored table that is changed bucket by bucket.

A URL's bucket is its hash modulo a fixed number. Every change writes the buckets that
it changes anew, under a new version number, and then a manifest that names the files of
every bucket; buckets without a change keep the files they have. Readers take the newest
manifest whole or not at all, so they never see half a change, and older versions can still be
read. Nothing is overwritten or removed: a job that dies leaves files that no manifest names.

Two writers of one version collide when the second writes its manifest, which fails.

With each version stand its statistics: rows per status and the daily table. A change takes the old
rows of the changed buckets out of the last version's figures and puts the new ones in, so
the figures follow a status that moves without a count of the whole frontier.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.operators import frontier as FR
from crawlframe.operators import reports as RP
from crawlframe.schemas import URLS
from crawlframe.session import cut_lineage

MANIFEST = "bucket int, path string, rows long, bytes long"
STATUS = "status string, n bigint"
DAILY = "date date, urls_added bigint, urls_crawled bigint, urls_failed bigint, pages_saved bigint"


class FrontierStore:
    """A frontier under `root`; make it once with `create`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.buckets = spark.read.json(f"{self.root}/layout").first()["buckets"]

    @classmethod
    def create(cls, spark: SparkSession, root: str, rows: DataFrame | None = None, buckets: int = 64) -> FrontierStore:
        """A new store with the rows (one per URL). Choose `buckets` so that one fits a task."""
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("errorifexists").json(f"{root.rstrip('/')}/layout")
        store = cls(spark, root)
        first = spark.createDataFrame([], URLS) if rows is None else rows
        written = store._write(0, store._placed(first))
        store._commit(0, written, None, store._counted(0, first, None))
        return store

    # --- manifests --------------------------------------------------------------------

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option(
            "recursiveFileLookup", "true").load(f"{self.root}/manifest")  # one file each, so it is there whole or not
        found = files.select(F.regexp_extract("path", r"/v=(\d+)/[^/]*$", 1).cast("int").alias("v")).collect()
        return sorted(r["v"] for r in found)

    def manifest(self, version: int | None = None) -> DataFrame:
        """Per bucket that has rows: its folder, rows and stored bytes."""
        v = self.versions()[-1] if version is None else version
        return self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest/v={v}").filter("bucket >= 0")

    def _commit(self, version: int, written: DataFrame, before: DataFrame | None, stats: str = "") -> None:
        named = written.select("bucket", "path", "rows", "bytes")
        if before is not None:
            named = named.unionByName(before.join(F.broadcast(written.select("bucket")), "bucket", "left_anti"))
        # A row of no bucket names the statistics, and is there for an empty frontier too.
        mark = self.spark.createDataFrame([(-1, stats, 0, 0)], MANIFEST)
        mark.unionByName(named.filter("rows > 0")).coalesce(1).write.mode("errorifexists").json(f"{self.root}/manifest/v={version}")

    # --- reading and writing buckets ------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("url"), F.lit(self.buckets)).cast("int")

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*FR.FRONTIER_COLUMNS, self._bucket().alias("bucket"))

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The frontier of a version (the newest by default), of some buckets or all."""
        named = self.manifest(version)
        if buckets is not None:
            named = named.filter(F.col("bucket").isin(buckets))
        paths = [r["path"] for r in named.select("path").collect()]  # one per bucket
        if not paths:
            return self.spark.createDataFrame([], URLS)
        return self.spark.read.schema(URLS).parquet(*[f"{self.root}/{p}" for p in paths])

    def _write(self, version: int, placed: DataFrame, buckets: list[int] | None = None) -> DataFrame:
        """Write the rows by bucket; gives manifest rows, also for asked buckets that are empty now."""
        run = f"data/v={version}-{uuid.uuid4().hex[:8]}"
        # A bucket that outgrows a task is split into several files, small ones share a task.
        placed.hint("rebalance", "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/{run}")
        stored = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option(
            "recursiveFileLookup", "true").load(f"{self.root}/{run}").select(
                F.regexp_extract("path", r"/bucket=(\d+)/", 1).cast("int").alias("bucket"), "length")
        size = stored.groupBy("bucket").agg(F.sum("length").alias("bytes"))
        schema = T.StructType([*URLS.fields, T.StructField("bucket", T.IntegerType())])
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{run}").groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
        asked = buckets if buckets is not None else range(self.buckets)
        every = self.spark.createDataFrame([(b,) for b in asked], "bucket int")
        return cut_lineage(every.join(rows, "bucket", "left").join(size, "bucket", "left").select(
            "bucket", F.concat(F.lit(f"{run}/bucket="), F.col("bucket").cast("string")).alias("path"),
            F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("bytes", F.lit(0)).alias("bytes")))

    def _touched(self, changed: DataFrame) -> list[int]:
        """The buckets of changed URLs; at most as many numbers as there are buckets."""
        return sorted(r["b"] for r in changed.select(self._bucket().alias("b")).distinct().collect())

    def _merge(self, changed: DataFrame, change) -> int:
        """Rewrite the buckets of the URLs in `changed` as `change(old rows)`; gives the newest version."""
        now = self.versions()[-1]
        touched = self._touched(changed)
        if not touched:
            return now
        before, old = self.manifest(now), self.read(now, touched)
        written = self._write(now + 1, self._placed(change(old)), touched)
        paths = [f"{self.root}/{r['path']}" for r in written.filter("rows > 0").select("path").collect()]
        new = self.spark.read.schema(URLS).parquet(*paths) if paths else self.spark.createDataFrame([], URLS)
        self._commit(now + 1, written, before, self._counted(now + 1, new, old))
        return now + 1

    # --- statistics -----------------------------------------------------------------------

    def _counted(self, version: int, new: DataFrame, old: DataFrame | None) -> str:
        """Write the figures of a version: the last ones, less the old rows, plus the new ones."""
        run = f"stats/v={version}-{uuid.uuid4().hex[:8]}"
        states, days = RP.status_counts(new), RP.daily_stats(new)
        if old is not None:
            minus = [F.col(c).alias(c) if c == "date" else (-F.col(c)).alias(c) for c in days.columns]
            days = days.unionByName(RP.daily_stats(old).select(*minus)).unionByName(self._stats("daily", DAILY, version - 1))
            states = states.unionByName(RP.status_counts(old).select("status", (-F.col("n")).alias("n"))).unionByName(
                self._stats("status", STATUS, version - 1))
        sums = [F.sum(c).alias(c) for c in days.columns if c != "date"]
        states.groupBy("status").agg(F.sum("n").alias("n")).filter("n <> 0").coalesce(1).write.parquet(f"{self.root}/{run}/status")
        days.groupBy("date").agg(*sums).filter("urls_added + urls_crawled + urls_failed > 0").coalesce(1).write.parquet(
            f"{self.root}/{run}/daily")
        return run

    def _stats(self, table: str, schema: str, version: int | None) -> DataFrame:
        v = self.versions()[-1] if version is None else version
        named = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest/v={v}").filter("bucket = -1").first()["path"]
        return self.spark.read.schema(schema).parquet(f"{self.root}/{named}/{table}")

    def status_counts(self, version: int | None = None) -> DataFrame:
        """Rows per status, as kept with the version."""
        return self._stats("status", STATUS, version)

    def daily_stats(self, version: int | None = None) -> DataFrame:
        """The daily table, as kept with the version."""
        return self._stats("daily", DAILY, version)

    def frontier_stats(self, version: int | None = None) -> DataFrame:
        """One row of status counts, from the kept figures."""
        kept = self.status_counts(version)
        return kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *[
            F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(s)
            for s in ("pending", "success", "failed", "crawling")])

    # --- changes --------------------------------------------------------------------------

    def _near(self, rows: DataFrame) -> DataFrame:
        """The URLs stored in the buckets that the rows fall into."""
        return self.read(buckets=self._touched(rows)).select("url")

    def add_urls(self, candidates: DataFrame, now: Column) -> int:
        """Append unknown candidates as pending; only buckets that get a row are rewritten."""
        best = cut_lineage(candidates.groupBy("url").agg(F.min(F.struct("depth", "source_url")).alias("b")).select(
            "url", "b.source_url", "b.depth"))
        fresh = cut_lineage(best.join(self._near(best), "url", "left_anti"))
        return self._merge(fresh, lambda old: FR.add_urls(old, fresh, now))

    def import_rows(self, incoming: DataFrame, order: str) -> int:
        """Append incoming rows whose URL is unknown; of several, the first by `order`."""
        rows = cut_lineage(incoming)
        fresh = cut_lineage(rows.join(self._near(rows), "url", "left_anti"))
        return self._merge(fresh, lambda old: FR.import_frontier(old, fresh, order))

    def apply_updates(self, updates: DataFrame) -> int:
        """Apply marks; only buckets with a URL that the frontier knows and the marks name are rewritten."""
        rows = cut_lineage(updates)
        marks = cut_lineage(rows.join(self._near(rows), "url", "left_semi"))
        return self._merge(marks, lambda old: FR.apply_updates(old, marks))

    def reset_stale(self, now: Column, hours: int = 1) -> int:
        """Stale crawling rows become pending again; only their buckets are rewritten."""
        stale = FR.reset_stale(self.read(), now, hours).filter("was_stale").select("url")
        return self._merge(cut_lineage(stale), lambda old: FR.reset_stale(old, now, hours).drop("was_stale"))

    def written_bytes(self, version: int) -> int:
        """Bytes of the buckets that a version wrote."""
        here = self.manifest(version).filter(F.col("path").startswith(f"data/v={version}-"))
        return here.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
