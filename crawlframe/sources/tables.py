"""The stored tables and the compressed, verified snapshots of the page corpus."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.functions.text import size_label
from crawlframe.schemas import TABLES
from crawlframe.session import cut_lineage


def create_tables(spark: SparkSession, root: str) -> None:
    """Make the three empty tables; existing ones are left as they are."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def append_rows(df: DataFrame, root: str, name: str) -> None:
    """Append rows cast to the table's column types; absent columns are NULL."""
    have = set(df.columns)
    cols = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in TABLES[name].fields
    ]
    df.select(*cols).write.mode("append").parquet(f"{root}/{name}")


def reset_tables(spark: SparkSession, root: str) -> None:
    """Replace the three tables by empty ones."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/{name}")


def checksum_columns(df: DataFrame, content: str = "html"):
    """Row count, content bytes and a checksum that does not depend on row order."""
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(20,0)")
    return [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.octet_length(content)), F.lit(0)).cast("long").alias("raw_bytes"),
        F.coalesce(F.sum(row_hash), F.lit(0)).cast("decimal(38,0)").cast("string").alias("checksum"),
    ]


#: The folder column of a snapshot, and how many folders it has.
BUCKET, BUCKETS = "snapshot_bucket", 16
MANIFEST = "name string, created timestamp, rows long, raw_bytes long, checksum string, stored_bytes long, schema string"
TREE = "name string, bucket int, file string, rows long, raw_bytes long, checksum string, length long"


def snapshot_bucket(key: str, buckets: int = BUCKETS) -> Column:
    """The folder of a row: 28 bits of its key's md5 modulo the number of folders."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 7), 16, 10).cast("bigint"),
                  F.lit(buckets)).cast("int")


def snapshot(
    df: DataFrame, root: str, at: datetime, content: str = "html", codec: str = "zstd",
    level: int | None = None, key: str = "url", buckets: int = BUCKETS,
) -> DataFrame:
    """Write a snapshot, its manifest row, and its tree of checksums.

    Rows lie in folders by the hash of `key`. The manifest's figures are observed while they
    are written; the tree's leaves, one per file, are read back and must add up to them.
    Sums of leaves are the checksums of the folders, and sums of those that of the whole.
    """
    spark = df.sparkSession
    name = f"webpages_archive_{at:%Y%m%d_%H%M%S}"
    seen = Observation()
    placed = df.observe(seen, *checksum_columns(df, content)).withColumn(BUCKET, snapshot_bucket(key, buckets))
    writer = placed.hint("rebalance", BUCKET).write.option("compression", codec).partitionBy(BUCKET)
    if level is not None:
        writer = writer.option("parquet.compression.codec.zstd.level", str(level))
    writer.mode("errorifexists").parquet(f"{root}/{name}")
    got = seen.get
    leaves = cut_lineage(_leaves(spark, root, name, df.schema, content).select(F.lit(name).alias("name"), "*"))
    told = leaves.agg(F.sum("rows"), F.sum(F.col("checksum").cast("decimal(38,0)")).cast("string"), F.sum("length")).first()
    if got["rows"] and (told[0], told[1]) != (got["rows"], got["checksum"]):
        raise ValueError(f"snapshot {name} does not hold what was written")
    leaves.coalesce(1).write.mode("append").json(f"{root}/_tree")
    row = [(name, at, got["rows"], got["raw_bytes"], got["checksum"], told[2], df.schema.json())]
    manifest = spark.createDataFrame(row, MANIFEST)
    manifest.write.mode("append").json(f"{root}/_manifest")
    return with_ratio(manifest)


def _files(spark: SparkSession, root: str, name: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option(
        "recursiveFileLookup", "true").load(f"{root}/{name}")
    return found.select(F.regexp_extract("path", rf"/{BUCKET}=(\d+)/", 1).cast("int").alias("bucket"),
                        F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "length")


def read_snapshot(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None,
                  buckets: list[int] | None = None, skip_damaged: bool = False) -> DataFrame:
    """The rows of a snapshot, of some folders or all; damaged files are an error unless skipped."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())]))
    if skip_damaged:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    df = reader.parquet(f"{root}/{name}")
    return df if buckets is None else df.filter(F.col(BUCKET).isin(buckets))


def _leaves(spark: SparkSession, root: str, name: str, schema: T.StructType, content: str) -> DataFrame:
    """(bucket, file, rows, raw_bytes, checksum, length) as the files are now; unreadable ones have no rows."""
    df = read_snapshot(spark, root, name, schema, skip_damaged=True)
    own = df.select(*[F.col(f"`{c}`") for c in schema.names])
    sums = df.groupBy(F.col(BUCKET).alias("bucket"), F.col("_metadata.file_name").alias("file")).agg(*checksum_columns(own, content))
    return _files(spark, root, name).join(sums, ["bucket", "file"], "left").select(
        "bucket", "file", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("raw_bytes", F.lit(0)).alias("raw_bytes"),
        F.coalesce("checksum", F.lit("0")).alias("checksum"), "length")


def read_tree(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TREE).json(f"{root}/_tree").filter(F.col("name") == name)


def verify_tree(spark: SparkSession, root: str, name: str, content: str = "html") -> DataFrame:
    """Per folder: rows and files as recorded and as found now, the files that differ, and whether all is well."""
    want = read_tree(spark, root, name).select(
        "bucket", "file", F.col("rows").alias("r"), F.col("checksum").alias("c"), F.col("length").alias("l"))
    both = _leaves(spark, root, name, snapshot_schema(spark, root, name), content).join(want, ["bucket", "file"], "full")
    same = F.coalesce((F.col("rows") == F.col("r")) & (F.col("checksum") == F.col("c")) & (F.col("length") == F.col("l")), F.lit(False))
    return both.groupBy("bucket").agg(
        F.coalesce(F.sum("r"), F.lit(0)).alias("rows"), F.coalesce(F.sum("rows"), F.lit(0)).alias("actual_rows"),
        F.array_sort(F.collect_set(F.when(~same, F.col("file")))).alias("bad_files"), F.every(same).alias("ok"))


def folder_checksums(df: DataFrame, key: str = "url", content: str = "html", buckets: int = BUCKETS) -> DataFrame:
    """Per folder that rows would lie in: their number and checksum."""
    return df.groupBy(snapshot_bucket(key, buckets).alias("bucket")).agg(*checksum_columns(df, content)).select(
        "bucket", "rows", "checksum")


def tree_checksums(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_tree(spark, root, name).groupBy("bucket").agg(
        F.sum("rows").alias("rows"), F.sum(F.col("checksum").cast("decimal(38,0)")).cast("string").alias("checksum"))


def _different(a: DataFrame, b: DataFrame) -> list[int]:
    """Folders whose checksums differ; as many numbers as there are folders at most."""
    j = a.select("bucket", F.struct("rows", "checksum").alias("a")).join(
        b.select("bucket", F.struct("rows", "checksum").alias("b")), "bucket", "full")
    return sorted(r["bucket"] for r in j.filter(~F.col("a").eqNullSafe(F.col("b"))).select("bucket").collect())


def compare_snapshots(spark: SparkSession, root: str, old: str, new: str, key: str = "url") -> DataFrame:
    """(key, change) of rows added, removed or changed between two snapshots; equal folders are not read."""
    parts = _different(tree_checksums(spark, root, old), tree_checksums(spark, root, new))

    def hashed(name: str, out: str) -> DataFrame:
        df = read_snapshot(spark, root, name, buckets=parts)
        own = [F.col(f"`{c}`") for c in df.columns if c != BUCKET]
        # Rows of one key count together, however often it occurs.
        return df.groupBy(F.col(key)).agg(F.sum(F.xxhash64(*own).cast("decimal(20,0)")).alias(out))

    j = hashed(old, "_a").join(hashed(new, "_b"), key, "full").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    return j.select(key, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed").alias("change"))


def with_ratio(manifest: DataFrame) -> DataFrame:
    saved = (1 - F.col("stored_bytes") / F.col("raw_bytes")) * 100
    return manifest.withColumn(
        "ratio_percent", F.when(F.col("raw_bytes") > 0, F.round(saved, 1)).otherwise(0.0)
    )


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{root}/_manifest")


def snapshot_schema(spark: SparkSession, root: str, name: str) -> T.StructType:
    """The columns of a snapshot, from its manifest row."""
    return T.StructType.fromJson(json.loads(read_manifest(spark, root).filter(F.col("name") == name).first()["schema"]))


def verify_snapshot(spark: SparkSession, root: str, name: str, content: str = "html") -> DataFrame:
    """One row: a snapshot's rows as recorded and as found now, and whether all its folders are well."""
    return verify_tree(spark, root, name, content).agg(
        F.lit(name).alias("name"), F.sum("rows").alias("rows"), F.sum("actual_rows").alias("actual_rows"),
        F.every("ok").alias("ok"))


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Snapshots, newest first, with size and number of rows."""
    return (
        read_manifest(spark, root)
        .select("name", size_label("stored_bytes").alias("size"), "rows", "created")
        .orderBy(F.desc("created"), "name")
    )


def retain_unarchived(df: DataFrame, snapshot_df: DataFrame, key: str = "url") -> DataFrame:
    """Rows the snapshot does not hold; write them to a new path to clean up."""
    return df.join(snapshot_df.select(key).distinct(), key, "left_anti")


def retain_by_tree(df: DataFrame, root: str, name: str, key: str = "url", content: str = "html",
                   buckets: int = BUCKETS) -> DataFrame:
    """`retain_unarchived` that leaves out, unread, the folders whose checksums the snapshot shares."""
    spark = df.sparkSession
    parts = _different(folder_checksums(df, key, content, buckets), tree_checksums(spark, root, name))
    near = df.filter(snapshot_bucket(key, buckets).isin(parts))
    return retain_unarchived(near, read_snapshot(spark, root, name, buckets=parts), key)
