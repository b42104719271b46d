"""Seed lists, rule lists, HTML folders, and the page, metadata and Markdown sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.functions import markdown as M
from crawlframe.functions import urls as U
from crawlframe.functions.text import strip
from crawlframe.operators.lookup import drop_blacklisted
from crawlframe.operators.ranking import salted_rank
from crawlframe.sources.commits import commit, committed


#: Stands for U+FFFD while a text is repaired: noncharacters, which no text interchange has.
_OWN_SIGN = "\ufdd0\ufdef\ufdd1"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    # A comment is a line that starts with '#' before any trimming.
    return spark.read.text(path).select("value", strip(F.col("value")).alias("line"))


def read_seeds(
    spark: SparkSession, path: str, validate: bool = False, rules: DataFrame | None = None
) -> DataFrame:
    """URLs of a seed list; with `validate` only valid ones outside the rules."""
    urls = (
        _lines(spark, path)
        .filter((F.col("line") != "") & ~F.col("value").startswith("#"))
        .select(F.col("line").alias("url"))
    )
    if validate:
        urls = urls.filter(U.is_valid_url("url"))
    return urls if rules is None else drop_blacklisted(urls, "url", rules)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-case rules of a blacklist file."""
    return (
        _lines(spark, path)
        .filter((F.col("line") != "") & ~F.col("line").startswith("#"))
        .select(F.lower("line").alias("rule"))
        .distinct()
    )


def read_html_dir(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """One row per file: name, text, size, modification time.

    Text is UTF-8; bytes that are not are left out. Files in other charsets go
    through the `binaryFile` source and `decode_pages`.
    """
    # The sign that the repair puts in goes again; where the file itself has it, it stays.
    held = F.replace("value", F.lit("\ufffd"), F.lit(_OWN_SIGN))
    repaired = F.replace(F.replace(F.make_valid_utf8(held), F.lit("\ufffd"), F.lit("")), F.lit(_OWN_SIGN), F.lit("\ufffd"))
    return (
        spark.read.option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
        .select(
            F.col("_metadata.file_name").alias("file_name"),
            F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(repaired).alias("html"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
    )


def list_files(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """Names, sizes and times of a folder's files; contents are not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
        .select(
            F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"),
            F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
        )
    )


def page_rows(pages: DataFrame, folder: str = "webpages") -> DataFrame:
    """Pages with the name they are stored under."""
    named = pages.withColumn("file_name", U.page_filename("url"))
    return named.withColumn("html_file_path", F.concat(F.lit(f"{folder}/"), "file_name"))


def write_pages(pages: DataFrame, path: str, folder: str = "webpages") -> DataFrame:
    """Store pages as one compressed table and give the marks the frontier needs.

    A page without content is not stored and is marked failed.
    """
    rows = page_rows(pages, folder)
    good = F.col("html").isNotNull()
    rows.filter(good).write.mode("errorifexists").option("compression", "zstd").parquet(path)
    # What counts as a success is what the table holds now.
    stored = pages.sparkSession.read.parquet(path).select(
        "url", F.lit("success").alias("op"), "html_file_path", F.lit(None).cast("string").alias("error_message"))
    return stored.unionByName(rows.filter(~good).select(
        "url", F.lit("failed").alias("op"), F.lit(None).cast("string").alias("html_file_path"),
        F.lit("no content").alias("error_message")))


def metadata_rows(pages: DataFrame, title: Column, links: Column, crawl_time: Column,
                  folder: str = "webpages") -> DataFrame:
    """Metadata file name and its JSON text, one row per page."""
    rows = page_rows(pages, folder)
    fields = F.struct(
        "url", title.alias("title"), crawl_time.alias("crawl_time"),
        F.size(links).alias("extracted_urls_count"), "html_file_path",
    )
    return rows.select(
        "url", U.metadata_filename("html_file_path").alias("metadata_path"),
        F.to_json(fields, {"ignoreNullFields": "false"}).alias("metadata"),
    )


def write_metadata(metadata: DataFrame, path: str) -> None:
    metadata.select(F.col("metadata").alias("value")).write.text(path)


def skip_existing(pages: DataFrame, existing: DataFrame, name: str = "md_name") -> DataFrame:
    """Pages whose output does not exist yet.

    AQE broadcasts the list of existing names if its size allows it; a longer
    list costs one shuffle of the pages.
    """
    return pages.join(existing.select(name).distinct(), name, "left_anti")


def gate_markdown(parsed: DataFrame, min_length: int = 200, min_quality: float = 40) -> DataFrame:
    """Clean, score and gate parsed pages (column `markdown`, flag `empty`).

    The result is generated from one struct, so that a later filter on the
    outcome reads it instead of computing the text again below the projection.
    """
    result = F.inline(F.array(M.assess("markdown", min_length, min_quality)))
    carried = [c for c in parsed.columns if c not in ("markdown", "empty")]
    j = parsed.select(*carried, "empty", result)
    outcome = F.when(F.col("empty"), "failed").otherwise(F.col("outcome"))
    return j.select(
        *carried,
        outcome.alias("outcome"),
        F.when(F.col("empty"), "处理失败: HTML文件为空").otherwise(F.col("reason")).alias("reason"),
        F.when(outcome == "success", F.col("clean")).alias("clean_markdown"),
        F.when(~F.col("empty"), F.col("quality")).alias("quality"),
    )


def unique_md_names(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Give outputs whose name is taken the first free `_1`, `_2`, ... suffix.

    Taken are the existing names and the plain names of the batch itself; the
    first page of a name that does not exist yet keeps it. The r-th free number
    is r plus the taken numbers that lie before it.
    """
    old = existing.select("md_name").distinct()
    taken = old.union(batch.select("md_name").distinct()).distinct()
    number = F.regexp_extract("md_name", r"^(.*)_([1-9]\d{0,8})\.md$", 2)
    stem = F.regexp_extract("md_name", r"^(.*)_([1-9]\d{0,8})\.md$", 1)
    numbered = taken.filter(number != "").select(
        F.concat(stem, F.lit(".md")).alias("_base"), number.cast("bigint").alias("_k"))
    # Free numbers before each taken one: k less its place among the taken.
    gaps = numbered.groupBy("_base").agg(F.array_sort(F.collect_set("_k")).alias("_ks")).select(
        "_base", F.transform("_ks", lambda k, i: k - i - 1).alias("_free"))
    ranked = salted_rank(batch, ["md_name"], "url", "_rank")
    j = ranked.join(old.select(F.col("md_name").alias("_old")), F.col("md_name") == F.col("_old"), "left").join(
        gaps, F.col("md_name") == F.col("_base"), "left")
    is_old = F.col("_old").isNotNull()
    r = F.col("_rank") - F.when(is_old, 0).otherwise(1)
    passed = F.size(F.filter(F.coalesce("_free", F.expr("cast(array() as array<bigint>)")), lambda f: f < r))
    fresh = F.when(~is_old & (F.col("_rank") == 1), F.col("md_name")).otherwise(F.concat(
        F.regexp_replace("md_name", r"\.md$", ""), F.lit("_"), (r + passed).cast("string"), F.lit(".md")))
    return j.withColumn("md_name", fresh).select(*batch.columns)


def write_markdown(batch: DataFrame, path: str, batch_id: str) -> bool:
    """Store the successful rows of a batch under its number; False if that was done before.

    Rows go to a folder of their own, then one small manifest names it. Readers follow
    manifests only, so a batch that is run again, or dies half way, is in the corpus once or not.
    """
    spark = batch.sparkSession
    if batch_id in committed(spark, path):
        return False
    run = f"data/{uuid.uuid4().hex}"
    rows = batch.filter(F.col("outcome") == "success").select("md_name", "clean_markdown", "quality")
    rows.write.option("compression", "zstd").parquet(f"{path}/{run}")
    commit(spark, path, batch_id, run)
    return True


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """The corpus: the rows of all committed batches."""
    schema = "md_name string, clean_markdown string, quality double"
    folders = [f"{path}/{p}" for p in committed(spark, path).values()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def rejects(batch: DataFrame, at: Column | None = None) -> DataFrame:
    """Failed and low-quality pages with reason and time, kept apart by `outcome`."""
    return batch.filter(F.col("outcome").isin("failed", "skipped")).select(
        "md_name", "outcome", "reason",
        (F.current_timestamp() if at is None else at).alias("rejected_at"),
    )


def read_frontier_jdbc(
    spark: SparkSession, url: str, properties: dict[str, str], table: str = "urls",
    status: str | None = None, partitions: int = 1, lower: int = 0, upper: int = 0,
) -> DataFrame:
    """Frontier rows of a database table; the status filter is pushed down.

    With `partitions` above one, the integer key `id` between the bounds splits
    the read into parallel range scans. Credentials come from the caller.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in properties.items():
        reader = reader.option(k, v)
    if partitions > 1:
        reader = (
            reader.option("partitionColumn", "id").option("numPartitions", partitions)
            .option("lowerBound", lower).option("upperBound", upper)
        )
    df = reader.load()
    return df if status is None else df.filter(F.col("status") == status)


def gather_seeds(
    spark: SparkSession, args: list[str] | None = None, file_seeds: DataFrame | None = None,
    picks: DataFrame | None = None,
) -> DataFrame:
    """Seeds by position: random frontier picks alone if there are any, else the
    given URLs followed by those of the file."""
    cols = "url string, pos long, part int"
    given = spark.createDataFrame([(u, i, 0) for i, u in enumerate(args or [])], cols)
    if file_seeds is not None:
        given = given.unionByName(file_seeds.select("url", "pos", F.lit(1).alias("part")))
    if picks is not None and not picks.isEmpty():
        given = picks.select("url", "pos", F.lit(0).alias("part"))
    return given.select("url", F.struct("part", "pos").alias("pos"))
