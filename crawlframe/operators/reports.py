"""Counts, rates and daily figures over the frontier and over fetch attempts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe import rules
from crawlframe.schemas import STATUSES


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)


def frontier_stats(frontier: DataFrame) -> DataFrame:
    """One row of status counts, also for an empty frontier."""
    return frontier.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "success", "failed", "crawling")],
    )


def status_counts(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def progress(frontier: DataFrame) -> DataFrame:
    return frontier_stats(frontier).select(
        "total", (F.col("success") + F.col("failed")).alias("completed"),
        "success", "pending", "failed", "crawling",
    )


def success_rate(frontier: DataFrame) -> DataFrame:
    s = frontier_stats(frontier)
    return s.select(
        "total",
        F.round(_percent(F.col("success"), F.col("total")), 1).alias("success_rate"),
        F.round(_percent(F.col("failed"), F.col("total")), 1).alias("failure_rate"),
    )


def status_share(frontier: DataFrame) -> DataFrame:
    """Share of each status and overall progress in whole percent, halves going up."""
    def whole(part: Column, total: Column) -> Column:
        return F.floor(_percent(part, total) + 0.5).cast("long")

    s = frontier_stats(frontier)
    known = reduce(lambda a, b: a + b, [F.col(x) for x in STATUSES])
    rows = F.array(*[F.struct(F.lit(x).alias("status"), F.col(x).alias("n")) for x in STATUSES])
    done = F.col("success") + F.col("failed")
    return (
        s.select(F.explode(rows).alias("r"), known.alias("known"),
                 whole(done, F.col("total")).alias("progress_percent"))
        .select("r.status", "r.n", whole(F.col("r.n"), F.col("known")).alias("percent"),
                "progress_percent")
    )


def run_status(frontier: DataFrame, running: bool = False) -> DataFrame:
    p = progress(frontier)
    label = (
        F.when(F.lit(running), "running")
        .when(F.col("failed") > 0, "finished_with_errors")
        .when(F.col("completed") > 0, "finished")
        .otherwise("idle")
    )
    texts = F.create_map(*[F.lit(x) for kv in rules.RUN_STATUS_TEXT.items() for x in kv])
    return p.select("completed", "failed", label.alias("run_status")).withColumn(
        "status_text", texts[F.col("run_status")]
    )


def file_stats(files: DataFrame, content: str = "html") -> DataFrame:
    return files.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(F.octet_length(content)), F.lit(0)).alias("total_size"),
    )


def md_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("success", "failed", "skipped", "existing")],
    )


def run_summary(attempts: DataFrame) -> DataFrame:
    """URLs, good and failed fetches, elapsed seconds and success rate per run."""
    ok = (F.col("status_code") == 200) & F.col("error_type").isNull()
    a = attempts.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("urls"),
        F.count_if(ok).alias("ok"),
        F.round(
            (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1_000_000.0, 1
        ).alias("elapsed_sec"),
    )
    return a.withColumn("failed", F.col("urls") - F.col("ok")).withColumn(
        "success_rate", F.round(_percent(F.col("ok"), F.col("urls")), 1)
    )


def daily_stats(frontier: DataFrame) -> DataFrame:
    """Rows added by creation day, crawled, failed and saved by crawl day."""
    one = F.lit(1).cast("long")
    zero = F.lit(0).cast("long")
    added = F.struct(
        F.to_date("created_time").alias("date"), one.alias("a"),
        zero.alias("c"), zero.alias("f"), zero.alias("p"),
    )
    crawled = F.struct(
        F.to_date("crawled_time").alias("date"), zero.alias("a"),
        (F.col("status") == "success").cast("long").alias("c"),
        (F.col("status") == "failed").cast("long").alias("f"),
        ((F.col("status") == "success") & F.col("html_file_path").isNotNull()).cast("long").alias("p"),
    )
    # Both days come from one pass over the frontier.
    return (
        frontier.select(F.explode(F.array(added, crawled)).alias("e"))
        .filter(F.col("e.date").isNotNull())
        .groupBy(F.col("e.date").alias("date"))
        .agg(
            F.sum("e.a").alias("urls_added"), F.sum("e.c").alias("urls_crawled"),
            F.sum("e.f").alias("urls_failed"), F.sum("e.p").alias("pages_saved"),
        )
        .filter("urls_added + urls_crawled + urls_failed > 0")
    )


def added_per_source(fresh: DataFrame) -> DataFrame:
    """New URLs per source page and depth, from `frontier.new_urls`."""
    return fresh.groupBy("source_url", "depth").agg(F.count(F.lit(1)).alias("added"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    one_row = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, one_row)


def import_summary(frontier: DataFrame, pages: DataFrame, stats: DataFrame) -> DataFrame:
    """Row counts of the three tables, then the frontier's rows per status."""
    per_status = status_counts(frontier).select(
        F.concat(F.lit("urls/"), "status").alias("table_name"), "n"
    )
    counts = table_counts({"urls": frontier, "pages": pages, "crawl_stats": stats})
    return counts.unionByName(per_status)


def describe_schema(df: DataFrame) -> DataFrame:
    """Column, type and number of filled values, in one pass over the table."""
    counted = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f"`{f.name}`").alias("filled"),
        )
        for i, f in enumerate(df.schema.fields, 1)
    ])
    return counted.select(F.inline(rows))
