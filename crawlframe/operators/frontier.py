"""The URL frontier: the crawl log folded to state, and changes to that state.

Every fold is a `groupBy(url)` of mergeable minima and maxima, so map tasks
reduce a hot URL to one row before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRONTIER_COLUMNS = [
    "url", "source_url", "status", "depth", "title", "html_file_path",
    "created_time", "crawled_time", "error_message",
]


def _last(cond: Column, *values: str) -> Column:
    return F.max(F.when(cond, F.struct("seq", *values)))


def fold_aggregates() -> list[Column]:
    """The fold's state per URL; merging two states is taking min and max again."""
    op = F.col("op")
    return [
        F.min(F.when(op == "add", F.struct("seq", "ts", "depth", "source_url"))).alias("added"),
        _last(op != "add", "op").alias("mark"),
        _last(op == "success", "title", "html_file_path").alias("success"),
        _last(op == "failed", "error_message").alias("failed"),
        _last(op.isin("success", "failed"), "ts").alias("done"),
    ]


def frontier_from_state(state: DataFrame) -> DataFrame:
    """Frontier rows of a folded state.

    Marks before the first add had no row to change. The last mark overall
    counts if it follows the first add; no other mark could count instead.
    """
    def after_add(c: str) -> Column:
        return F.col(f"{c}.seq") > F.col("added.seq")

    return state.filter(F.col("added").isNotNull()).select(
        "url",
        F.col("added.source_url").alias("source_url"),
        F.when(after_add("mark"), F.col("mark.op")).otherwise("pending").alias("status"),
        F.col("added.depth").alias("depth"),
        F.when(after_add("success"), F.col("success.title")).alias("title"),
        F.when(after_add("success"), F.col("success.html_file_path")).alias("html_file_path"),
        F.col("added.ts").alias("created_time"),
        F.when(after_add("done"), F.col("done.ts")).alias("crawled_time"),
        F.when(after_add("failed"), F.col("failed.error_message")).alias("error_message"),
    )


def fold_log(log: DataFrame) -> DataFrame:
    """Current frontier from an append-only crawl log, in one shuffle."""
    return frontier_from_state(log.groupBy("url").agg(*fold_aggregates()))


def log_adds(log: DataFrame) -> DataFrame:
    """Every add with whether it made a new row (only the first one per URL does)."""
    adds = log.filter(F.col("op") == "add")
    first = adds.groupBy("url").agg(F.min("seq").alias("_first"))
    return adds.join(first, "url").withColumn("added", F.col("seq") == F.col("_first")).drop("_first")


def new_urls(frontier: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates not in the frontier, one row per URL (url, source_url, depth).

    The shallowest depth wins, then the smallest source.
    """
    best = candidates.groupBy("url").agg(F.min(F.struct("depth", "source_url")).alias("b"))
    fresh = best.join(frontier.select("url"), "url", "left_anti")
    return fresh.select("url", "b.source_url", "b.depth")


def add_urls(frontier: DataFrame, candidates: DataFrame, now: Column) -> DataFrame:
    """The frontier with the new candidates appended as pending."""
    fresh = new_urls(frontier, candidates)
    rows = fresh.select(
        "url", "source_url", F.lit("pending").alias("status"), F.col("depth").cast("int"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("html_file_path"),
        now.cast("timestamp").alias("created_time"),
        F.lit(None).cast("timestamp").alias("crawled_time"),
        F.lit(None).cast("string").alias("error_message"),
    )
    return frontier.select(*FRONTIER_COLUMNS).unionByName(rows)


def import_frontier(existing: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Append incoming rows whose URL is unknown; of several, the first by `order`."""
    cols = [c for c in FRONTIER_COLUMNS if c != "url"]
    first = incoming.groupBy("url").agg(F.min(F.struct(order, *cols)).alias("r"))
    fresh = first.join(existing.select("url"), "url", "left_anti")
    rows = fresh.select("url", *[F.col(f"r.{c}").alias(c) for c in cols])
    return existing.select(*FRONTIER_COLUMNS).unionByName(rows.select(*FRONTIER_COLUMNS))


def _crawled(frontier: DataFrame) -> DataFrame:
    """The URLs crawled successfully, as the hashed side of a join.

    Requests are usually many to a URL; they then pass by unsorted, so a task holds its
    part of these URLs and no request.
    """
    return frontier.filter(F.col("status") == "success").select("url").hint("shuffle_hash")


def skip_crawled(requests: DataFrame, frontier: DataFrame) -> DataFrame:
    """Requests whose URL is not crawled successfully yet."""
    return requests.join(_crawled(frontier), "url", "left_anti")


def already_crawled(requests: DataFrame, frontier: DataFrame) -> DataFrame:
    return requests.join(_crawled(frontier), "url", "left_semi")


def apply_updates(frontier: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply marks (url, seq, op, title, html_file_path, error_message, ts) to rows.

    Marks of unknown URLs change nothing. The updates are folded first, so the
    join meets at most one row per URL.
    """
    u = updates.groupBy(F.col("url").alias("u_url")).agg(
        _last(F.lit(True), "op").alias("mark"),
        _last(F.col("op") == "success", "title", "html_file_path").alias("ok"),
        _last(F.col("op") == "failed", "error_message").alias("bad"),
        _last(F.col("op").isin("success", "failed"), "ts").alias("done"),
    )
    # AQE broadcasts the folded updates if their real size allows it.
    j = frontier.join(u, F.col("url") == F.col("u_url"), "left")

    def pick(state: str, field: str, old: str) -> Column:
        return F.when(F.col(state).isNotNull(), F.col(f"{state}.{field}")).otherwise(F.col(old))

    new = {
        "status": pick("mark", "op", "status"),
        "title": pick("ok", "title", "title"),
        "html_file_path": pick("ok", "html_file_path", "html_file_path"),
        "crawled_time": pick("done", "ts", "crawled_time"),
        "error_message": pick("bad", "error_message", "error_message"),
    }
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in FRONTIER_COLUMNS])


def reset_stale(frontier: DataFrame, now: Column, hours: int = 1) -> DataFrame:
    """Crawling rows created over `hours` before `now` become pending (flag `was_stale`)."""
    stale = (F.col("status") == "crawling") & (
        F.col("created_time") < now - F.expr(f"INTERVAL '{hours}' HOUR")
    )
    stale = F.coalesce(stale, F.lit(False))
    return frontier.withColumn("was_stale", stale).withColumn(
        "status", F.when(F.col("was_stale"), "pending").otherwise(F.col("status"))
    )
