"""Queues, recent lists, search and random picks.

Each is an ordered limit, which Spark runs as one top-k per task and a merge of
those. NULL order is the stored database's (first when descending) and the URL
settles ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlframe import rules
from crawlframe.functions.text import basename, iso_ts, or_default

LIMITS = {"pages": (1, 100), "failed": (1, 50), "search": (1, 100), "files": (1, 200)}


def check_limit(kind: str, n: int) -> int:
    """`n`, if it lies in the bounds of the web lists; for callers that want those bounds."""
    low, high = LIMITS[kind]
    if not low <= n <= high:
        raise ValueError(f"limit for {kind} must lie in {low}..{high}, got {n}")
    return n


def limit_ok(kind: Column, n: Column) -> Column:
    """Whether a list of the kind may have `n` rows; false for other kinds and without a number."""
    ok = F.lit(False)
    for name, (low, high) in LIMITS.items():
        ok = F.when(kind == name, n.between(low, high)).otherwise(ok)
    return F.coalesce(ok, F.lit(False))


def pending_queue(frontier: DataFrame, n: int = 100) -> DataFrame:
    """Pending rows, shallow and old ones first."""
    return (
        frontier.filter(F.col("status") == "pending")
        .orderBy(F.asc_nulls_last("depth"), F.asc_nulls_last("created_time"), F.asc("url"))
        .select("url", "source_url", "depth")
        .limit(n)
    )


def _shuffled(frontier: DataFrame, seed: int | str) -> DataFrame:
    pending = frontier.filter(F.col("status") == "pending").select("url", "source_url", "depth")
    return pending.withColumn("_h", F.md5(F.concat(F.col("url"), F.lit(f"#{seed}"))))


def random_pending(frontier: DataFrame, seed: int = 0) -> DataFrame:
    """One pending row, picked by a seeded hash of its URL."""
    return _shuffled(frontier, seed).orderBy("_h", "url").limit(1).drop("_h")


def random_batch(frontier: DataFrame, n: int, seed: int = 0, replace: bool = False) -> DataFrame:
    """`n` random pending rows; with `replace`, `n` independent picks that may repeat.

    With replacement, `n` ranks are drawn among the pending rows, whose order is
    that of a hash. Rows are counted per hash piece, and only pieces that a draw
    falls into are ranked.
    """
    if not replace:
        return (
            _shuffled(frontier, seed).orderBy("_h", "url").limit(n)
            .select("url", "source_url", "depth")
        )
    pending = frontier.filter(F.col("status") == "pending").select("url", "source_url", "depth")
    total = pending.count()
    digits = 1
    while total > 20_000 * 16**digits:
        digits += 1
    hashed = pending.withColumn("_h", F.md5("url"))
    piece = F.substring("_h", 1, digits)
    sizes = hashed.groupBy(piece.alias("_piece")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.orderBy("_piece"))  # at most 16 ** digits rows
    bounds = sizes.select("_piece", (upto - F.col("_n")).alias("_from"), upto.alias("_to"))
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}#"), F.col("id").cast("string"))), 1, 15), 16, 10)
    drawn = frontier.sparkSession.range(n).select(
        F.col("id").cast("int").alias("draw"), F.pmod(number.cast("bigint"), F.lit(max(total, 1))).alias("_at"))
    # Pieces are looked up by blocks of about a piece's size: a piece lies in few of them.
    block = max(1, -(-total // 16**digits))
    inside = bounds.select("*", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))).alias("_block"))
    drawn = drawn.withColumn("_block", F.floor(F.col("_at") / block)).join(inside, "_block").filter(
        (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to"))).select(
        "draw", "_piece", (F.col("_at") - F.col("_from") + 1).alias("_rank"))
    met = hashed.withColumn("_piece", piece).join(drawn.select("_piece").distinct(), "_piece", "left_semi")
    ranked = met.withColumn("_rank", F.row_number().over(W.partitionBy("_piece").orderBy("_h", "url")))
    return ranked.join(drawn, ["_piece", "_rank"]).select("draw", "url", "source_url", "depth")


def _by_time(df: DataFrame, status: str, time: str, n: int) -> DataFrame:
    return (
        df.filter(F.col("status") == status)
        .orderBy(F.desc_nulls_first(time), F.asc("url"))
        .limit(n)
    )


def page_view(df: DataFrame) -> DataFrame:
    """The columns a page list shows; needs no `file_exists`."""
    return df.select(
        "url", or_default("title", rules.NO_TITLE).alias("title"),
        basename("html_file_path").alias("html_file"),
        iso_ts("crawled_time").alias("crawled_time"), "status",
    )


def mark_files(view: DataFrame, files: DataFrame, name: str = "file_name") -> DataFrame:
    """A page list with `file_exists`.

    The listing is cut down to the shown names first. Spark broadcasts these
    where the list is as short as its limit says, and a long listing is then scanned
    without a shuffle; a long list is joined by name instead.
    """
    shown = view.select(F.col("html_file").alias(name)).distinct()
    present = files.select(name).join(shown, name, "left_semi").distinct()
    return (
        view.join(present.select(F.col(name).alias("_file")), F.col("html_file") == F.col("_file"), "left")
        .withColumn("file_exists", F.col("_file").isNotNull())
        .drop("_file")
    )


def recent_pages(frontier: DataFrame, n: int = 20) -> DataFrame:
    return page_view(_by_time(frontier, "success", "crawled_time", n))


def recent_failed(frontier: DataFrame, n: int = 10) -> DataFrame:
    """Recent failures, also in the shape of a page list."""
    rows = _by_time(frontier, "failed", "crawled_time", n)
    return rows.select(
        "url", F.lit(rules.FAILED_PAGE_TITLE).alias("title"),
        or_default("error_message", rules.UNKNOWN_ERROR).alias("error"),
        iso_ts("crawled_time").alias("crawled_time"), "status",
        F.lit(False).alias("file_exists"),
    )


def console_lines(frontier: DataFrame, n: int = 5) -> DataFrame:
    """The short success and failure lists of the console, cut to width."""
    ok = _by_time(frontier, "success", "crawled_time", n).select(
        F.lit("success").alias("part"), F.substring("url", 1, 60).alias("url"),
        F.substring(or_default("title", rules.NO_TITLE), 1, 30).alias("note"),
    )
    bad = _by_time(frontier, "failed", "crawled_time", n).select(
        F.lit("failed").alias("part"), F.substring("url", 1, 60).alias("url"),
        F.substring(or_default("error_message", rules.UNKNOWN_ERROR), 1, 30).alias("note"),
    )
    return ok.unionByName(bad)


def latest_failed(frontier: DataFrame, n: int = 10) -> DataFrame:
    return _by_time(frontier, "failed", "created_time", n).select("url", "error_message")


def latest_success(frontier: DataFrame, n: int = 10) -> DataFrame:
    return _by_time(frontier, "success", "created_time", n).select("url", "title", "html_file_path")


def search_pages(frontier: DataFrame, keyword: str, n: int = 50) -> DataFrame:
    """Successful pages whose URL or title holds the keyword; % and _ are wildcards."""
    like = f"%{keyword}%"
    hit = F.col("url").ilike(like) | F.coalesce(F.col("title").ilike(like), F.lit(False))
    return page_view(_by_time(frontier.filter(hit), "success", "crawled_time", n))


def newest_files(files: DataFrame, n: int = 100) -> DataFrame:
    """Newest files of a listing with `file_name` and `modified`."""
    return files.orderBy(F.desc("modified"), F.asc("file_name")).limit(n)


def peek(df: DataFrame, order: str = "url", n: int = 5) -> DataFrame:
    return df.orderBy(order).limit(n)


def last_logs(log: DataFrame, seq: str = "seq", n: int = 100) -> DataFrame:
    return log.orderBy(F.desc(seq)).limit(n)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)
