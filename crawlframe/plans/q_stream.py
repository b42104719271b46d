"""Registered streaming queries; each runs its stream to the end and reads the result."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.plans import views as V
from crawlframe.plans.q_frontier import FOLD_SQL, shown
from crawlframe.plans.q_urls import LOG_LEVEL_SQL, LOG_LINES_SQL, log_lines
from crawlframe.plans.registry import query
from crawlframe.session import scratch
from crawlframe.streaming import jobs as S
from crawlframe.streaming import live as S_LIVE

_FILES = 2


def event_files(spark, d):
    """The events in several files, dealt out so that sequence numbers arrive mixed."""
    path = scratch(spark, "events")
    e = V.table(spark, d, "events")
    e.repartition(_FILES, F.col("event_id") % 97).write.parquet(path)
    return path, e.schema


def log_stream(spark, d):
    path, schema = event_files(spark, d)
    return V.log_columns(S.read_log_stream(spark, path, schema, files_per_batch=1))


def finish(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@query("stream_stats", "log_v", "SELECT op, count(*) AS n FROM log_v GROUP BY op")
def stream_stats(spark, d):
    out = scratch(spark, "stats")
    finish(S.stream_stats(log_stream(spark, d), out, scratch(spark, "ckpt")))
    return S.read_stats(spark, out)


@query("stream_frontier", "log_v", FOLD_SQL)
def stream_frontier(spark, d):
    out = scratch(spark, "frontier")
    finish(S.stream_frontier(log_stream(spark, d), out, scratch(spark, "ckpt")))
    return shown(S.read_frontier(spark, out))


@query("stream_compacted", "log_v", FOLD_SQL)
def stream_compacted(spark, d):
    out, target = scratch(spark, "frontier"), scratch(spark, "compact")
    finish(S.stream_frontier(log_stream(spark, d), out, scratch(spark, "ckpt")))
    S.compact_frontier(spark, out, target)
    return shown(S.read_frontier(spark, target))


@query("stream_log_levels", "", f"SELECT line AS message, {LOG_LEVEL_SQL} AS level FROM ({LOG_LINES_SQL}) l")
def stream_log_levels(spark, d):
    path = scratch(spark, "lines")
    lines = log_lines(V.table(spark, d, "events"))
    padded = F.explode(F.array(F.concat(F.lit("  "), "line", F.lit(" ")), F.lit("  ")))
    lines.select(padded.alias("value")).write.text(path)
    stream = spark.readStream.schema(T.StructType([T.StructField("value", T.StringType())])).text(path)
    out = scratch(spark, "levels")
    finish(S.stream_log_levels(stream, out, scratch(spark, "ckpt")))
    return spark.read.parquet(out).select("message", "level")


_LATE_HOURS, _STALE_HOURS = 6, 48


def timed_log(spark, d):
    """The log stream in three files along time, each with rows up to some hours late."""
    path = scratch(spark, "events")
    e = V.table(spark, d, "events")
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    step = (high - low) / 3
    late = F.col("ts") + F.make_dt_interval(hours=F.col("event_id") % _LATE_HOURS)
    for k in range(3):
        after = late >= F.lit(low + step * k) if k else F.lit(True)
        before = late < F.lit(low + step * (k + 1)) if k < 2 else F.lit(True)
        before = before if k else F.coalesce(before, F.lit(True))  # rows without a time come first
        e.filter(after & before).coalesce(1).write.mode("append").parquet(path)
    return V.log_columns(S.read_log_stream(spark, path, e.schema, files_per_batch=1))


@query("stream_stale", "log_v", f"""
    SELECT f.* REPLACE (CASE WHEN status = 'crawling' AND CAST(created_time AS TIMESTAMP) < w - INTERVAL {_STALE_HOURS} HOUR
        THEN 'pending' ELSE status END AS status)
    FROM ({FOLD_SQL}) f, (SELECT date_trunc('millisecond', max(ts)) - INTERVAL {_LATE_HOURS} HOUR AS w FROM log_v) n""")
def stream_stale(spark, d):
    out = scratch(spark, "live")
    finish(S_LIVE.stream_live(timed_log(spark, d), out, scratch(spark, "ckpt"), _STALE_HOURS, f"{_LATE_HOURS} hours"))
    return shown(S_LIVE.read_live(spark, out))


@query("stream_progress", "attempts_v", """
    WITH r AS (SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS processed FROM attempts_v)
    SELECT run_id, event_id, processed FROM r WHERE processed % 10 = 0""")
def stream_progress(spark, d):
    path = scratch(spark, "attempts")
    e = V.table(spark, d, "events").select("event_id", (F.col("user_id") % 3).cast("bigint").alias("run_id"))
    n = e.count()
    for k in range(3):  # in the order of events, as attempts come in
        part = e.filter((F.col("event_id") >= n * k // 3) & (F.col("event_id") < n * (k + 1) // 3))
        part.coalesce(1).write.mode("append").parquet(path)
    out = scratch(spark, "progress")
    finish(S.stream_progress(S.read_log_stream(spark, path, e.schema, files_per_batch=1), out, scratch(spark, "ckpt")))
    return S.read_progress(spark, out)
