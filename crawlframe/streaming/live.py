"""The live frontier as keyed state with timers: only rows that change come out.

Each URL's state is what the batch fold keeps of it, so log rows may come in any order
within the watermark's delay. A row that is being crawled sets an event-time timer for the
moment it becomes stale; when the watermark passes it, the row falls back to pending without
any scan of the frontier. Times are whole microseconds (`*_us`), which no time zone changes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from crawlframe.operators.frontier import FRONTIER_COLUMNS
from crawlframe.session import PROVIDER, ROCKSDB
from crawlframe.streaming.jobs import _write_batches

#: What is kept of a URL; a `seq` of null means that there was no such row yet.
STATE = T.StructType([T.StructField(n, t) for n, t in (
    ("add_seq", T.LongType()), ("add_us", T.LongType()), ("depth", T.IntegerType()), ("source_url", T.StringType()),
    ("mark_seq", T.LongType()), ("op", T.StringType()), ("ok_seq", T.LongType()), ("title", T.StringType()),
    ("path", T.StringType()), ("bad_seq", T.LongType()), ("error", T.StringType()), ("done_seq", T.LongType()),
    ("done_us", T.LongType()), ("reset_seq", T.LongType()))])
#: The frontier row that comes out.
OUT = "url string, source_url string, status string, depth int, title string, html_file_path string, created_us bigint, " \
      "crawled_us bigint, error_message string"
OUT_ROW = Row(*(field.split()[0] for field in OUT.split(", ")))


def merged(state: dict[str, Any], row: Row) -> None:
    """Add one log row to a URL's state; the order of the rows makes no difference."""
    seq = row["seq"]

    def later(field: str) -> bool:
        return state[field] is None or seq > state[field]

    if row["op"] == "add":
        if state["add_seq"] is None or seq < state["add_seq"]:
            state.update(add_seq=seq, add_us=row["us"], depth=row["depth"], source_url=row["source_url"])
        return
    if later("mark_seq"):
        state.update(mark_seq=seq, op=row["op"])
    if row["op"] == "success" and later("ok_seq"):
        state.update(ok_seq=seq, title=row["title"], path=row["html_file_path"])
    if row["op"] == "failed" and later("bad_seq"):
        state.update(bad_seq=seq, error=row["error_message"])
    if row["op"] in ("success", "failed") and later("done_seq"):
        state.update(done_seq=seq, done_us=row["us"])


def frontier_row(url: str, state: dict[str, Any]) -> tuple | None:
    """The URL's frontier row, as the batch fold has it; a mark that was reset counts as pending."""
    if state["add_seq"] is None:
        return None

    def counts(seq: int | None) -> bool:
        return seq is not None and seq > state["add_seq"]

    marked = counts(state["mark_seq"]) and state["mark_seq"] != state["reset_seq"]
    ok, bad, done = counts(state["ok_seq"]), counts(state["bad_seq"]), counts(state["done_seq"])
    return (url, state["source_url"], state["op"] if marked else "pending", state["depth"], state["title"] if ok else None,
            state["path"] if ok else None, state["add_us"], state["done_us"] if done else None, state["error"] if bad else None)


class LiveFrontier(StatefulProcessor):
    """One URL's state and its timer."""

    def __init__(self, stale_ms: int):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("row", STATE)

    def _state(self) -> dict[str, Any]:
        held = self.kept.get() if self.kept.exists() else None
        return dict(zip(STATE.names, held if held is not None else [None] * len(STATE)))

    def _keep(self, url: str, state: dict[str, Any], before: tuple | None) -> Iterator[Row]:
        self.kept.update(tuple(state[n] for n in STATE.names))
        after = frontier_row(url, state)
        # The timer stands while the row is being crawled, and only then. It goes off when the
        # watermark reaches it; a row at the limit is not stale yet, hence one more millisecond.
        timed = after is not None and after[2] == "crawling" and state["add_us"] is not None
        wanted = {state["add_us"] // 1000 + self.stale_ms + 1} if timed else set()
        standing = set(self.handle.listTimers())
        for t in standing - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - standing:
            self.handle.registerTimer(t)
        if after is not None and after != before:
            yield OUT_ROW(*after)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self._state()
        before = frontier_row(key[0], state)
        for row in rows:
            merged(state, row)
        yield from self._keep(key[0], state, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self._state()
        before = frontier_row(key[0], state)
        if before is not None and before[2] == "crawling":
            state["reset_seq"] = state["mark_seq"]
        yield from self._keep(key[0], state, before)

    def close(self) -> None:
        pass


def stream_live(log: DataFrame, out: str, checkpoint: str, stale_hours: int = 1, delay: str = "1 hour",
                trigger: dict | None = None) -> StreamingQuery:
    """Changed frontier rows of a log stream, written per batch.

    Log rows more than `delay` behind the newest are dropped by the watermark. A crawling row created
    over `stale_hours` before the watermark becomes pending. Timers need the RocksDB state store,
    which this stream gets whatever the session has.
    """
    # Spark also loads the processor in a worker of the driver, which no shipped file reaches: it goes as code.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = log.withWatermark("ts", delay).select("url", "ts", "seq", "op", "depth", "source_url", "title", "html_file_path",
                                                 "error_message", F.unix_micros("ts").alias("us"))
    changes = rows.groupBy("url").transformWithState(
        statefulProcessor=LiveFrontier(stale_hours * 3_600_000), outputStructType=OUT, outputMode="Update",
        timeMode="EventTime")
    conf = log.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)
    try:  # a stream holds the settings that its session has when it starts
        return _write_batches(changes, out, checkpoint, "update", trigger)
    finally:
        conf.set(PROVIDER, before)


def read_live(spark, out: str) -> DataFrame:
    """The current frontier of a `stream_live` output: each URL's newest row.

    A URL comes out at most twice in a batch, first for its log rows and then
    for its timer, and only its timer makes a crawling row pending.
    """
    rows = spark.read.parquet(out)
    cols = [c for c in rows.columns if c not in ("url", "batch_id")]
    last = rows.groupBy("url").agg(F.max_by(F.struct(*cols), F.struct("batch_id", F.col("status") == "pending")).alias("r"))
    times = {"created_time": "created_us", "crawled_time": "crawled_us"}
    return last.select("url", "r.*").select(*[
        F.timestamp_micros(times[c]).alias(c) if c in times else F.col(c) for c in FRONTIER_COLUMNS])
