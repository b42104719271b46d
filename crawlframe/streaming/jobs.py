"""Streams over the crawl log: status counts, live frontier, log levels.

State lives in the state store and outputs are written per batch under the
batch's number, so a batch that runs again overwrites its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from crawlframe.functions.text import log_level, strip
from crawlframe.operators.frontier import fold_aggregates, frontier_from_state
from crawlframe.operators.ranking import running_index


def read_log_stream(spark: SparkSession, path: str, schema: T.StructType,
                    files_per_batch: int | None = None, pattern: str | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.parquet(path)


def _write_batches(df: DataFrame, out: str, checkpoint: str, mode: str,
                   trigger: dict | None) -> StreamingQuery:
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(save)
        .start()
    )


def stream_stats(log: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Counts per operation; a batch writes only the counts it changed."""
    counts = log.groupBy("op").agg(F.count(F.lit(1)).alias("n"))
    return _write_batches(counts, out, checkpoint, "update", trigger)


def read_stats(spark: SparkSession, out: str) -> DataFrame:
    """Latest count per operation of a `stream_stats` output."""
    return spark.read.parquet(out).groupBy("op").agg(F.max_by("n", "batch_id").alias("n"))


def stream_frontier(log: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Live frontier state of the URLs a batch touched.

    The state per URL is the batch fold's minima and maxima, which merge in any
    order: a late first add brings back the marks that seemed lost. State grows
    with the frontier, so the session should use the RocksDB state store.
    """
    state = log.groupBy("url").agg(*fold_aggregates())
    return _write_batches(state, out, checkpoint, "update", trigger)


def read_frontier(spark: SparkSession, out: str) -> DataFrame:
    """Current frontier of a `stream_frontier` output: each URL's newest state."""
    versions = spark.read.parquet(out)
    cols = ["added", "mark", "success", "failed", "done"]
    newest = versions.groupBy("url").agg(F.max_by(F.struct(*cols), "batch_id").alias("s"))
    return frontier_from_state(newest.select("url", "s.*"))


def compact_frontier(spark: SparkSession, out: str, target: str) -> None:
    """Write each URL's newest state to a new folder, as the start of its output.

    Later batches can be appended there, so that reading does not grow with the
    number of batches ever run.
    """
    versions = spark.read.parquet(out)
    cols = [c for c in versions.columns if c not in ("url", "batch_id")]
    newest = versions.groupBy("url").agg(F.max_by(F.struct("batch_id", *cols), "batch_id").alias("s"))
    newest.select("url", "s.*").write.partitionBy("batch_id").parquet(target)


def stream_progress(attempts: DataFrame, out: str, checkpoint: str, every: int = 10,
                    trigger: dict | None = None) -> StreamingQuery:
    """Each `every`-th row of a run (run_id, event_id, processed), counted over batch borders.

    Batches must come in the order of `event_id`. A batch numbers its own rows in
    pieces, so a run that holds most of them is no single task, and adds what the
    runs had before; the runs' counts after it are stored under its number, one row per run. A
    batch that runs again starts from the same counts and overwrites itself.
    """
    spark = attempts.sparkSession

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("run_id", "event_id")
        before = spark.createDataFrame([], "run_id bigint, n bigint")
        if batch_id > 0:
            before = spark.read.schema("run_id bigint, n bigint").parquet(f"{out}/counts/batch_id={batch_id - 1}")
        numbered = running_index(rows, ["run_id"], "event_id", "_nth").join(before, "run_id", "left")
        done = numbered.withColumn("processed", F.col("_nth") + F.coalesce("n", F.lit(0)))
        done.filter(F.col("processed") % every == 0).select("run_id", "event_id", "processed").write.mode("overwrite").parquet(
            f"{out}/points/batch_id={batch_id}")
        after = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).unionByName(before)
        after.groupBy("run_id").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{out}/counts/batch_id={batch_id}")

    return (
        attempts.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).foreachBatch(save).start()
    )


def read_progress(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/points").select("run_id", "event_id", "processed")


def stream_log_levels(lines: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Label each non-blank log line; stateless."""
    line = strip(F.col("value"))
    labelled = lines.select(line.alias("message")).filter(F.col("message") != "").withColumn(
        "level", log_level("message")
    )
    return _write_batches(labelled, out, checkpoint, "append", trigger)
