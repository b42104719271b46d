"""Session settings, the shared scratch folder, and the measured size bound."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after it was measured and found within both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "crawlframe", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Shuffle partitions are left to the caller (AQE coalesces them); Arrow
    batches are kept short because one row holds a whole HTML page.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
        PROVIDER: ROCKSDB,
    }
    settings.update(conf)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in `spark.checkpoint.dir`.

    Only a local session may go without: it gets a temporary folder. On a
    cluster every executor would write to its own disk, so that is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="crawlframe-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, in `crawlframe/` there.

    Nothing is reused or removed by a job; delete `crawlframe/` when no job runs.
    """
    return f"{shared_root(spark).rstrip('/')}/crawlframe/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once, for the Python stages.

    Needless where the package is installed on the cluster or passed with
    `--py-files`; Spark then just holds one more copy.
    """
    sc = spark.sparkContext
    if getattr(sc, "_crawlframe_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="crawlframe-ship-"), "crawlframe")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))
    sc._crawlframe_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise to reliable storage, so that a lost executor costs no replay."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Whether `df` is short and narrow enough; each task sends only two numbers."""
    width = F.octet_length(F.to_json(F.struct("*")))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A stored side of a join, marked for broadcast if it was measured within the bounds.

    Without the mark Spark starts the shuffle of the other side before it knows
    how small this one is; so a long, wide table stays where it is.
    """
    return F.broadcast(df) if fits_broadcast(df) else df
