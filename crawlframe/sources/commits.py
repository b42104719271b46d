"""Batches that are committed whole: data in a folder of its own, then one small manifest that names it."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


def commit(spark: SparkSession, root: str, batch_id: str, run: str) -> None:
    """Name `run` as the folder of the batch; fails if the batch is committed already."""
    row = spark.createDataFrame([(batch_id, run)], "batch_id string, path string").coalesce(1)
    row.write.mode("errorifexists").json(f"{root}/commits/{hashlib.md5(batch_id.encode()).hexdigest()}")


def committed(spark: SparkSession, root: str) -> dict[str, str]:
    """Committed batches and their folders; a short row each, however large they are."""
    try:
        found = spark.read.schema("batch_id string, path string").option("recursiveFileLookup", "true").json(f"{root}/commits")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return {}  # nothing was written yet
    return {r["batch_id"]: r["path"] for r in found.collect()}
