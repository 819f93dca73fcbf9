"""Lineage cuts, shared scratch folders and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast by hint only when a count proved it has at most this many rows.
BROADCAST_ROW_LIMIT = 200_000
# Rows of a part of a table that is spread over tasks.
SPREAD_ROWS = 2_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is created only for a local master, where the driver
    and the executors are the same process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="tierlift-")
    sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the stored table.

    A stored table survives lost executors, gives the optimizer its true size, and
    carries no constraints of the plan that made it (with checkpoints these grow from
    round to round in iterative jobs until planning dominates).
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast after counting; otherwise leave the join to Catalyst and AQE.

    Meant for stored tables, where a count reads no column.
    """
    return F.broadcast(df) if df.count() <= row_limit else df


def parts_of(spark: SparkSession, rows: int) -> int:
    """Parts of about ``SPREAD_ROWS`` rows, at least one a core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // SPREAD_ROWS))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute by ``keys`` where there are fewer splits than cores, or than parts of
    ``SPREAD_ROWS`` rows.

    Heavy per-row work on a few splits, or on a row group that falls to one split as a whole,
    would otherwise leave cores idle. The number of parts grows with the table, so a task's
    work does not. Meant for stored tables, where a count reads no column.
    """
    parts = parts_of(df.sparkSession, df.count())
    return df.repartition(parts, *keys) if df.rdd.getNumPartitions() < parts else df
