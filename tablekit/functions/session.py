"""Session-level helpers: lineage cuts, bounded collects, checked broadcasts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows that may be sent whole to every task.
BROADCAST_ROWS = 10_000


def build_session(master: str = "local[*]", name: str = "tablekit", **conf) -> SparkSession:
    """A session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the checkpoint folder, so that a lost executor costs a re-read, not a re-run."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor can reach. Only where it is unset and the driver's
    threads are the executors, a temporary folder of this machine."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="tablekit-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by keys into as many tasks as the session shuffles with, for groups that are small in
    bytes but heavy in compute: adaptive execution would merge them into a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def collect_bounded(df: DataFrame, limit: int, what: str) -> list:
    """Collect a result that must be small; refuse it when it is not."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when a count shows at most limit rows; otherwise leave the join to AQE."""
    if df.limit(limit + 1).count() <= limit:
        return F.broadcast(df)
    return df


def small_table(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Evaluate a per-class or per-series result once: a broadcast local table when it is small,
    a materialised distributed one otherwise."""
    rows = df.limit(limit + 1).collect()
    if len(rows) <= limit:
        return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
    return cut_lineage(df)
