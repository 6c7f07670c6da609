"""Streams: continuous scoring, sessions, audit rollups, running profiles."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tablekit.functions.columns import col, numeric_columns
from tablekit.functions.ordering import sessions as number_sessions
from tablekit.operators.govern import audit_rollup
from tablekit.operators.score import score_batch


def read_stream(spark: SparkSession, folder: str, schema: T.StructType | str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Files arriving in a folder, with a fixed schema."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def score_stream(model, stream: DataFrame, target: str, checkpoint: str):
    """Append scored rows to a Parquet folder until the present input is used up."""
    return (
        score_batch(model, stream)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def activity_sessions(events: DataFrame, key: str, ts: str, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(key, session_start, session_end, n): idle gaps close a session. Streams wait for the watermark."""
    rows = events.withColumn(ts, col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(ts, late)
    window = F.session_window(col(ts), gap)
    grouped = rows.groupBy(col(key).alias("key"), window.alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(
        F.col("key").alias(key), F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"
    )


#: Rows of a key that are held before they are joined to its sessions.
MERGED = 10_000


class _OpenSessions(StatefulProcessor):
    """The open sessions of a key: (start, last, n) in microseconds. Those that the watermark has left idle are closed with the
    key's next rows, or by its timer for the session that closes first; a key keeps only sessions that the watermark has not
    passed. A question to the state costs more than a row, so there are few of them a key, not some for every session."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        spans = [tuple(x) for x in self.open.get()]
        timer, size = self._next(spans), len(spans)
        for r in rows:
            spans.append((r["micros"], r["micros"], 1))
            if len(spans) >= 2 * size + MERGED:
                spans = self._joined(spans)
                size = len(spans)
        return self._settle(key, self._joined(spans), timer, True, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        spans = [tuple(x) for x in self.open.get()]
        return self._settle(key, spans, self._next(spans), False, timerValues)

    def _settle(self, key, spans: list[tuple[int, int, int]], timer: int | None, changed: bool, values) -> Iterator[Row]:
        """Close what is idle, keep the rest, and have a timer for the first of it; `timer` is the one there is."""
        now = values.getCurrentWatermarkInMs()
        over = [x for x in spans if self._next([x]) <= now]
        left = [x for x in spans if self._next([x]) > now]
        if left and (changed or over):
            self.open.put(left)
        elif over:
            self.open.clear()
        due = self._next(left)
        if due is not None and due != timer:
            self.handle.registerTimer(due)
        return iter([Row(key=key[0], first=first, last=last, n=n) for first, last, n in over])

    def _next(self, spans: list[tuple[int, int, int]]) -> int | None:
        """The millisecond at which the first session closes."""
        return min(((last + self.gap) // 1_000 + 1 for _, last, _ in spans), default=None)
    def _joined(self, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Sessions whose gap is not wider than allowed become one."""
        out: list[tuple[int, int, int]] = []
        for first, last, n in sorted(spans):
            if out and first - out[-1][1] <= self.gap:
                out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
            else:
                out.append((first, last, n))
        return out

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, key: str, ts: str, gap_seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """(key, session_start, last_event, n) of a stream, each session once, when the watermark says that it stayed idle.

    Rows older than the watermark are dropped. A hot key costs the state of its open sessions, not its rows. Needs the RocksDB
    state store; what is open when the input ends is in open_sessions.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(col(key).alias("key"), col(ts).cast("timestamp").alias("seen")).withWatermark("seen", late)
    rows = rows.withColumn("micros", F.unix_micros("seen"))
    found = rows.groupBy("key").transformWithState(
        statefulProcessor=_OpenSessions(gap_seconds * 1_000_000),
        outputStructType=f"key {kind}, first long, last long, n long",
        outputMode="append",
        timeMode="eventTime",
    )
    return _shown(found, key)


def store_sessions(events: DataFrame, key: str, ts: str, target: str, checkpoint: str, gap_seconds: int = 3600, late: str = "1 hour"):
    """Append the closed sessions of a stream to a Parquet folder until the present input is used up."""
    conf, name = events.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = session_stream(events, key, ts, gap_seconds, late).writeStream.format("parquet").outputMode("append")
        return writer.option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def open_sessions(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """(key, session_start, last_event, n) of the sessions that a session_stream with this checkpoint holds open."""
    state = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    return _shown(state.select("key.key", "list_element.*"), key)


def _shown(sessions: DataFrame, key: str) -> DataFrame:
    return sessions.select(F.col("key").alias(key), F.timestamp_micros("first").alias("session_start"), F.timestamp_micros("last").alias("last_event"), "n")


def batch_sessions(
    events: DataFrame, key: str, ts: str, gap_seconds: int = 3600, ties: list[str] = (), rows: int | None = None
) -> DataFrame:
    """(key, session, session_start, last_event, n) by gaps between neighbours. A hot key is cut at time
    bounds and its sessions are carried across them, so no task holds a whole key."""
    numbered = number_sessions(events, [key], ts, gap_seconds * 1_000_000, list(ties), rows)
    return numbered.groupBy(col(key), F.col("_session").alias("session")).agg(
        F.min(col(ts)).alias("session_start"), F.max(col(ts)).alias("last_event"), F.count("*").alias("n")
    )


def audit_stream(events: DataFrame, ts: str = "ts", kind: str = "event_type", severity: str = "severity", every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The audit rollup on a stream; rows later than the watermark are dropped."""
    rows = events.withColumn(ts, col(ts).cast("timestamp"))
    return audit_rollup(rows.withWatermark(ts, late), ts, kind, severity, every)


# -- running profile --------------------------------------------------------------------------------


def profile_sums(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, n, nulls, mean, m2, min, max) of one batch; these merge without the rows."""
    names = names or numeric_columns(df)
    parts = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("double").alias("v")) for c in names])
    return df.select(F.inline(parts)).groupBy("column").agg(
        F.count("v").alias("n"),
        F.count_if(F.col("v").isNull()).alias("nulls"),
        F.avg("v").alias("mean"),
        (F.var_pop("v") * F.count("v")).alias("m2"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )


def merge_profiles(parts: DataFrame) -> DataFrame:
    """Batch sums added up: (column, count, null_count, mean, std, min, max)."""
    total = parts.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.sum("nulls").alias("null_count"),
        (F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))).alias("mean"),
        F.sum("m2").alias("within"),
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("squares"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )
    spread = F.col("within") + F.col("squares") - F.col("count") * F.col("mean") * F.col("mean")
    std = F.when(F.col("count") > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (F.col("count") - 1)))
    return total.select("column", "count", "null_count", "mean", std.alias("std"), "min", "max")


def profile_stream(stream: DataFrame, state: str, checkpoint: str, names: list[str] | None = None):
    """Write each micro-batch's sums under its own batch folder, so a replayed batch overwrites itself."""

    def store(batch: DataFrame, number: int):
        profile_sums(batch, names).write.mode("overwrite").parquet(f"{state}/batch={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_profile(spark: SparkSession, state: str) -> DataFrame:
    return merge_profiles(spark.read.parquet(state))
