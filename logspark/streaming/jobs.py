"""Event-driven work as Structured Streaming jobs.

Every job reads a stream, is run with a trigger (``availableNow`` by default) and keeps its progress in
a checkpoint below the shared folder. Tables written per batch are written to a folder named by the
batch id, so a repeated batch replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logspark.functions.reports import rca_is_healthy
from logspark.functions.rules import filter_pattern
from logspark.operators.bandit import DIM
from logspark.plans.scan import notify_gate
from logspark.session import scratch_path
from logspark.sources.stores import latest_by_key, notifications
from logspark.sources.triggers import decode_subscription

# Pushed-log pattern, look-back and schedule in minutes, idle seconds that end a session.
PUSH_PATTERN = "?ERROR ?FATAL ?CRITICAL"
LOOKBACK_MINUTES, EVERY_MINUTES = 30, 60
SESSION_IDLE = "300 seconds"


def read_stream(spark: SparkSession, path: str, schema: str | Any, files_per_batch: int | None = None, name: str = "*") -> DataFrame:
    """A stream over the parquet files of a folder whose name matches ``name``."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_to_table(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Write an append stream to parquet until all present input is done, and read the table."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")
    writer = stream.writeStream.format("parquet").option("path", path).outputMode("append")
    run(writer, checkpoint or scratch_path(spark, "progress"))
    return spark.read.schema(stream.schema).parquet(path)


def _begin(spark: SparkSession, path: str, schema) -> None:
    """An empty first batch, so that a stream without input leaves an empty table."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch=-1")


def run_latest(stream: DataFrame, keys: list[str], path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run an aggregate stream in update mode and read the newest row of each ``keys``.

    Windows that are still open at the end of the present input are included, with what they hold so far.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "latest")
    _begin(spark, path, stream.schema)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_batches(stream, store, "update", checkpoint)
    return latest_by_key(spark.read.parquet(path), keys, ["batch"]).drop("batch")


def run(writer, checkpoint: str) -> None:
    query: StreamingQuery = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Call ``each(batch, batch_id)`` for every batch until all present input is done."""
    folder = checkpoint or scratch_path(stream.sparkSession, "progress")
    run(stream.writeStream.outputMode(mode).foreachBatch(each), folder)


def subscription_stream(events: DataFrame, pattern: str = PUSH_PATTERN) -> DataFrame:
    """Messages of pushed payloads that match the pattern; no state."""
    return decode_subscription(events).filter(filter_pattern(F.col("message"), pattern))


def sliding_scan(
    lines: DataFrame, aggregates: list[Column], lookback: int = LOOKBACK_MINUTES, every: int = EVERY_MINUTES,
    late: str = "10 minutes", keys: tuple[str, ...] = ("log_group",),
) -> DataFrame:
    """Aggregate the last ``lookback`` minutes of each group every ``every`` minutes, by event time ``ts``.

    If the schedule is longer than the look-back, windows as long as the look-back are used and those
    that end on the schedule are kept; the look-back must then divide the schedule.
    """
    if every <= lookback:
        window = F.window("ts", f"{lookback} minutes", f"{every} minutes")
        rows = lines
    else:
        if every % lookback:
            raise ValueError("the look-back must divide a longer schedule")
        window = F.window("ts", f"{lookback} minutes")
        # Only lines of the last part of a schedule step can lie in a kept window.
        rows = lines.filter(F.pmod(F.floor(F.unix_seconds("ts") / 60), F.lit(every)) >= every - lookback)
    grouped = rows.withWatermark("ts", late).groupBy(window.alias("w"), *keys).agg(*aggregates)
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in grouped.columns if c != "w"])


def error_burst_stream(lines: DataFrame, width: str = "30 minutes", late: str = "10 minutes", key: str = "log_group") -> DataFrame:
    """Per window and group: line count, error count and whether more than 30 % are errors."""
    bad = F.count_if(F.lower("line").rlike("error|exception|fatal"))
    counted = lines.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), key).agg(
        F.count(F.lit(1)).alias("line_count"), bad.alias("error_count")
    )
    return counted.select(
        F.col("w.start").alias("window_start"), key, "line_count", "error_count",
        (F.col("error_count") > F.col("line_count") * 0.3).alias("burst"),
    )


def session_stream(turns: DataFrame, idle: str = SESSION_IDLE, late: str = "10 minutes", key: str = "conv_id") -> DataFrame:
    """Sessions of a conversation: they end after ``idle`` without a turn."""
    found = turns.withWatermark("ts", late).groupBy(F.session_window("ts", idle).alias("w"), key).agg(F.count(F.lit(1)).alias("turns"))
    return found.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "turns")


def ttl_stream(records: DataFrame, ttl: str, key: str = "id") -> DataFrame:
    """First sightings of each ``key`` by event time ``ts``: a record lives for ``ttl`` and hides repeats.

    Spark keeps one entry per live key and drops it when the watermark has passed its time to live.
    """
    return records.withWatermark("ts", ttl).dropDuplicatesWithinWatermark([key])


def bandit_sums(feedback: DataFrame) -> DataFrame:
    """Per action the sums a bandit model is made of; the same over a table and over a stream (update mode).

    ``feedback`` holds ``action_id, x, reward``.
    """
    cells = [F.sum(F.get("x", F.lit(i)) * F.get("x", F.lit(j))).alias(f"a{i}{j}") for i in range(DIM) for j in range(i, DIM)]
    cells += [F.sum(F.col("reward") * F.get("x", F.lit(i))).alias(f"b{i}") for i in range(DIM)]
    return feedback.groupBy("action_id").agg(*cells, F.count(F.lit(1)).alias("interactions"), F.sum("reward").alias("total_reward"))


def run_bandit(feedback: DataFrame, path: str | None = None) -> DataFrame:
    """Keep the bandit sums up to date and return the newest row of every action.

    Each batch writes its changed actions to a folder of its own.
    """
    return run_latest(bandit_sums(feedback), ["action_id"], path)


def run_notify(analyses: DataFrame, path: str | None = None) -> DataFrame:
    """Write notifications of analyses, but not of healthy scheduled scans, once per batch."""
    spark = analyses.sparkSession
    path = path or scratch_path(spark, "notifications")

    def store(batch: DataFrame, batch_id: int) -> None:
        wanted = notify_gate(batch, rca_is_healthy(F.col("analysis")))
        notifications(wanted).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    _begin(spark, path, notifications(analyses).schema)
    run_batches(analyses, store)
    return spark.read.parquet(path).drop("batch")


def run_upsert(updates: DataFrame, path: str | None = None) -> DataFrame:
    """Append status updates per batch (its newest per incident) and return the current status per incident."""
    spark = updates.sparkSession
    path = path or scratch_path(spark, "incidents")
    order = ["ts", "prefetch_status", "cached_data"]

    _begin(spark, path, updates.schema)

    def store(batch: DataFrame, batch_id: int) -> None:
        latest_by_key(batch, ["incident_id"], order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_batches(updates, store)
    return latest_by_key(spark.read.parquet(path).drop("batch"), ["incident_id"], order)
