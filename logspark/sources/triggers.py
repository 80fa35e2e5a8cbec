"""Trigger events: pushed log payloads, alarms and schedules."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PAYLOAD = "logGroup string, logEvents array<struct<id: string, timestamp: bigint, message: string>>"
LOOKBACK_MINUTES = 30


@F.pandas_udf(StringType())
def _gunzip(data: pd.Series) -> pd.Series:
    def text(raw: bytes | None) -> str | None:
        try:
            return gzip.decompress(raw).decode("utf-8")
        except (OSError, EOFError, TypeError, UnicodeDecodeError):
            return None

    return data.map(text)


def decode_subscription(events: DataFrame, event: str = "event") -> DataFrame:
    """One row per pushed message: the other columns, ``log_group``, ``line_no``, ``timestamp_ms``, ``message``.

    ``event`` is a JSON text with ``awslogs.data`` = base64 of gzipped JSON. A broken payload gives no rows.
    """
    keep = [c for c in events.columns if c != event]
    packed = F.get_json_object(event, "$.awslogs.data")
    payload = F.from_json(_gunzip(F.try_to_binary(packed, F.lit("base64"))), PAYLOAD)
    rows = events.filter(packed.isNotNull()).select(*keep, payload.alias("_p"))
    return rows.select(
        *keep,
        F.coalesce("_p.logGroup", F.lit("")).alias("log_group"),
        F.posexplode("_p.logEvents").alias("line_no", "_e"),
    ).select(
        *keep,
        "log_group",
        F.col("line_no").cast("bigint").alias("line_no"),
        F.col("_e.timestamp").alias("timestamp_ms"),
        F.coalesce("_e.message", F.lit("")).alias("message"),
    )


def route_trigger_events(events: DataFrame, event: str = "event", lookback: int = LOOKBACK_MINUTES) -> DataFrame:
    """Add ``trigger_type, alarm_name, alarm_reason, lookback_minutes`` to JSON trigger events."""
    parsed = F.try_parse_json(event)

    def text(path: str):
        return F.try_variant_get(parsed, path, "string")

    pushed = F.get_json_object(event, "$.awslogs").isNotNull()
    alarm = F.coalesce(F.get_json_object(event, "$['detail-type']"), F.lit("")).contains("CloudWatch Alarm")
    kind = F.when(pushed, "subscription").when(alarm, "alarm").otherwise("schedule")
    rows = events.withColumn("trigger_type", kind)
    is_alarm = F.col("trigger_type") == "alarm"
    return rows.select(
        *events.columns,
        "trigger_type",
        F.when(is_alarm, F.coalesce(text("$.detail.alarmName"), F.lit("Unknown"))).alias("alarm_name"),
        F.when(is_alarm, F.coalesce(text("$.detail.state.reason"), F.lit(""))).alias("alarm_reason"),
        F.when(F.col("trigger_type") != "subscription", F.lit(lookback).cast("bigint")).alias("lookback_minutes"),
    )
