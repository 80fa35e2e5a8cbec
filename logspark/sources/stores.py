"""Stored tables: incidents, feedback, calibrations, alerts, notifications, training sets."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from logspark.functions.reports import is_json, trigger_label
from logspark.functions.rules import SEVERITIES

# Days, days and hours after which a stored record expires.
INCIDENT_TTL_DAYS = 7
FEEDBACK_TTL_DAYS = 90
ALERT_TTL_HOURS = 24
ALERT_PROBABILITY = 0.3
SUBJECT_CHARS = 100

FEEDBACK = """
feedback_id string, incident_id string, suggestion string, suggestion_quality int, relevance_score double,
was_helpful boolean, engineer_comments string, overall_satisfaction int, timestamp string,
call_duration_seconds int, incident_severity string
"""


def _untag(value):
    for tag in ("S", "N"):
        if tag in value:
            return value[tag]
    if "L" in value:
        return [_untag(v) for v in value["L"]]
    if "M" in value:
        return {k: _untag(v) for k, v in value["M"].items()}
    return value


@F.pandas_udf(StringType())
def _plain_item(items: pd.Series) -> pd.Series:
    def plain(text: str | None) -> str | None:
        try:
            return json.dumps({k: _untag(v) for k, v in json.loads(text).items()}, ensure_ascii=False)
        except (ValueError, TypeError, AttributeError):
            return None

    return items.map(plain)


def import_incident_export(items: DataFrame, item: str = "item") -> DataFrame:
    """Incidents from tagged attribute values (``S``, ``N``, ``L``, ``M``), one JSON item per row.

    Numbers stay strings. ``cached_data`` keeps its raw text in ``cached_raw`` and is decoded to a
    VARIANT only where it is valid JSON. Unreadable items are dropped.
    """
    keep = [c for c in items.columns if c != item]
    plain = items.select(*keep, F.try_parse_json(_plain_item(F.col(item))).alias("_v")).filter("_v is not null")

    def text(name: str) -> Column:
        return F.try_variant_get("_v", f"$.{name}", "string")

    fields = ("incident_id", "rca", "trigger_type", "timestamp", "ttl", "prefetch_status", "alarm_name", "alarm_reason")
    return plain.select(
        *keep,
        *[text(f).alias(f) for f in fields],
        F.try_variant_get("_v", "$.log_groups", "array<string>").alias("log_groups"),
        text("cached_data").alias("cached_raw"),
        F.try_parse_json(text("cached_data")).alias("cached_data"),
        F.col("_v").alias("item"),
    )


def parse_feedback(lines: DataFrame, value: str = "value") -> DataFrame:
    """Feedback rows from JSON lines; invalid lines are dropped and missing fields get their defaults."""
    rows = lines.filter(is_json(F.col(value))).select(F.from_json(value, FEEDBACK).alias("f")).select("f.*")
    defaults = {
        "feedback_id": "",
        "incident_id": "",
        "suggestion": "",
        "suggestion_quality": 5,
        "relevance_score": 0.5,
        "was_helpful": False,
        "overall_satisfaction": 5,
    }
    return rows.fillna(defaults)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return parse_feedback(spark.read.text(path))


def append_feedback(feedback: DataFrame, path: str) -> None:
    feedback.write.mode("append").json(path)


def new_incidents(analyses: DataFrame, ttl_days: int = INCIDENT_TTL_DAYS) -> DataFrame:
    """Incident records for analyses with a ``ts``: status ``pending`` and an expiry time in seconds."""
    expiry = F.unix_seconds("ts") + ttl_days * 86_400
    return analyses.withColumns({"prefetch_status": F.lit("pending"), "ttl": expiry})


def upsert_incidents(incidents: DataFrame, updates: DataFrame) -> DataFrame:
    """Current incidents after updates ``incident_id, ts, cached_data, prefetch_status``; the newest update wins."""
    newest = updates.groupBy("incident_id").agg(
        F.max_by(F.struct("cached_data", "prefetch_status"), F.struct("ts", "prefetch_status")).alias("_u")
    )
    kept = [c for c in incidents.columns if c not in ("cached_data", "prefetch_status")]
    old = F.col("cached_data") if "cached_data" in incidents.columns else F.lit(None).cast("string")
    return incidents.join(newest, "incident_id", "left").select(
        *kept,
        F.when(F.col("_u").isNull(), old).otherwise(F.col("_u.cached_data")).alias("cached_data"),
        F.coalesce("_u.prefetch_status", "prefetch_status").alias("prefetch_status"),
    )


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key. Each task sends one row per key, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return newest.select(*keys, "_r.*")


def live_rows(df: DataFrame, now: Column, ttl: str = "ttl") -> DataFrame:
    """Rows whose expiry (epoch seconds) lies after ``now``."""
    return df.filter(F.col(ttl) > F.unix_seconds(now))


def forecast_alerts(forecasts: DataFrame, now: Column) -> DataFrame:
    """Alert rows for forecasts whose breach probability is above 0.3."""
    return forecasts.filter(F.col("breach_probability") > ALERT_PROBABILITY).withColumns(
        {"ttl": F.unix_seconds(now) + ALERT_TTL_HOURS * 3600}
    )


def notifications(analyses: DataFrame, app: str = "Logspark") -> DataFrame:
    """Subject (cut to 100 characters) and body for ``trigger_type, alarm_name, ts, analysis``."""
    label = trigger_label(F.col("trigger_type"), F.col("alarm_name"))
    body = F.concat(
        F.lit("Trigger: "), label, F.lit("\nTime: "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00\n\n"), "analysis"
    )
    return analyses.withColumns(
        {"subject": F.substring(F.concat(F.lit(f"{app} - "), label), 1, SUBJECT_CHARS), "body": body}
    )


def label_distribution(rows: DataFrame, label: str = "label", labels: Sequence[str] = SEVERITIES) -> DataFrame:
    """Count of every label, with 0 for labels that do not occur."""
    counts = rows.agg(*[F.count_if(F.col(label) == name).alias(name) for name in labels])
    pairs = F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("count")) for n in labels])
    return counts.select(F.inline(pairs))


def write_dataset(rows: DataFrame, path: str) -> None:
    """Write texts and labels as JSON lines, and the label counts beside them."""
    rows.select("text", "label").write.mode("overwrite").json(f"{path}/samples")
    # Counted from what was written, so that rows are made once.
    written = rows.sparkSession.read.schema("label string").json(f"{path}/samples")
    label_distribution(written).write.mode("overwrite").json(f"{path}/label_distribution")
