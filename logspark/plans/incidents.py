"""Incident work: run planned look-ups, store their results, answer questions, build training sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.reports import guess_dimensions, guess_namespace, parse_plan, slot_value
from logspark.operators.lookups import (
    match_cached_query,
    metric_datapoints,
    prefetch_union,
    run_log_specs,
    run_metric_specs,
    run_status_specs,
)
from logspark.operators.ordering import first_rows
from logspark.operators.training import training_rows
from logspark.session import save_and_read
from logspark.sources.stores import import_incident_export, upsert_incidents

# Characters of data in an answer, its end mark, and the text without data.
ANSWER_CHARS = 8000
CUT_MARK = "... (truncated)"
NO_DATA = "No data available."
# Question kinds and the cache category they read; others read everything.
CATEGORIES = {"CheckMetrics": "metrics", "CheckLogs": "logs", "CheckStatus": "status"}


def plan_specs(plans: DataFrame, raw: str = "reply") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metric, log and status specs of stored plan replies ``incident_id, end_ts, reply``."""
    # Parsed once into a table, as every look-up reads its specs more than once.
    parsed = save_and_read(plans.select("incident_id", "end_ts", parse_plan(F.col(raw)).alias("_p")), "plans")

    def specs(name: str) -> DataFrame:
        rows = parsed.select("incident_id", "end_ts", F.inline(f"_p.{name}"))
        return rows.withColumn("query_key", F.coalesce("query_key", F.lit("")))

    return specs("metrics"), specs("log_queries"), specs("status_checks")


def run_plans(plans: DataFrame, metrics: DataFrame, events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Results of all look-ups planned for each incident: ``incident_id, category, query_key, result``."""
    metric_specs, log_specs, status_specs = plan_specs(plans)
    return prefetch_union(
        metric_datapoints(metric_specs, metrics), run_log_specs(log_specs, events), run_status_specs(status_specs, snapshots)
    )


def incident_prefetch(incidents: DataFrame, plans: DataFrame, metrics: DataFrame, events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Incidents with their cached look-up results.

    A plan holds at most about ten look-ups, so an incident's results fit one row. Incidents without a
    stored reply are ``failed``; an unreadable reply is an empty plan and ``complete``.
    """
    results = run_plans(plans, metrics, events, snapshots)
    packed = results.groupBy("incident_id").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("category", "query_key", "result")))).alias("cached_data")
    )
    replied = plans.select("incident_id", "end_ts", F.col("reply").isNotNull().alias("_ok"))
    updates = replied.join(packed, "incident_id", "left").select(
        "incident_id",
        F.col("end_ts").alias("ts"),
        F.coalesce("cached_data", F.lit("[]")).alias("cached_data"),
        F.when(F.col("_ok"), "complete").otherwise("failed").alias("prefetch_status"),
    )
    return upsert_incidents(incidents, updates)


def answer_context(questions: DataFrame, items: DataFrame, metrics: DataFrame, end_ts: Column) -> DataFrame:
    """``question_id, source, data``: the data for each question, cut to 8000 characters.

    ``questions`` holds ``question_id, incident_id, intent, slots``; ``items`` holds the cached results
    ``incident_id, category, pos, query_key, result``. Metric, log and status questions take the cached
    item that fits best. A metric question without any cached item reads the last hour of the metric
    named in its slots. All other questions get every cached item of their incident.
    """
    chain = F
    for intent, category in CATEGORIES.items():
        chain = chain.when(F.col("intent") == intent, F.lit(category))
    asked = questions.withColumn("category", chain.otherwise(F.lit(None).cast("string")))
    single = asked.filter("category is not null")
    hits = match_cached_query(single, items).select("question_id", F.lit("cache").alias("source"), F.col("result").alias("data"))

    missed = single.filter("category = 'metrics'").join(hits, "question_id", "left_anti")
    resource = slot_value(F.col("slots"), "resource")
    metric = F.coalesce(F.nullif(slot_value(F.col("slots"), "metric"), F.lit("")), F.lit("CPUUtilization"))
    specs = missed.select(
        F.col("question_id").alias("incident_id"), F.lit("").alias("query_key"), guess_namespace(resource).alias("namespace"),
        metric.alias("metric_name"), guess_dimensions(resource).alias("dimensions"), F.lit("Average").alias("stat"),
        F.lit(60).cast("bigint").alias("period_minutes"), end_ts.alias("end_ts"),
    )
    points = run_metric_specs(specs, metrics).groupBy(F.col("incident_id").alias("question_id")).agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("bucket", "value")))).alias("data")
    )
    live = points.select("question_id", F.lit("table").alias("source"), "data")

    # An item takes three characters at least ("{}" and a comma), so these fill the part that is kept.
    few = first_rows(items, ["incident_id"], [F.asc("category"), F.asc("pos"), F.asc("query_key"), F.asc("result")], ANSWER_CHARS // 3 + 1)
    everything = few.groupBy("incident_id").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("category", "pos", "query_key", "result")))).alias("data")
    )
    rest = asked.filter("category is null").join(everything, "incident_id").select("question_id", F.lit("cache").alias("source"), "data")
    found = hits.unionByName(live).unionByName(rest)
    cut = F.when(F.char_length("data") > ANSWER_CHARS, F.concat(F.substring("data", 1, ANSWER_CHARS), F.lit(CUT_MARK))).otherwise(F.col("data"))
    return questions.select("question_id").join(found, "question_id", "left").select(
        "question_id", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce(cut, F.lit(NO_DATA)).alias("data")
    )


def briefing_once(turns: DataFrame, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``turns`` with ``briefing``: whether it is the first turn of its session. Each task sends one number a session, so a long session is no hot task.

    Turns without a number, or without a session, get no briefing; several rows of the first number all get it.
    """
    first = turns.groupBy(F.col(session).alias("_session")).agg(F.min(turn).alias("_first"))
    joined = turns.join(first, F.col(session) == F.col("_session"), "left")
    return joined.withColumn("briefing", F.coalesce(F.col(turn) == F.col("_first"), F.lit(False))).drop("_session", "_first")


def training_data(export: DataFrame) -> DataFrame:
    """``record_id, text, label`` from exported triage records, one tagged JSON item per row in ``item``."""
    items = import_incident_export(export)

    def flag(name: str) -> Column:
        tagged = F.try_variant_get("item", f"$.{name}.BOOL", "boolean")
        return F.coalesce(tagged, F.try_variant_get("item", f"$.{name}", "string") == "true", F.lit(False))

    records = items.select(
        F.col("incident_id").alias("record_id"),
        F.transform(F.try_variant_get("item", "$.anomalous_logs", "array<variant>"), lambda v: F.to_json(v)).alias("anomalous_logs"),
        flag("is_critical").alias("is_critical"),
        flag("needs_escalation").alias("needs_escalation"),
        F.try_variant_get("item", "$.confidence", "double").alias("confidence"),
    )
    return training_rows(records)
