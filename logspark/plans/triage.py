"""Triage of log sources: detect, classify, root cause, explain, merge; one row per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.rules import (
    CAUSE_RULES,
    NEXT_STEPS,
    RULE_MODEL,
    SEVERITY_GATE,
    SIGNALS,
    keyword_severity,
    merge_severity,
    pick,
    rule_root_cause,
)
from logspark.operators.anomaly import detect_cascade, first_anomalies
from logspark.operators.explain import rule_flags, signal_labels
from logspark.operators.ordering import number_rows
from logspark.session import save_and_read

# Anomalous lines read by the severity rules, by profile, and by the library's cause rules.
SEVERITY_LINES = {"library": 40, "service": 30}
CAUSE_LINES = 50
EVIDENCE_LINES = 3
EMPTY_CAUSE = "No logs provided"


def _cause_of(index: Column, profile: str) -> Column:
    """The cause of a matched rule; null is the default rule."""
    rules = CAUSE_RULES[profile]
    at = F.coalesce(index, F.lit(len(rules) - 1))
    return F.struct(
        pick(at, [r.label for r in rules]).alias("root_cause"),
        pick(at, [r.severity for r in rules]).alias("severity"),
        pick(at, [r.confidence for r in rules]).alias("confidence"),
        F.array(*[F.lit(s) for s in NEXT_STEPS[profile][0]]).alias("next_steps"),
        F.lit(RULE_MODEL[profile][0]).alias("model_used"),
    )


def _service_causes(detected: DataFrame) -> DataFrame:
    """``source_id, _rule``: the first service rule found in all anomalous lines, joined with spaces."""
    found = detected.filter("is_anomaly").withColumnRenamed("line_no", "_at")
    joined = number_rows(found, ["source_id"], F.col("_at"), F.col("_at")).select("source_id", "line_no", "line")
    flags, names = rule_flags(joined, CAUSE_RULES["service"])
    return flags.select("source_id", F.coalesce(*[F.when(F.col(n), F.lit(i)) for i, n in enumerate(names)]).alias("_rule"))


def triage_detected(detected: DataFrame, profile: str = "library", gate: float | None = None, explain: bool = True) -> DataFrame:
    """Triage lines that already carry ``is_anomaly``; see :func:`triage`.

    Counts, first line and signal flags of a source come from one aggregate over the lines; only its
    first anomalous lines are collected.
    """
    facts = [
        F.count(F.lit(1)).alias("total_line_count"),
        F.count_if("is_anomaly").alias("anomalous_line_count"),
        F.min_by("line", "line_no").alias("_opening"),
    ]
    per_source, names = rule_flags(detected, SIGNALS if explain else (), facts)
    kept = max(SEVERITY_LINES[profile], CAUSE_LINES)
    out = per_source.join(first_anomalies(detected, kept), "source_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("_lines", F.coalesce("_lines", none))

    def text(n: int) -> Column:
        return F.when(F.size("_lines") > 0, F.array_join(F.slice("_lines", 1, n), "\n")).otherwise(F.col("_opening"))

    if profile == "library":
        cause = rule_root_cause(text(CAUSE_LINES))
    else:
        out = out.join(_service_causes(detected), "source_id", "left")
        cause = _cause_of(F.col("_rule"), profile)
    out = out.withColumns({"_cause": cause, "_sev": keyword_severity(text(SEVERITY_LINES[profile]), profile)})
    final = merge_severity(
        F.col("_sev.severity"), F.col("_sev.confidence"), F.col("_cause.severity"), F.col("_cause.confidence"),
        SEVERITY_GATE[profile] if gate is None else gate,
    )
    signals = F.when(F.col("anomalous_line_count") > 0, signal_labels(names, SIGNALS)).otherwise(none) if explain else none
    service = profile == "service"
    return out.withColumn("_final", final).select(
        "source_id",
        "_final.severity",
        "_cause.root_cause",
        (F.array(F.lit("unknown")) if service else none).alias("affected_components"),
        (F.slice("_lines", 1, EVIDENCE_LINES) if service else none).alias("evidence"),
        "_cause.next_steps",
        "_final.confidence",
        "anomalous_line_count",
        "total_line_count",
        signals.alias("top_signals"),
        "_cause.model_used",
    )


def triage(
    lines: DataFrame, sources: DataFrame | None = None, registry: DataFrame | None = None, scorers: dict | None = None,
    profile: str = "library", gate: float | None = None, explain: bool = True,
) -> DataFrame:
    """Triage log lines ``source_id, line_no, line``.

    Sources listed in ``sources`` that have no lines are reported as INFO with confidence 0.5. The
    detection result is written once below the shared folder, as several aggregates read it.
    """
    wanted = ["source_id", "line_no", "line", "is_anomaly"]
    detected = save_and_read(detect_cascade(lines, registry, scorers, profile).select(*wanted), "detected")
    found = triage_detected(detected, profile, gate, explain)
    if sources is None:
        return found
    none = F.array().cast("array<string>")
    blank = {
        "severity": F.lit("INFO"),
        "root_cause": F.lit(EMPTY_CAUSE),
        "affected_components": none,
        "evidence": none,
        "next_steps": none,
        "confidence": F.lit(0.5),
        "anomalous_line_count": F.lit(0).cast("bigint"),
        "total_line_count": F.lit(0).cast("bigint"),
        "top_signals": none,
        "model_used": F.lit("unknown"),
    }
    listed = sources.select("source_id").distinct().join(found, "source_id", "left")
    return listed.select("source_id", *[F.coalesce(F.col(c), v).alias(c) for c, v in blank.items()])
