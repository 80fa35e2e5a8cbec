"""Functions over root-cause texts, stored model responses, trigger contexts and dialog slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logspark.functions.text import LINE_END, strip
from logspark.functions.vectors import let

# Accepted status words.
STATUSES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "HEALTHY")
# Fixed value: spoken text when a report has no summary.
NO_SUMMARY = "An incident has been detected. Check your email for details."
# Fixed value: spoken follow-up to the first briefing of a session.
BRIEFING_PROMPT = "I am here to help you investigate. What would you like to know?"

# Resource name parts and the metric namespace they point to, tried in order.
NAMESPACES = (
    (("rds", "database", "db"), "AWS/RDS"),
    (("lambda", "function"), "AWS/Lambda"),
    (("ec2", "instance"), "AWS/EC2"),
    (("ecs", "container", "service"), "AWS/ECS"),
    (("api", "gateway"), "AWS/ApiGateway"),
    (("elb", "load", "balancer"), "AWS/ELB"),
)
DEFAULT_NAMESPACE = "AWS/EC2"
# Resource name parts and the dimension key they point to, tried in order.
DIMENSIONS = ((("rds", "database", "db"), "DBInstanceIdentifier"), (("lambda", "function"), "FunctionName"))
DEFAULT_DIMENSION = "InstanceId"

PLAN_SCHEMA = """
metrics array<struct<query_key:string, namespace:string, metric_name:string, dimensions:map<string,string>,
                     stat:string, period_minutes:bigint>>,
log_queries array<struct<query_key:string, log_group:string, filter_pattern:string, lookback_minutes:bigint>>,
status_checks array<struct<query_key:string, resource_type:string, resource_id:string>>,
resource_lookups array<struct<query_key:string, service:string, operation:string, params:string>>
"""
REPORT_SCHEMA = """
severity string, root_cause string, affected_components array<string>, evidence array<string>,
next_steps array<string>, confidence double
"""

ANALYSIS_PROMPT = """Analyze this error log and provide a JSON response with these exact fields:
{
  "severity": "CRITICAL|HIGH|WARNING|INFO",
  "root_cause": "short description",
  "affected_components": ["component1", "component2"],
  "evidence": ["evidence1", "evidence2"],
  "next_steps": ["step1", "step2"],
  "confidence": 0.0-1.0
}

Log text:
%s

Respond ONLY with valid JSON, no markdown, no extra text."""


def _any_of(text: Column, parts: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | text.contains(part)
    return hit


def _stripped_lines(text: Column) -> Column:
    return F.transform(F.split(text, LINE_END), strip)


def rca_severity(rca: Column) -> Column:
    """Status word of the first status line that holds a known one, else ``Unknown``."""
    upper = F.transform(_stripped_lines(rca), F.upper)
    status = F.transform(
        F.filter(upper, lambda x: x.startswith("STATUS:")), lambda x: strip(F.replace(x, F.lit("STATUS:"), F.lit("")))
    )
    known = F.filter(status, lambda x: x.isin(*STATUSES))
    return F.coalesce(F.initcap(F.try_element_at(known, F.lit(1))), F.lit("Unknown"))


def rca_is_healthy(rca: Column) -> Column:
    """Whether any status line contains HEALTHY. UNHEALTHY contains it too and counts, as in the original."""
    return F.exists(
        _stripped_lines(rca), lambda x: F.upper(x).startswith("STATUS:") & F.upper(x).contains("HEALTHY")
    )


def rca_spoken_summary(rca: Column) -> Column:
    lines = _stripped_lines(rca)

    def field(label: str) -> Column:
        hit = F.try_element_at(F.filter(lines, lambda x: x.startswith(label)), F.lit(1))
        return strip(F.substring(hit, len(label) + 1, 2_147_483_647))

    return F.coalesce(field("SPOKEN SUMMARY:"), field("SUMMARY:"), F.lit(NO_SUMMARY))


def guess_namespace(resource: Column) -> Column:
    hint = F.lower(resource)
    chain = F
    for parts, name in NAMESPACES:
        chain = chain.when(_any_of(hint, parts), F.lit(name))
    return chain.otherwise(F.lit(DEFAULT_NAMESPACE))


def guess_dimensions(resource: Column) -> Column:
    """Map of one dimension; an empty name gives an empty map."""
    hint = F.lower(resource)
    chain = F
    for parts, name in DIMENSIONS:
        chain = chain.when(_any_of(hint, parts), F.lit(name))
    pair = F.create_map(chain.otherwise(F.lit(DEFAULT_DIMENSION)), resource)
    return F.when(resource == "", F.create_map().cast("map<string,string>")).otherwise(pair)


def trigger_context(kind: Column, alarm: Column, reason: Column) -> Column:
    """Newline-joined description of a trigger."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Trigger type: "), kind),
        F.when(alarm != "", F.concat(F.lit("Alarm: "), alarm)),
        F.when(reason != "", F.concat(F.lit("Reason: "), reason)),
        F.when(kind == "schedule", F.lit("This is a scheduled scan, not triggered by a specific alarm.")),
    )


def trigger_label(kind: Column, alarm: Column) -> Column:
    name = F.coalesce(F.nullif(alarm, F.lit("")), F.lit("Unknown"))
    return (
        F.when(kind == "alarm", F.concat(F.lit("Alarm: "), name))
        .when(kind == "subscription", F.lit("Subscription filter match"))
        .otherwise(F.lit("Scheduled scan"))
    )


def strip_fence(raw: Column) -> Column:
    """A reply without its Markdown code fence and ``json`` tag."""
    def inside(text: Column) -> Column:
        inner = F.regexp_replace(F.get(F.split(text, "```"), F.lit(1)), "^json", "")
        return F.when(text.startswith("```"), strip(inner)).otherwise(text)

    return let(strip(raw), inside)


def drop_fence_lines(raw: Column) -> Column:
    """A reply without any line that opens or closes a code fence, if it starts with one."""
    def inside(text: Column) -> Column:
        kept = F.filter(F.split(text, "\n"), lambda x: ~strip(x).startswith("```"))
        return F.when(text.startswith("```"), F.array_join(kept, "\n")).otherwise(text)

    return let(strip(raw), inside)


def is_json(text: Column) -> Column:
    """Whether the text is one valid JSON value."""
    return F.try_parse_json(text).isNotNull()


def parse_report(raw: Column, fallback: Column) -> Column:
    """The stored triage reply as a struct.

    List fields default to empty and the confidence to 0.5. Without valid JSON, a known severity or a
    root cause the rule-based ``fallback`` struct (same fields) is taken.
    """
    empty = F.array().cast("array<string>")

    def report(got: Column) -> Column:
        full = F.struct(
            got["severity"].alias("severity"),
            got["root_cause"].alias("root_cause"),
            F.coalesce(got["affected_components"], empty).alias("affected_components"),
            F.coalesce(got["evidence"], empty).alias("evidence"),
            F.coalesce(got["next_steps"], empty).alias("next_steps"),
            F.coalesce(got["confidence"], F.lit(0.5)).alias("confidence"),
        )
        usable = got["severity"].isin("INFO", "WARNING", "HIGH", "CRITICAL") & got["root_cause"].isNotNull()
        return F.when(usable, full).otherwise(fallback)

    parsed = let(strip_fence(raw), lambda text: F.when(is_json(text), F.from_json(text, REPORT_SCHEMA)))
    return let(parsed, report)


def parse_plan(raw: Column) -> Column:
    """The stored look-up plan as a struct of four arrays; invalid JSON gives four empty arrays."""
    fields = ("metrics", "log_queries", "status_checks", "resource_lookups")
    plan = let(drop_fence_lines(raw), lambda text: F.when(is_json(text), F.from_json(text, PLAN_SCHEMA)))
    return let(plan, lambda p: F.struct(*[F.coalesce(p[f], F.array()).alias(f) for f in fields]))


def build_prompt(lines: Column, max_lines: int = 50) -> Column:
    """The fixed analysis prompt around the first lines of an array."""
    head, tail = ANALYSIS_PROMPT.split("%s")
    return F.concat(F.lit(head), F.array_join(F.slice(lines, 1, max_lines), "\n"), F.lit(tail))


def section_label(group: Column, reduced: Column, share: Column) -> Column:
    """Header of one log section; the share is printed as a whole percentage, halves to even."""
    percent = F.bround(share.cast("decimal(20,10)") * 100, 0).cast("bigint").cast("string")
    return F.when(
        reduced & share.isNotNull(), F.concat(F.lit("["), group, F.lit("] (reduced to top "), percent, F.lit("%)"))
    ).otherwise(F.concat(F.lit("["), group, F.lit("] (full logs)")))


def infer_severity(is_critical: Column, needs_escalation: Column, confidence: Column) -> Column:
    critical, escalate = F.coalesce(is_critical, F.lit(False)), F.coalesce(needs_escalation, F.lit(False))
    return (
        F.when(~critical & ~escalate, "INFO")
        .when(~critical, "WARNING")
        .when(confidence.isNull() | (confidence < 0.8), "HIGH")
        .otherwise("CRITICAL")
    )


def concat_record_logs(logs: Column) -> Column:
    """Join an array of JSON log entries with spaces.

    A string entry counts as it is; of an object the first of ``message``, ``text``, ``log`` is taken.
    """
    def entry(value: Column) -> Column:
        named = [F.try_variant_get(value, f"$.{key}", "string") for key in ("message", "text", "log")]
        plain = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
        return F.coalesce(plain, *named)

    # Each entry is parsed once, and not once a field.
    return F.array_join(F.transform(F.transform(logs, lambda item: F.try_parse_json(item)), entry), " ")


def slot_values(slots: Column) -> Column:
    """Non-empty interpreted values of a JSON slot map, in map order."""
    parsed = F.from_json(slots, "map<string, struct<value: struct<interpretedValue: string>>>")
    values = F.transform(F.map_values(parsed), lambda s: s["value"]["interpretedValue"])
    return F.filter(values, lambda v: v.isNotNull())


def slot_text(slots: Column) -> Column:
    """The slot values joined with spaces, in lower case."""
    return F.lower(F.array_join(slot_values(slots), " "))


def slot_value(slots: Column, name: str) -> Column:
    """One slot's interpreted value, or an empty string."""
    return F.coalesce(F.get_json_object(slots, f"$.{name}.value.interpretedValue"), F.lit(""))
