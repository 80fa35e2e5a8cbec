"""Keyword rules: fixed rule lists, rules from a table, and the columns they compile to."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """One rule; it matches when the lower-cased text contains any keyword."""

    keywords: tuple[str, ...]
    label: str
    severity: str | None = None
    confidence: float | None = None


# Keyword and the signal it points to, in reporting order.
SIGNALS = (
    Rule(("oom",), "Out of memory"),
    Rule(("out of memory",), "Out of memory"),
    Rule(("killed",), "Process killed"),
    Rule(("segfault",), "Segmentation fault"),
    Rule(("connection refused",), "Network failure"),
    Rule(("timeout",), "Timeout"),
    Rule(("exception",), "Unhandled exception"),
    Rule(("traceback",), "Python traceback"),
    Rule(("null pointer",), "Null reference"),
    Rule(("disk full",), "Storage exhausted"),
    Rule(("permission denied",), "Auth failure"),
    Rule(("certificate",), "TLS/cert issue"),
    Rule(("deadlock",), "Thread deadlock"),
    Rule(("panic",), "System panic"),
    Rule(("fatal",), "Fatal error"),
    Rule(("critical",), "Critical condition"),
)

# Keyword groups per severity, first match wins; the last rule is the default.
SEVERITY_RULES = {
    "library": (
        Rule(("fatal", "oom", "out of memory", "segfault", "panic"), "CRITICAL", "CRITICAL", 0.7),
        Rule(("error", "exception", "failed", "connection refused"), "HIGH", "HIGH", 0.65),
        Rule(("warn", "warning", "slow", "timeout"), "WARNING", "WARNING", 0.6),
        Rule((), "INFO", "INFO", 0.55),
    ),
    "service": (
        Rule(("fatal", "critical", "oom", "panic", "crash"), "CRITICAL", "CRITICAL", 0.7),
        Rule(("error", "exception", "failed", "refused"), "HIGH", "HIGH", 0.65),
        Rule(("warn", "slow", "retry", "degraded"), "WARNING", "WARNING", 0.6),
        Rule((), "INFO", "INFO", 0.55),
    ),
}

# Class scores (INFO, WARNING, HIGH, CRITICAL) by predicted severity.
SEVERITY_SCORES = {
    "CRITICAL": (0.0, 0.1, 0.2, 0.7),
    "HIGH": (0.0, 0.15, 0.65, 0.2),
    "WARNING": (0.1, 0.6, 0.2, 0.1),
    "INFO": (0.55, 0.3, 0.1, 0.05),
}
SEVERITIES = ("INFO", "WARNING", "HIGH", "CRITICAL")

# Keyword, cause, severity and confidence, first match wins; the last rule is the default.
CAUSE_RULES = {
    "library": (
        Rule(("oom",), "out of memory", "CRITICAL", 0.7),
        Rule(("killed",), "process killed", "CRITICAL", 0.7),
        Rule(("connection refused",), "network failure", "HIGH", 0.65),
        Rule(("connection reset",), "network failure", "HIGH", 0.65),
        Rule(("timeout",), "timeout", "HIGH", 0.65),
        Rule(("exception",), "unhandled exception", "HIGH", 0.65),
        Rule(("traceback",), "python exception", "HIGH", 0.65),
        Rule(("segfault",), "segmentation fault", "CRITICAL", 0.7),
        Rule(("panic",), "system panic", "CRITICAL", 0.7),
        Rule(("fatal",), "fatal error", "CRITICAL", 0.7),
        Rule((), "Unknown error detected", "WARNING", 0.5),
    ),
    "service": (
        Rule(("oom", "out of memory", "killed"), "Out of memory — process killed by OOM", "CRITICAL", 0.4),
        Rule(("connection refused", "timeout", "unreachable"), "Network connectivity failure detected", "HIGH", 0.4),
        Rule(("exception", "error", "traceback"), "Unhandled exception in application", "HIGH", 0.4),
        Rule(("warn", "deprecated"), "Non-critical warning detected", "WARNING", 0.4),
        Rule((), "Anomalous log pattern detected", "INFO", 0.4),
    ),
}
# Next steps for a matched rule and for the default, by profile.
NEXT_STEPS = {
    "library": (
        ("Investigate the issue", "Check logs for more details"),
        ("Review the anomalous logs", "Check system metrics"),
    ),
    "service": (("Review full logs", "Check system metrics", "Escalate if persists"),) * 2,
}
# Model names for a matched rule and for the default, by profile.
RULE_MODEL = {"library": ("fallback-rules", "fallback-default"), "service": ("rule-based-fallback",) * 2}

MAX_RULES = 1000


def rules_from_table(table: DataFrame) -> tuple[Rule, ...]:
    """Read rules from columns ``rule_id, priority, keyword, label, severity, confidence``.

    Rules become one column expression, so a table of more than ``MAX_RULES`` rows is refused; :mod:`logspark.operators.rule_tables`
    takes tables of any size as they are.
    """
    rows = table.orderBy("priority", "rule_id").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"a rule table may hold at most {MAX_RULES} rules")
    return tuple(
        Rule((r["keyword"].lower(),) if r["keyword"] else (), r["label"], r["severity"], r["confidence"]) for r in rows
    )


def matches(text: Column, rule: Rule) -> Column:
    """Whether lower-cased ``text`` contains a keyword; a rule without keywords always matches."""
    if not rule.keywords:
        return F.lit(True)
    hit = F.lit(False)
    for keyword in rule.keywords:
        hit = hit | text.contains(keyword)
    return hit


def first_match(text: Column, rules: Sequence[Rule]) -> Column:
    """Index of the first matching rule, or null."""
    lowered = F.lower(text)
    return F.coalesce(*[F.when(matches(lowered, rule), F.lit(i)) for i, rule in enumerate(rules)])


def pick(index: Column, values: Sequence) -> Column:
    """The value at ``index`` of a fixed list."""
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def keyword_severity(text: Column, profile: str = "library", rules: Sequence[Rule] | None = None) -> Column:
    """Struct of severity label, confidence and the four class scores of a text."""
    rules = rules or SEVERITY_RULES[profile]
    index = first_match(text, rules)
    if profile == "library":
        table = [SEVERITY_SCORES[r.severity] for r in rules]
    else:
        table = [tuple(r.confidence if s == r.severity else 0.1 for s in SEVERITIES) for r in rules]
    scores = F.get(F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in table]), index)
    return F.struct(
        pick(index, [r.severity for r in rules]).alias("severity"),
        pick(index, [r.confidence for r in rules]).alias("confidence"),
        F.map_from_arrays(F.array(*[F.lit(s) for s in SEVERITIES]), scores).alias("scores"),
    )


def rule_root_cause(text: Column, profile: str = "library", rules: Sequence[Rule] | None = None) -> Column:
    """Struct of root cause, severity, confidence, next steps and model name of a text."""
    rules = rules or CAUSE_RULES[profile]
    index = first_match(text, rules)
    default = ~F.lit(True) if rules[-1].keywords else index == len(rules) - 1
    hit, other = (F.array(*[F.lit(s) for s in steps]) for steps in NEXT_STEPS[profile])
    return F.struct(
        pick(index, [r.label for r in rules]).alias("root_cause"),
        pick(index, [r.severity for r in rules]).alias("severity"),
        pick(index, [r.confidence for r in rules]).alias("confidence"),
        F.when(default, other).otherwise(hit).alias("next_steps"),
        F.when(default, RULE_MODEL[profile][1]).otherwise(RULE_MODEL[profile][0]).alias("model_used"),
    )


# The classifier's severity is taken above this confidence.
SEVERITY_GATE = {"library": 0.82, "service": 0.8}


def merge_severity(
    class_severity: Column, class_confidence: Column, cause_severity: Column, cause_confidence: Column, gate: float = 0.82
) -> Column:
    """Struct of the final severity and confidence."""
    return F.struct(
        F.when(class_confidence > gate, class_severity).otherwise(cause_severity).alias("severity"),
        F.greatest(class_confidence, cause_confidence).alias("confidence"),
    )


def filter_pattern(message: Column, pattern: str) -> Column:
    """Term patterns: all plain terms, or any of the terms marked with ``?``; empty matches all."""
    terms = pattern.split()
    wanted = [message.contains(t.strip('"')) for t in terms if not t.startswith("?")]
    either = [message.contains(t[1:].strip('"')) for t in terms if t.startswith("?")]
    hit = F.lit(True)
    for condition in wanted:
        hit = hit & condition
    if either:
        some = F.lit(False)
        for condition in either:
            some = some | condition
        hit = hit & some
    return hit


def matches_pattern(message: Column, pattern: Column) -> Column:
    """:func:`filter_pattern` for patterns held in a column."""
    terms = F.filter(F.split(F.trim(pattern), r"\s+"), lambda t: t != "")
    plain = F.filter(terms, lambda t: ~t.startswith("?"))
    either = F.filter(terms, lambda t: t.startswith("?"))
    inside = lambda term: message.contains(F.replace(term, F.lit('"'), F.lit("")))
    some = (F.size(either) == 0) | F.exists(either, lambda t: inside(F.ltrim(t, F.lit("?"))))
    return F.forall(plain, inside) & some


# Beginnings of read-only operation names.
READ_ONLY = ("describe_", "get_", "list_")


def is_read_only(operation: Column) -> Column:
    """Whether a snake-case operation name only reads."""
    hit = F.lit(False)
    for start in READ_ONLY:
        hit = hit | operation.startswith(start)
    return hit
