"""Scan of many log sources under a token budget."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.reports import rca_is_healthy, section_label, trigger_context
from logspark.functions.rules import CAUSE_RULES, pick
from logspark.functions.text import estimate_tokens, format_log_line
from logspark.functions.vectors import hash_vector, line_template
from logspark.operators.budget import available_tokens, token_budget_plan
from logspark.operators.explain import rule_flags
from logspark.operators.ordering import number_rows, top_share
from logspark.operators.similarity import density_windows
from logspark.operators.windows import block_lines, merge_blocks
from logspark.session import save_and_read
from logspark.sources.lines import fetch_lookbacks, resolve_log_groups
from logspark.sources.stores import notifications
from logspark.sources.triggers import LOOKBACK_MINUTES, decode_subscription, route_trigger_events

# Window size and neighbours of the reduction.
REDUCE_WINDOW, REDUCE_NEIGHBOURS = 4, 5
#: Runs that one task gives the lines of a source to, about.
CUT_RUNS = 1024


def source_tokens(lines: DataFrame, keys: tuple[str, ...] = ("run_id", "log_group")) -> DataFrame:
    """Estimated tokens of each source's text (its lines joined by newlines), without joining it."""
    chars = F.sum(F.char_length("line")) + F.count(F.lit(1)) - 1
    return lines.groupBy(*keys).agg(F.floor(chars / 4).cast("bigint").alias("tokens"))


def _scored_windows(lines: DataFrame, dim: int) -> DataFrame:
    """``run_id, log_group, start, score`` of each source's 4-line windows."""
    worded = lines.withColumn("wording", line_template(F.col("line")))
    scored = density_windows(worded, REDUCE_WINDOW, 1, REDUCE_NEIGHBOURS, "wording", ["run_id", "log_group"], lambda words: hash_vector(words, dim))
    # Scores are rounded so that equal windows tie whatever order their terms were added in.
    return scored.withColumn("score", F.round("score", 9))


def reduce_sources(lines: DataFrame, shares: DataFrame, dim: int = 64) -> DataFrame:
    """The most unusual lines of each source: those in the best share of its 4-line windows.

    ``lines`` holds ``run_id, log_group, line_no, line``; ``shares`` holds ``run_id, log_group, share``.
    """
    keys = ["run_id", "log_group"]
    windows = save_and_read(_scored_windows(lines, dim).join(shares, keys), "windows")
    return block_lines(lines, top_share(windows, keys, F.col("share"), "score", "start"), REDUCE_WINDOW, keys)


def reduce_to_blocks(lines: DataFrame, shares: DataFrame, dim: int = 64) -> DataFrame:
    """:func:`reduce_sources` with ``block``: the header of the block of adjacent windows that a line lies in, lines counted from 1.

    ``shares`` also holds ``owner``, the run by whose name ``lines`` keeps the source; all its columns but ``owner`` and ``share`` are returned. Windows are
    scored and ranked once a source, blocks are made once for all runs that keep the same number of its windows.
    """
    keys = ["run_id", "log_group"]
    windows = save_and_read(_scored_windows(lines, dim), "windows")
    sizes = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("run_id", "owner")
    wanted = shares.join(sizes, ["owner", "log_group"]).withColumn("_goal", F.ceil(F.col("share") * F.col("_n"))).drop("_n")
    most = wanted.groupBy(F.col("owner").alias("run_id"), "log_group").agg(F.max("share").alias("share"))
    ranked = top_share(windows.join(most, keys), keys, F.col("share"), "score", "start", "_place")

    # A cut: the runs that keep as many windows of a source. Many of them are spread.
    cuts = wanted.groupBy(F.col("owner").alias("run_id"), "log_group", "_goal").agg(F.ceil(F.count(F.lit(1)) / CUT_RUNS).alias("_parts"))
    cut = [*keys, "_goal", "_parts"]
    cuts = save_and_read(cuts, "cuts")
    kept = cuts.withColumn("_place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_goal") - 1))).join(ranked, [*keys, "_place"])
    blocks = merge_blocks(save_and_read(kept.select(*cut, "start", "score"), "kept"), REDUCE_WINDOW, keys=cut)
    span = F.concat((F.col("line_start") + 1).cast("string"), F.lit("-"), (F.col("line_end") + 1).cast("string"))
    header = F.concat(F.lit('<anomalous_block lines="'), span, F.lit('" score="'), F.format_string("%.4f", "score"), F.lit('">'))
    each = blocks.select(*cut, header.alias("block"), F.explode(F.sequence("line_start", "line_end")).alias("line_no"))
    found = lines.join(each, [*keys, "line_no"]).withColumnRenamed("run_id", "owner")

    at = ["owner", "log_group", "_goal", "_part"]
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).drop("_parts")
    runs = wanted.join(cuts.withColumnRenamed("run_id", "owner"), at[:-1]).withColumn("_part", F.pmod(F.xxhash64("run_id"), F.col("_parts")))
    # The rows grow in this join, so its tasks are not to be made fewer by the size of what they read.
    met = runs.drop("share", "_parts").repartition(parts, *at).join(found.repartition(parts, *at), at)
    return met.drop("owner", "_goal", "_part")


def multi_source_scan(lines: DataFrame, budgets: DataFrame, dim: int = 64) -> DataFrame:
    """Plan and reduce the sources of each run: ``run_id, place, label, line_no, line``, in reading order.

    ``lines`` holds ``run_id, log_group, line_no, line`` of the sources fetched; ``budgets`` holds
    ``run_id, available``. Sources that fit keep every line; the others are reduced to their share. The
    text of a run is the lines of its sections by place and line number, each section under its label;
    it stays one row per line, as a run may be larger than one task can hold.
    """
    keys = ["run_id", "log_group"]
    plan = token_budget_plan(source_tokens(lines), budgets)
    label = section_label(F.col("log_group"), F.col("needs_reduction"), F.col("share"))
    plan = save_and_read(plan.withColumn("label", label), "plan")
    small = plan.filter(~F.col("needs_reduction")).select(*keys, "place", "label")
    large = plan.filter("needs_reduction").select(*keys, "place", "label", "share")
    whole = lines.join(small, keys)
    # Only sources over budget pay for vectors and neighbours.
    reduced = reduce_sources(lines.join(large.select(*keys), keys, "left_semi"), large.select(*keys, "share"), dim)
    columns = ["run_id", "place", "label", "line_no", "line"]
    return whole.select(*columns).unionByName(reduced.join(large.drop("share"), keys).select(*columns))


def notify_gate(analyses: DataFrame, healthy: Column, kind: str = "trigger_type") -> DataFrame:
    """Analyses to report: all but healthy scheduled ones."""
    return analyses.filter(~(healthy & (F.col(kind) == "schedule")))


class Sources(NamedTuple):
    """The sources of every run (``run_id, log_group, owner``), and the lines of each distinct one (``run_id, log_group, line_no, line``), kept by the name of its owner."""

    members: DataFrame
    lines: DataFrame


def fetch_sources(events: DataFrame, patterns: DataFrame, logs: DataFrame, lookback: int = LOOKBACK_MINUTES, slot_minutes: int = 30) -> Sources:
    """Every source that a trigger event asks for.

    ``events`` holds ``run_id, ts, event``; each asks for all groups that ``patterns`` resolve to among the groups of ``logs`` (``log_group, ts, seq, message``), up
    to ``ts``. Messages that come with a pushed event stand for its group's log. Groups without text have no lines. Runs that ask for the same times of a group
    share its lines, which are fetched once; the least of their ids is the owner.
    """
    routed = route_trigger_events(events.select("run_id", "ts", "event"), lookback=lookback)
    wanted = resolve_log_groups(logs.select("log_group"), patterns).agg(F.collect_set("log_group")).scalar()  # names that the configuration asks for
    minutes = F.coalesce("lookback_minutes", F.lit(lookback))
    requests = routed.select("run_id", F.col("ts").alias("end_ts"), minutes.alias("lookback_minutes"), F.explode(wanted).alias("log_group"))
    requests = save_and_read(requests, "requests")
    pushed = save_and_read(decode_subscription(events.select("run_id", "event")), "pushed")
    own = pushed.groupBy("run_id", "log_group").agg(F.count(F.lit(1)).alias("n"), F.max(F.char_length("message")).alias("longest"))
    # An empty text is no text: the group is fetched then.
    own = own.where("n > 1 or longest > 0").select("run_id", "log_group")
    own = save_and_read(own.join(requests.select("run_id", "log_group"), ["run_id", "log_group"], "left_semi"), "own")
    times = F.array_sort(F.collect_list(F.struct("end_ts", "lookback_minutes"))).alias("_times")
    asked = requests.join(own, ["run_id", "log_group"], "left_anti").groupBy("run_id", "log_group").agg(times)
    asked = save_and_read(asked, "asked")
    owners = save_and_read(asked.groupBy("log_group", "_times").agg(F.min("run_id").alias("owner")), "owners")
    members = asked.join(owners, ["log_group", "_times"]).select("run_id", "log_group", "owner")
    members = save_and_read(members.unionByName(own.withColumn("owner", F.col("run_id"))), "members")
    asked = owners.select(F.col("owner").alias("run_id"), "log_group", F.inline("_times"))
    stamped = format_log_line(F.unix_millis("ts"), F.coalesce("message", F.lit("")))
    fetched = fetch_lookbacks(logs.select("log_group", "ts", "seq", "message"), asked, slot_minutes)
    rows = fetched.select("run_id", "log_group", "ts", "seq", stamped.alias("text"))
    given = pushed.join(own, ["run_id", "log_group"], "left_semi")
    none = F.timestamp_seconds(F.lit(0))
    rows = rows.unionByName(given.select("run_id", "log_group", none.alias("ts"), F.col("line_no").alias("seq"), F.col("message").alias("text")))
    parts = rows.select("run_id", "log_group", "ts", "seq", F.posexplode(F.split("text", "\n")).alias("part", "line"))
    parts = save_and_read(parts, "fetched")
    numbered = number_rows(parts, ["run_id", "log_group"], F.col("ts"), F.struct("seq", "part"), second_key=F.col("seq"))
    return Sources(members, save_and_read(numbered.select("run_id", "log_group", "line_no", "line"), "sources"))


def scan_sections(sources: Sources, budgets: DataFrame, dim: int = 64) -> DataFrame:
    """:func:`multi_source_scan` of shared sources, with ``log_group`` and, for lines of reduced sources, ``block``: the header of the block that each lies in."""
    keys, source = ["run_id", "log_group"], ["owner", "log_group"]
    lines = sources.lines.withColumnRenamed("run_id", "owner")
    sizes = save_and_read(source_tokens(lines, source).join(sources.members, source), "sizes")
    plan = token_budget_plan(sizes.select(*keys, "tokens"), budgets).join(sizes.select(*keys, "owner"), keys)
    label = section_label(F.col("log_group"), F.col("needs_reduction"), F.col("share"))
    plan = save_and_read(plan.withColumn("label", label).select(*keys, "owner", "needs_reduction", "share", "place", "label"), "plan")
    small = plan.filter(~F.col("needs_reduction")).select(*keys, "owner", "place", "label")
    whole = lines.join(small, source).withColumn("block", F.lit(None).cast("string"))
    large = plan.filter("needs_reduction").select(*keys, "owner", "place", "label", "share")
    over = large.select(F.col("owner").alias("run_id"), "log_group")
    reduced = reduce_to_blocks(sources.lines.join(over, keys, "left_semi"), large, dim)
    columns = ["run_id", "place", "log_group", "label", "block", "line_no", "line"]
    return whole.select(*columns).unionByName(reduced.select(*columns))


def rule_analysis(sections: DataFrame) -> DataFrame:
    """``run_id, analysis``: the first service rule that any line of a run matches, as a short report; runs that match none are healthy."""
    rules = [r for r in CAUSE_RULES["service"] if r.keywords]
    flags, names = rule_flags(sections.select(F.col("run_id").alias("source_id"), "line_no", "line"), rules, [F.count(F.lit(1)).alias("_lines")])
    found = F.coalesce(*[F.when(F.col(n), F.lit(i)) for i, n in enumerate(names)])
    status = F.coalesce(F.initcap(pick(found, [r.severity for r in rules])), F.lit("Healthy"))
    summary = F.coalesce(pick(found, [r.label for r in rules]), F.lit("No known problem found"))
    text = F.concat(F.lit("STATUS: "), status, F.lit("\nSUMMARY: "), summary, F.lit("\nLINES: "), F.col("_lines").cast("string"))
    return flags.select(F.col("source_id").alias("run_id"), text.alias("analysis"))


class Scan(NamedTuple):
    """The labelled lines of every run, its analysis, and the notifications to send."""

    sections: DataFrame
    analyses: DataFrame
    notifications: DataFrame


def scan_events(
    events: DataFrame, patterns: DataFrame, logs: DataFrame, window: Column, max_output: Column, system_tokens: Column, lookback: int = LOOKBACK_MINUTES,
    slot_minutes: int = 30, dim: int = 64, analyse: Callable[[DataFrame], DataFrame] = rule_analysis,
) -> Scan:
    """From trigger events to notifications: resolve groups, fetch, fit into the token budget, label, analyse, notify.

    Inputs as in :func:`fetch_sources`; ``window``, ``max_output`` and ``system_tokens`` are columns of ``events`` or constants. ``analyse`` gets the labelled lines and
    returns ``run_id, analysis``. Runs without any text are not analysed. ``run_id`` is unique.
    """
    routed = route_trigger_events(events, lookback=lookback)
    sources = fetch_sources(events, patterns, logs, lookback, slot_minutes)
    context = trigger_context(F.col("trigger_type"), F.coalesce("alarm_name", F.lit("")), F.coalesce("alarm_reason", F.lit("")))
    budgets = routed.select("run_id", available_tokens(window, max_output, system_tokens, estimate_tokens(context)).alias("available"))
    sections = save_and_read(scan_sections(sources, budgets, dim), "sections")
    analyses = save_and_read(analyse(sections).join(routed.select("run_id", "ts", "trigger_type", "alarm_name"), "run_id"), "analyses")
    return Scan(sections, analyses, notifications(notify_gate(analyses, rca_is_healthy(F.col("analysis")))))
