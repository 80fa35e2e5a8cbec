"""Why lines are anomalous: signals, rare words and structural patterns, per source.

Inputs are lines ``source_id, line_no, line``. Everything is an aggregate with map-side combining, so a
source of any size is never brought into one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.rules import SIGNALS, Rule, matches
from logspark.functions.text import words
from logspark.operators.ordering import first_rows
from logspark.operators.rule_tables import line_hits, table_signals

# Words without meaning for the rarity score.
STOPWORDS = ("the", "and", "for", "with", "this", "that", "from", "into", "log", "info", "debug", "line")
DEFAULT_TEXT = "Anomalous embedding distance detected — pattern differs from baseline."


def _breaks(rules: Sequence[Rule]) -> list[tuple[int, list[str]]]:
    """Keywords of two or three words, which may run over line ends: rule index and words."""
    found = [(i, k.split(" ")) for i, rule in enumerate(rules) for k in rule.keywords]
    return [(i, parts) for i, parts in found if 1 < len(parts) <= 3]


def _spanning_hits(lines: DataFrame, rules: Sequence[Rule]) -> DataFrame | None:
    """``source_id, rule`` for keywords that run over a line end.

    Only lines that begin or end with a part of such a keyword take part; they meet by line number. Keywords of more than three words
    are left to the search for rule tables.
    """
    multi = _breaks(rules)
    long = [(i, 0, k) for i, rule in enumerate(rules) for k in rule.keywords if k.count(" ") > 2]
    if long:
        table = lines.sparkSession.createDataFrame(long, "rule_id long, priority long, keyword string")
        hits = line_hits(lines, table).select("source_id", F.col("rule_id").cast("int").alias("rule"))
        rest = _spanning_hits(lines, [Rule(tuple(k for k in r.keywords if k.count(" ") <= 2), r.label) for r in rules])
        return hits if rest is None else hits.unionByName(rest)
    if not multi:
        return None
    low = F.lower("line")
    heads, tails = [], []
    for i, parts in multi:
        for cut in range(1, len(parts)):
            heads.append((low.endswith(" ".join(parts[:cut])), f"{i}/{cut}"))
            tails.append((low.startswith(" ".join(parts[cut:])), f"{i}/{cut}"))
        if len(parts) == 3:
            heads += [(low.endswith(parts[0]), f"{i}/a"), (low == parts[1], f"{i}/b")]
            tails += [(low == parts[1], f"{i}/a"), (low.startswith(parts[2]), f"{i}/b")]

    def marks(side: list[tuple[Column, str]], shift: int) -> list[Column]:
        at = (F.col("line_no") + shift).alias("at")
        return [F.when(hit, F.struct(at, F.lit(cut).alias("cut"), F.lit(shift).alias("head"))) for hit, cut in side]

    # One pass over the lines: an end and a beginning meet where a place has both.
    touched = lines.filter(reduce(or_, (hit for hit, _ in heads + tails)))
    either = touched.select("source_id", F.explode(F.array(*marks(heads, 1), *marks(tails, 0))).alias("m")).select("source_id", "m.*")
    sides = either.filter(F.col("source_id").isNotNull() & F.col("at").isNotNull()).groupBy("source_id", "at", "cut")
    pairs = sides.agg(F.max("head").alias("ends"), F.min("head").alias("begins")).filter("ends = 1 and begins = 0")
    # Two words of three that meet before a line (a), and two after it (b), give a hit together.
    kind = F.split_part("cut", F.lit("/"), F.lit(2))
    rule = F.split_part("cut", F.lit("/"), F.lit(1)).cast("int")
    place = F.when(kind == "a", F.col("at") + 1).when(kind == "b", F.col("at"))
    met = pairs.select("source_id", rule.alias("rule"), place.alias("place"), kind.alias("kind")).groupBy("source_id", "rule", "place")
    halves = met.agg(F.max(F.col("kind") == "a").alias("a"), F.max(F.col("kind") == "b").alias("b"))
    return halves.filter("place is null or (a and b)").select("source_id", "rule")


def rule_flags(lines: DataFrame, rules: Sequence[Rule], more: Sequence[Column] = ()) -> tuple[DataFrame, list[str]]:
    """Per source one flag column per rule: whether its lines, joined with spaces, contain a keyword.

    ``more`` are further aggregates, computed in the same pass over the lines.
    """
    low = F.lower("line")
    names = [f"_h{i}" for i in range(len(rules))]
    flags = [F.bool_or(F.coalesce(matches(low, r), F.lit(False))).alias(n) for n, r in zip(names, rules)]
    inside = lines.groupBy("source_id").agg(*flags, *more) if flags or more else lines.select("source_id").distinct()
    spanning = _spanning_hits(lines, rules)
    if spanning is None:
        return inside, names
    marks = [F.bool_or(F.col("rule") == i).alias(f"_s{i}") for i in range(len(rules))]
    over = spanning.groupBy("source_id").agg(*marks)
    both = inside.join(over, "source_id", "left")
    either = {n: F.col(n) | F.coalesce(f"_s{i}", F.lit(False)) for i, n in enumerate(names)}
    return both.withColumns(either).drop(*[f"_s{i}" for i in range(len(rules))]), names


def signal_labels(names: Sequence[str], rules: Sequence[Rule] = SIGNALS, limit: int = 10) -> Column:
    """Labels of the set flag columns, without repeats, in rule order."""
    labels = F.array_compact(F.array(*[F.when(F.col(n), F.lit(r.label)) for n, r in zip(names, rules)]))
    return F.slice(F.array_distinct(labels), 1, limit)


def extract_signals(lines: DataFrame, rules: Sequence[Rule] | DataFrame = SIGNALS, limit: int = 10) -> DataFrame:
    """``source_id, signals``: labels of the keywords found in a source's joined lines, in rule order.

    ``rules`` may be a table (see :mod:`logspark.operators.rule_tables`) of any size.
    """
    if isinstance(rules, DataFrame):
        return table_signals(lines, rules, limit)
    flags, names = rule_flags(lines, rules)
    return flags.select("source_id", signal_labels(names, rules, limit).alias("signals"))


def token_rarity(lines: DataFrame, most: int = 50, keep: int = 20) -> DataFrame:
    """``source_id, token, score, rank``: the rarest of the ``most`` common words of each source.

    Equal counts are ranked by first appearance.
    """
    found = lines.select("source_id", "line_no", F.posexplode(words(F.col("line"))).alias("pos", "token"))
    counts = found.groupBy("source_id", "token").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("line_no", "pos")).alias("first")
    )
    totals = counts.groupBy("source_id").agg(F.sum("n").alias("total"))
    common = first_rows(counts, ["source_id"], [F.desc("n"), F.asc("first")], most, "_common")
    scored = (
        common.filter(~F.col("token").isin(*STOPWORDS) & (F.char_length("token") > 3))
        .join(totals, "source_id")
        .withColumn("score", F.bround(1 - F.col("n") / F.col("total"), 4))
    )
    ranked = first_rows(scored, ["source_id"], [F.desc("score"), F.asc("_common")], keep)
    return ranked.select("source_id", "token", "score", "rank")


def _fact_columns() -> list[Column]:
    line = F.col("line")
    # A time stamp cannot run over a line end, as the lines are joined with a space.
    stamps = F.when(F.col("line_no") < 20, F.regexp_count(line, F.lit(r"[0-9]{2}:[0-9]{2}:[0-9]{2}"))).otherwise(0)
    return [
        F.count(F.lit(1)).alias("line_count"),
        F.count_if(F.lower(line).rlike("error|exception|fatal")).alias("error_count"),
        F.bool_or(line.contains("at ") & line.contains("(")).alias("stack_trace"),
        F.sum(stamps).alias("stamps"),
    ]


def pattern_facts(lines: DataFrame) -> DataFrame:
    """Per source: line and error counts, stack trace flag, time stamps in the first 20 lines."""
    return lines.groupBy("source_id").agg(*_fact_columns())


def error_burst(lines: DataFrame) -> DataFrame:
    """``source_id, error_count, line_count, burst``: more than 30 % of the lines are errors."""
    facts = pattern_facts(lines)
    return facts.select(
        "source_id", "error_count", "line_count", (F.col("error_count") > F.col("line_count") * 0.3).alias("burst")
    )


def log_spam(lines: DataFrame, more_than: int = 5) -> DataFrame:
    """``source_id, line, repeats``: the most common line of each source, if it occurs often enough."""
    counts = lines.groupBy("source_id", "line").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))
    top = counts.groupBy("source_id").agg(
        F.max_by(F.struct("line", "n"), F.struct(F.col("n"), (-F.col("first")).alias("first"))).alias("_t")
    )
    return top.filter(F.col("_t.n") > more_than).select("source_id", "_t.line", F.col("_t.n").alias("repeats"))


def explanation_text(signals: Column, patterns: Column) -> Column:
    """One sentence on the first three signals, one on the first pattern, or a default."""
    parts = F.concat_ws(
        " ",
        F.when(
            F.size(signals) > 0, F.concat(F.lit("Detected signals: "), F.array_join(F.slice(signals, 1, 3), ", "), F.lit("."))
        ),
        F.when(F.size(patterns) > 0, F.concat(F.lit("Structural patterns: "), F.get(patterns, F.lit(0)), F.lit("."))),
    )
    return F.when(parts == "", F.lit(DEFAULT_TEXT)).otherwise(parts)


def _pattern_array(spam: str) -> Column:
    errors, total = F.col("error_count").cast("string"), F.col("line_count").cast("string")
    texts = [
        F.when(
            F.col("error_count") > F.col("line_count") * 0.3,
            F.concat(F.lit("Error burst: "), errors, F.lit("/"), total, F.lit(" lines are errors")),
        ),
        F.when(
            F.col("repeats").isNotNull(),
            F.concat(
                F.lit("Log spam: '"), F.substring(spam, 1, 60), F.lit("' repeated "), F.col("repeats").cast("string"), F.lit("x")
            ),
        ),
        F.when(F.col("stack_trace"), F.lit("Stack trace present — unhandled exception")),
        F.when(F.col("stamps") >= 2, F.concat(F.lit("Rapid log sequence: "), total, F.lit(" lines"))),
    ]
    return F.array_compact(F.array(*texts))


def find_patterns(lines: DataFrame) -> DataFrame:
    """``source_id, patterns``: texts for error burst, log spam, stack trace and rapid sequence, in this order."""
    spam = log_spam(lines).withColumnRenamed("line", "_spam")
    facts = pattern_facts(lines).join(spam, "source_id", "left")
    return facts.select("source_id", _pattern_array("_spam").alias("patterns"))


def explain(lines: DataFrame) -> DataFrame:
    """One row per source: ``signals, token_scores, patterns, explanation``."""
    flags, names = rule_flags(lines, SIGNALS, _fact_columns())
    tokens = token_rarity(lines)
    scores = tokens.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("rank", "token", "score"))).alias("_t"))
    spam = log_spam(lines).withColumnRenamed("line", "_spam")
    both = flags.join(spam, "source_id", "left").join(scores, "source_id", "left")
    out = both.select(
        "source_id",
        signal_labels(names).alias("signals"),
        F.coalesce(F.map_from_arrays("_t.token", "_t.score"), F.create_map().cast("map<string,double>")).alias("token_scores"),
        _pattern_array("_spam").alias("patterns"),
    )
    return out.withColumn("explanation", explanation_text(F.col("signals"), F.col("patterns")))
