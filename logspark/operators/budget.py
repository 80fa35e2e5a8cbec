"""Token budgets: how much of each log source fits into one request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.operators.ordering import number_rows, text_key

# Tokens for formatting, window of an unknown model, smallest share kept.
FORMATTING_TOKENS = 500
DEFAULT_WINDOW = 1_000_000
MIN_SHARE = 0.01


def available_tokens(window: Column, max_output: Column, system_tokens: Column, context_tokens: Column) -> Column:
    """Tokens left for log text; an unknown or non-positive window counts as one million."""
    size = F.coalesce(F.when(window > 0, window), F.lit(DEFAULT_WINDOW))
    return F.greatest(size - (max_output + system_tokens + context_tokens + FORMATTING_TOKENS), F.lit(0)).cast("bigint")


def token_budget_plan(sources: DataFrame, budgets: DataFrame) -> DataFrame:
    """Share a run's budget over its sources: ``run_id, log_group, tokens, needs_reduction, share, place``.

    ``sources`` holds ``run_id, log_group, tokens`` (one row per source), ``budgets`` holds
    ``run_id, available``. If everything fits, all is kept. Else sources are taken by rising size
    (then name), each with an equal share (rounded down) of what is left: a source that fits
    is kept, a larger one is reduced to share / size, at least 1 %.

    The rule reads like a loop, but it needs only running sums. Up to the first source that does not
    fit, the budget left is the budget minus the sizes before it. From there on all sources are at
    least as large, and handing out floor(left / count) again and again gives the quotient to the
    first ones and the quotient plus one to as many of the last ones as the remainder says.
    """
    ordered = number_rows(
        sources.select("run_id", "log_group", "tokens"), ["run_id"], F.col("tokens"), F.col("log_group"),
        second_key=text_key(F.col("log_group")), out="place", value="tokens", running="before",
    )
    totals = sources.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("total"))
    placed = ordered.join(totals.join(budgets, "run_id"), "run_id")
    left = F.col("available") - F.col("before")
    fair = F.floor(left / (F.col("n") - F.col("place")))
    stop = placed.filter(F.col("tokens") > fair).groupBy("run_id").agg(
        F.min_by(F.struct("place", left.alias("left")), "place").alias("_stop")
    )
    joined = placed.join(stop, "run_id", "left")
    rest = F.col("n") - F.col("_stop.place")
    quotient = F.floor(F.col("_stop.left") / rest)
    remainder = F.col("_stop.left") - quotient * rest
    late = F.col("n") - F.col("place") <= remainder
    given = quotient + F.when(late, 1).otherwise(0)
    fits = (F.col("total") <= F.col("available")) | F.col("_stop").isNull() | (F.col("place") < F.col("_stop.place"))
    reduce = ~fits & (F.col("tokens") > given)
    share = F.least(F.greatest(given / F.col("tokens"), F.lit(MIN_SHARE)), F.lit(1.0))
    return joined.select(
        "run_id", "log_group", "tokens", F.coalesce(reduce, F.lit(False)).alias("needs_reduction"),
        F.when(reduce, share).alias("share"), "place",
    )
