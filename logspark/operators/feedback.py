"""Engineer feedback: statistics, training selection, preference pairs, reward targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Quality limits for training, preferred and rejected suggestions, and problems.
TRAINING_QUALITY = 6
PREFERRED_QUALITY, REJECTED_QUALITY = 7, 4
PROBLEM_QUALITY = 4
# Weights of quality and helpfulness in a reward.
QUALITY_WEIGHT, HELPFUL_WEIGHT = 0.7, 0.3
ROLLING_EPISODES = 100


def feedback_for_training(feedback: DataFrame, min_records: int = 100, quality: int = TRAINING_QUALITY) -> DataFrame:
    """At most ``2 * min_records`` good feedback rows, by id; the limit is part of the query."""
    good = feedback.filter(F.col("suggestion_quality") >= quality)
    return good.orderBy("feedback_id").limit(2 * min_records)


def feedback_statistics(feedback: DataFrame) -> DataFrame:
    """One row: count, mean quality, mean satisfaction, helpful count and rate; null means without rows."""
    helpful = F.count_if(F.coalesce("was_helpful", F.lit(False)))
    return feedback.agg(
        F.count(F.lit(1)).alias("total_feedback"),
        F.avg(F.coalesce("suggestion_quality", F.lit(5))).alias("avg_suggestion_quality"),
        F.avg(F.coalesce("overall_satisfaction", F.lit(5))).alias("avg_satisfaction"),
        helpful.alias("helpful_count"),
        F.try_divide(helpful, F.count(F.lit(1))).alias("helpful_rate"),
    )


def trending_suggestions(feedback: DataFrame, top_k: int = 10) -> DataFrame:
    """The most frequent suggestions with mean quality and helpful rate; ties by name."""
    stats = feedback.groupBy("suggestion").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("suggestion_quality").alias("avg_quality"),
        F.avg(F.col("was_helpful").cast("double")).alias("helpful_rate"),
        F.count_if("was_helpful").alias("helpful"),
    )
    return stats.orderBy(F.desc("count"), "suggestion").limit(top_k)


def problem_suggestions(feedback: DataFrame, quality: int = PROBLEM_QUALITY) -> DataFrame:
    """All feedback at or below a quality. Reads the whole table, not only rows good enough for training."""
    return feedback.filter(F.col("suggestion_quality") <= quality)


def reward_target(quality: Column, helpful: Column) -> Column:
    return QUALITY_WEIGHT * quality / 10 + HELPFUL_WEIGHT * helpful.cast("double")


def preference_pairs(feedback: DataFrame) -> DataFrame:
    """Preferred and rejected suggestions with the number of feedback pairs behind each.

    ``chosen, rejected, chosen_quality, pairs``: every feedback row of quality 7 or more is paired with
    every row of quality 4 or less. Rows with the same text and quality form the same pairs, so they
    are counted first, and one output row stands for ``pairs`` equal pairs. Each side is numbered and
    the pairs are reached by index arithmetic over ``range``, which Spark splits into even tasks.
    """
    quality = F.col("suggestion_quality")
    high = feedback.filter(quality >= PREFERRED_QUALITY).groupBy("suggestion", "suggestion_quality").agg(F.count(F.lit(1)).alias("n"))
    low = feedback.filter(quality <= REJECTED_QUALITY).groupBy("suggestion").agg(F.count(F.lit(1)).alias("m"))
    spark = feedback.sparkSession
    left = _numbered(high, ["suggestion_quality", "suggestion"])
    right = _numbered(low, ["suggestion"])
    # Distinct texts on both sides, two counts on the driver.
    n, m = left.count(), right.count()
    index = spark.range(n * m).select(F.floor(F.col("id") / max(m, 1)).alias("_i"), (F.col("id") % max(m, 1)).alias("_j"))
    joined = index.join(left.withColumnRenamed("_at", "_i"), "_i").join(
        right.select(F.col("_at").alias("_j"), F.col("suggestion").alias("rejected"), "m"), "_j"
    )
    return joined.select(
        F.col("suggestion").alias("chosen"), "rejected", F.col("suggestion_quality").alias("chosen_quality"),
        (F.col("n") * F.col("m")).alias("pairs"),
    )


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Number rows from 0 by hash bucket: bucket sizes are summed, then each bucket is numbered."""
    cut = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(1024)))
    sizes = cut.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1
    return cut.withColumn("_pos", inside).join(starts, "_b").withColumn("_at", F.col("_skip") + F.col("_pos")).drop("_b", "_pos", "_skip")


def rolling_feedback(episodes: DataFrame, order: str, score: str = "feedback_score", width: int = ROLLING_EPISODES) -> DataFrame:
    """Mean score of each episode and the ``width - 1`` before it; ``order`` numbers episodes from 0 without gaps.

    Episodes are cut into chunks of 64 widths, and the rows just before a chunk are copied into it.
    """
    chunk = 64 * width
    at = F.col(order)
    own = F.floor(at / chunk)
    late = F.floor((at + width - 1) / chunk)
    copied = episodes.withColumn("_chunk", F.explode(F.array_distinct(F.array(own, late))))
    line = Window.partitionBy("_chunk").orderBy(order).rowsBetween(-(width - 1), 0)
    return copied.withColumn("rolling", F.avg(score).over(line)).filter(F.col("_chunk") == own).drop("_chunk")
