"""Sliding windows over numbered lines, and back from windows to lines.

Windows are reached by arithmetic on ``line_no`` and an equi-join on ``(source, start)``; there is no
range join, and a large source spreads over many window keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_starts(line_no: Column, size: int, stride: int) -> Column:
    """Starts (0, stride, 2*stride, ...) of all windows of ``size`` lines that cover a line."""
    last = F.floor(line_no / stride) * stride
    first = F.greatest(F.ceil((line_no - size + 1) / stride) * stride, F.lit(0))
    return F.when(first <= last, F.sequence(first, last, F.lit(stride).cast("bigint")))


def lines_in_windows(lines: DataFrame, size: int, stride: int) -> DataFrame:
    """One row per line and covering window start, also for windows that run past the end."""
    return lines.withColumn("start", F.explode(window_starts(F.col("line_no"), size, stride)))


def sliding_windows(
    lines: DataFrame, size: int, stride: int, aggregates: Sequence[Column], keys: Sequence[str] = ("source_id",)
) -> DataFrame:
    """Aggregate full windows of ``size`` lines; ``keys, start`` and the given aggregates."""
    grouped = lines_in_windows(lines, size, stride).groupBy(*keys, "start").agg(
        F.count(F.lit(1)).alias("_n"), *aggregates
    )
    return grouped.filter(F.col("_n") == size).drop("_n")


def windows_to_lines(windows: DataFrame, size: int, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """One row per window and covered line."""
    last = F.col("start") + (size - 1)
    return windows.withColumn("line_no", F.explode(F.sequence("start", last)))


def max_overlap_score(
    lines: DataFrame, windows: DataFrame, size: int, score: str = "score", keys: Sequence[str] = ("source_id",)
) -> DataFrame:
    """Give every line the highest score of its covering windows; uncovered lines get 0."""
    best = windows_to_lines(windows, size, keys).groupBy(*keys, "line_no").agg(F.max(score).alias("_s"))
    joined = lines.join(best, [*keys, "line_no"], "left")
    return joined.withColumn(score, F.greatest(F.coalesce("_s", F.lit(0.0)), F.lit(0.0))).drop("_s")


def merge_blocks(
    kept: DataFrame, size: int, score: str = "score", keys: Sequence[str] = ("source_id",), chunk: int = 1 << 20
) -> DataFrame:
    """Join overlapping or adjacent windows to blocks ``keys, line_start, line_end, score`` (the highest).

    The previous window is looked up inside chunks of the line range; a chunk's last window is passed
    on to the next chunk that holds any, so no task sorts a whole source.
    """
    keys = list(keys)
    marked = kept.select(*keys, "start", score).withColumn("_chunk", F.floor(F.col("start") / chunk))
    per_chunk = marked.groupBy(*keys, "_chunk").agg(F.max("start").alias("_last"))
    along = Window.partitionBy(*keys).orderBy("_chunk")
    carried = per_chunk.select(*keys, "_chunk", F.lag("_last").over(along).alias("_carry"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("start")
    linked = marked.join(carried, [*keys, "_chunk"]).withColumn(
        "_before", F.coalesce(F.lag("start").over(inside), F.col("_carry"))
    )
    opens = F.when(F.col("_before").isNull() | (F.col("start") > F.col("_before") + size), 1).otherwise(0)
    flagged = linked.withColumn("_open", opens)
    opened = flagged.groupBy(*keys, "_chunk").agg(F.sum("_open").alias("_o"))
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    offsets = opened.select(*keys, "_chunk", F.coalesce(F.sum("_o").over(earlier), F.lit(0)).alias("_base"))
    numbered = flagged.join(offsets, [*keys, "_chunk"]).withColumn(
        "_block", F.col("_base") + F.sum("_open").over(inside)
    )
    return (
        numbered.groupBy(*keys, "_block")
        .agg(F.min("start").alias("line_start"), (F.max("start") + (size - 1)).alias("line_end"), F.max(score).alias(score))
        .drop("_block")
    )


def block_lines(
    lines: DataFrame, kept: DataFrame, size: int, keys: Sequence[str] = ("source_id",)
) -> DataFrame:
    """The lines covered by kept windows, once each."""
    covered = windows_to_lines(kept.select(*keys, "start"), size, keys).select(*keys, "line_no").distinct()
    return lines.join(covered, [*keys, "line_no"], "left_semi")
