"""Exact row numbers and running sums in groups of any size.

A plain ``row_number() over (partition by source order by ts)`` sorts a whole source in one task. Here
every group is cut into buckets that follow the sort order, rows are numbered inside a bucket, and the
sizes of the earlier buckets are added. Only bucket counts are ever summed per group.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _quantiles(df: DataFrame, key: str, parts: int) -> list[float]:
    shares = [i / parts for i in range(1, parts)]
    if not shares:
        return []
    found = df.agg(F.percentile_approx(key, shares, max(10_000, 10 * parts)).alias("q")).first()["q"]
    return [q for q in found or [] if not math.isnan(q)]


def order_buckets(
    df: DataFrame, first: Column, second: Column, parts: int | None = None, out: str = "_bucket"
) -> DataFrame:
    """Add ``out``: an array that sorts like ``(first, second)`` and splits the rows into even shares.

    ``first`` and ``second`` are numeric or time columns, sorted upwards. The bucket limits are
    quantiles of ``first`` (``parts`` numbers on the driver). A single value of ``first`` that fills
    more than one bucket gets a bucket of its own, which is then cut by quantiles of ``second``.
    """
    parts = parts or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    keyed = df.withColumn("_k1", first.cast("double")).withColumn("_k2", second.cast("double"))
    found = _quantiles(keyed, "_k1", parts)
    heavy = sorted(value for value, n in Counter(found).items() if n > 1)
    limits = sorted(set(found) | {math.nextafter(value, math.inf) for value in heavy})
    if not limits:
        return df.withColumn(out, F.array(F.lit(0.0), F.lit(0.0)))
    splits = [-math.inf, *limits, math.inf]
    cut = Bucketizer(splits=splits, inputCol="_k1", outputCol="_b1", handleInvalid="keep").transform(keyed)
    tie = F.lit(0.0)
    if heavy:
        is_heavy = F.col("_k1").isin(heavy)
        inner = sorted(set(_quantiles(keyed.filter(is_heavy), "_k2", parts)))
        cut = Bucketizer(
            splits=[-math.inf, *inner, math.inf], inputCol="_k2", outputCol="_b2", handleInvalid="keep"
        ).transform(cut)
        tie = F.when(is_heavy, F.col("_b2")).otherwise(tie)
    return cut.withColumn(out, F.array(F.col("_b1"), tie)).drop("_k1", "_k2", "_b1", "_b2")


def text_key(text: Column) -> Column:
    """A number that rises with the first six bytes of a text, for buckets over text order."""
    head = F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    first: Column,
    second: Column,
    *,
    second_key: Column | None = None,
    out: str = "line_no",
    value: str | None = None,
    running: str = "running",
    how: str = "sum",
    parts: int | None = None,
) -> DataFrame:
    """Number the rows of each group from 0 in the order ``(first, second)``.

    With ``value`` the column ``running`` holds the ``sum``, ``min`` or ``max`` of ``value`` over all
    earlier rows (0 or null before the first).
    ``(first, second)`` must be unique within a group. Both are numbers or times; a ``second`` of another
    type needs a numeric ``second_key`` that never falls along it, such as :func:`text_key`.
    """
    group = list(group)
    cut = order_buckets(df, first, second if second_key is None else second_key, parts)
    keys = [*group, "_bucket"]
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    amount = F.col(value) if value else F.lit(0)
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), fold(amount).alias("_v"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"), fold("_v").over(before).alias("_base")
    )
    inside = Window.partitionBy(*keys).orderBy(first, second)
    ranked = cut.withColumn("_pos", F.row_number().over(inside) - 1)
    if value:
        earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
        ranked = ranked.withColumn("_own", fold(amount).over(earlier))
    # Null-safe, so that rows without a group key form a group of their own.
    names = [f"_g{i}" for i in range(len(keys))]
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    joined = ranked.join(starts.toDF(*names, "_skip", "_base"), same)
    columns = [*df.columns, (F.col("_skip") + F.col("_pos")).alias(out)]
    if value:
        zero = F.lit(0)
        total = {
            "sum": F.coalesce("_base", zero) + F.coalesce("_own", zero),
            "min": F.least("_base", "_own"),
            "max": F.greatest("_base", "_own"),
        }[how]
        columns.append(total.alias(running))
    return joined.select(*columns)


def first_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, ranked from 1.

    Spark cuts every input partition to ``k`` rows per group before the shuffle, so a hot group
    sends at most ``k`` rows per task.
    """
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(out) <= k)


def top_share(df: DataFrame, group: Sequence[str], share: Column, score: str, tie: str, place: str | None = None) -> DataFrame:
    """The best ``ceil(share * n)`` rows of each group by falling ``score``, then rising ``tie``.

    ``share`` may be a column that is constant in a group. Exact for groups and score ties of any size. ``place`` names a column for the places, from 0.
    """
    group = list(group)
    wanted = df.withColumn("_share", share)
    goal = wanted.groupBy(*group).agg(F.ceil(F.first("_share") * F.count(F.lit(1))).alias("_goal"))
    ranked = number_rows(df, group, -F.col(score), F.col(tie), out="_rank")
    kept = ranked.join(goal, group).filter(F.col("_rank") < F.col("_goal"))
    return kept.select(*df.columns, *([F.col("_rank").alias(place)] if place else []))


def exact_percentile(df: DataFrame, value: Column, share: float) -> DataFrame:
    """One row ``percentile, samples``: linear interpolation between the two nearest of all sorted values.

    Equal values are counted first and the counts are summed along the sorted values, so no task
    holds all of them.
    """
    counts = df.select(value.cast("double").alias("_x")).filter("_x is not null").groupBy("_x").agg(F.count(F.lit(1)).alias("_c"))
    one = counts.withColumn("_g", F.lit(0))
    summed = number_rows(one, ["_g"], F.col("_x"), F.col("_x"), out="_at", value="_c", running="_before")
    total = counts.agg(F.sum("_c")).scalar()
    place = (F.col("_n") - 1) * share
    last = F.col("_before") + F.col("_c") - 1
    near = summed.withColumn("_n", total).withColumns({"_lo": F.floor(place), "_hi": F.ceil(place), "_part": place - F.floor(place)})
    low = F.max(F.when((F.col("_before") <= F.col("_lo")) & (last >= F.col("_lo")), F.col("_x")))
    high = F.max(F.when((F.col("_before") <= F.col("_hi")) & (last >= F.col("_hi")), F.col("_x")))
    found = near.agg(low.alias("_l"), high.alias("_h"), F.max("_part").alias("_p"), F.coalesce(F.max("_n"), F.lit(0)).alias("samples"))
    return found.select((F.col("_l") + (F.col("_h") - F.col("_l")) * F.col("_p")).alias("percentile"), "samples")
