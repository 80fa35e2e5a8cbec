"""Anomaly scores over vectors, thresholds and the detection cascade."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.vectors import distance, hash_vector, line_template, norm
from logspark.operators.ordering import exact_percentile, first_rows

# Z-score limits by profile, window size and stride, probability limit.
ZSCORE_LIMIT = {"library": 2.0, "service": 3.0}
WINDOW_SIZE, WINDOW_STRIDE = 16, 4
SEQUENCE_LIMIT = 0.5
# Spread below this counts as none: equal vectors differ by rounding only.
NO_SPREAD = 1e-9


def flag_threshold(score: Column, limit: Column | float, strict: bool = True) -> Column:
    """Above the limit (library) or at least the limit (service, ``strict=False``)."""
    return score > limit if strict else score >= limit


def _spread(dist: DataFrame, keys: Sequence[str], weight: Column) -> DataFrame:
    """Mean and population standard deviation of ``dist`` per key, rows counted ``weight`` times."""
    total = F.sum(weight)
    mean = F.sum(F.col("dist") * weight) / total
    first = dist.groupBy(*keys).agg(mean.alias("mean_dist"), total.alias("_n"))
    joined = dist.join(first, list(keys))
    gap = F.col("dist") - F.col("mean_dist")
    return joined.groupBy(*keys).agg(
        F.first("mean_dist").alias("mean_dist"), F.sqrt(F.sum(gap * gap * weight) / F.first("_n")).alias("std_dist")
    )


def _weighted_scores(rows: DataFrame, keys: Sequence[str], vector: str, weight: Column, profile: str) -> DataFrame:
    """Add ``score, is_anomaly`` to rows that each stand for ``weight`` lines."""
    keys = list(keys)
    if profile == "library":
        means = rows.groupBy(*keys).agg(Summarizer.mean(array_to_vector(vector), weight.cast("double")).alias("_m"))
        means = means.select(*keys, vector_to_array("_m").alias("_mean"))
        dist = rows.join(means, keys).withColumn("dist", distance(F.col(vector), F.col("_mean"))).drop("_mean")
    else:
        dist = rows.withColumn("dist", norm(F.col(vector)))
    spread = _spread(dist, keys, weight)
    flat = F.col("std_dist") < NO_SPREAD
    z = F.abs((F.col("dist") - F.col("mean_dist")) / F.col("std_dist"))
    joined = dist.join(spread, keys)
    limit = ZSCORE_LIMIT[profile]
    if profile == "library":
        scored = joined.withColumn("score", F.when(flat, F.col("dist")).otherwise(z))
        flag = ~flat & (z > limit)
    else:
        peak = dist.join(spread, keys).groupBy(*keys).agg(F.max(F.when(~flat, z)).alias("_peak"))
        joined = joined.join(peak, keys)
        scored = joined.withColumn("score", F.when(flat, F.lit(0.0)).otherwise(z / F.col("_peak"))).drop("_peak")
        flag = ~flat & (z >= limit)
    return scored.withColumn("is_anomaly", flag).drop("dist", "mean_dist", "std_dist")


def zscore_anomaly(
    rows: DataFrame, keys: Sequence[str] = ("source_id",), vector: str = "embedding", profile: str = "library"
) -> DataFrame:
    """Score vectors by the z-score of their distance from the group's mean vector.

    The ``service`` profile scores the z-score of the vector lengths, divided by the highest one.
    Without spread nothing is flagged.
    """
    return _weighted_scores(rows, keys, vector, F.lit(1.0), profile)


def detect_lines(lines: DataFrame, dim: int = 64, profile: str = "library") -> DataFrame:
    """Score log lines ``source_id, line_no, line`` with the hashing encoder and the z-score.

    Vectors, means and deviations are computed once per distinct wording (weighted by its count), so
    the scoring work grows with the number of wordings, and copies of one line cost one row.
    """
    worded = lines.withColumn("_t", line_template(F.col("line")))
    counts = worded.groupBy("source_id", "_t").agg(F.count(F.lit(1)).alias("_w"))
    vectors = counts.withColumn("_v", hash_vector(F.col("_t"), dim))
    scores = _weighted_scores(vectors, ["source_id"], "_v", F.col("_w"), profile)
    joined = worded.join(scores.select("source_id", "_t", "score", "is_anomaly"), ["source_id", "_t"])
    return joined.drop("_t").withColumns({"threshold": F.lit(ZSCORE_LIMIT[profile]), "method": F.lit("zscore")})


def calibrate_sigma(scores: DataFrame, score: str = "score", k: float = 3.0, keys: Sequence[str] = ()) -> DataFrame:
    """``threshold`` = mean + k population deviations, with mean, deviation, count and baseline anomaly rate."""
    keys = list(keys)
    stats = scores.groupBy(*keys).agg(
        F.avg(score).alias("baseline_mean"), F.stddev_pop(score).alias("baseline_std"), F.count(score).alias("samples")
    )
    stats = stats.withColumn("threshold", F.col("baseline_mean") + k * F.col("baseline_std"))
    if keys:
        joined = scores.join(stats, keys)
    else:
        joined = scores.withColumn("threshold", stats.select("threshold").scalar())
    over = F.avg((F.col(score) > F.col("threshold")).cast("double")).alias("anomaly_rate")
    rate = joined.groupBy(*keys).agg(over)
    return stats.join(rate, keys) if keys else stats.withColumn("anomaly_rate", rate.scalar())


def calibrate_percentile(
    scores: DataFrame, score: str = "score", label: str | None = "label", share: float = 0.95, default: float = 0.5,
    exact: bool = True,
) -> DataFrame:
    """``threshold``: a percentile of the normal (label 0) scores, ``default`` without any.

    ``exact`` interpolates between the two nearest of all scores; ``exact=False`` uses Spark's bounded sketch.
    """
    value = F.when(F.col(label) == 0, F.col(score)) if label else F.col(score)
    if exact:
        found = exact_percentile(scores, value, share)
        return found.select(F.coalesce("percentile", F.lit(default)).alias("threshold"), "samples")
    sketch = F.percentile_approx(value, share, 10_000)
    return scores.agg(F.coalesce(sketch, F.lit(default)).alias("threshold"), F.count(value).alias("samples"))


def calibration_stats(scores: DataFrame, threshold: Column | float, score: str = "score", label: str = "label") -> DataFrame:
    """Per class count, mean, deviation, range, 95th percentile and share at or above the threshold."""
    at = scores.withColumn("_hit", (F.col(score) >= threshold).cast("double"))
    out = []
    for name, value in (("normal", 0), ("anomaly", 1)):
        one = F.when(F.col(label) == value, F.col(score))
        out += [
            F.count(one).alias(f"{name}_samples"),
            F.coalesce(F.avg(one), F.lit(0.0)).alias(f"{name}_mean"),
            F.coalesce(F.stddev_pop(one), F.lit(0.0)).alias(f"{name}_std"),
            F.coalesce(F.min(one), F.lit(0.0)).alias(f"{name}_min"),
            F.coalesce(F.max(one), F.lit(0.0)).alias(f"{name}_max"),
        ]
    normal = F.when(F.col(label) == 0, F.col(score))
    p95 = exact_percentile(scores, normal, 0.95).select("percentile").scalar()
    return at.agg(
        *out,
        F.coalesce(F.avg(F.when(F.col(label) == 0, F.col("_hit"))), F.lit(0.0)).alias("false_positive_rate"),
        F.coalesce(F.avg(F.when(F.col(label) == 1, F.col("_hit"))), F.lit(0.0)).alias("true_positive_rate"),
    ).withColumn("normal_p95", F.coalesce(p95, F.lit(0.0)))


def active_model(registry: DataFrame, order: Sequence[str] = ("sequence", "reconstruction")) -> dict | None:
    """The first kind in ``order`` that has a registered model, with its newest threshold.

    Reads at most one row per kind from the registry ``kind, ts, threshold``.
    """
    newest = registry.filter(F.col("kind").isin(*order)).groupBy("kind").agg(F.max_by("threshold", "ts").alias("threshold"))
    found = {row["kind"]: row["threshold"] for row in newest.collect()}
    return next(({"kind": kind, "threshold": found[kind]} for kind in order if kind in found), None)


def detect_cascade(lines: DataFrame, registry: DataFrame | None = None, scorers: dict | None = None, profile: str = "library") -> DataFrame:
    """Detect with the best registered model, or with z-scores.

    ``scorers`` maps a kind (``sequence``, ``reconstruction``) to a function from lines to lines with
    ``score``. The registry decides on the driver which plan is built; the result columns are the same.
    """
    chosen = active_model(registry, tuple(k for k in ("sequence", "reconstruction") if k in (scorers or {}))) if registry is not None and scorers else None
    if chosen is None:
        return detect_lines(lines, profile=profile)
    limit = SEQUENCE_LIMIT if chosen["kind"] == "sequence" else float(chosen["threshold"])
    scored = scorers[chosen["kind"]](lines)
    strict = profile == "library"
    return scored.withColumns(
        {
            "is_anomaly": flag_threshold(F.col("score"), F.lit(limit), strict),
            "threshold": F.lit(limit),
            "method": F.lit(chosen["kind"]),
        }
    )


def detect_summary(detected: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Per source: line and anomaly counts, method and threshold; listed sources without lines are ``empty``."""
    found = detected.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if("is_anomaly").alias("anomalous_lines"),
        F.first("method").alias("method"),
        F.first("threshold").alias("threshold"),
    )
    if sources is None:
        return found
    zero = F.lit(0).cast("bigint")
    return sources.select("source_id").distinct().join(found, "source_id", "left").select(
        "source_id",
        F.coalesce("total_lines", zero).alias("total_lines"),
        F.coalesce("anomalous_lines", zero).alias("anomalous_lines"),
        F.coalesce("method", F.lit("empty")).alias("method"),
        "threshold",
    )


def first_anomalies(detected: DataFrame, n: int) -> DataFrame:
    """``source_id, _lines``: the first ``n`` anomalous lines of each source, in order."""
    top = first_rows(detected.filter("is_anomaly").select("source_id", "line_no", "line"), ["source_id"], [F.asc("line_no")], n)
    packed = top.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    return packed.select("source_id", F.col("_l.line").alias("_lines"))


def anomalous_excerpt(detected: DataFrame, n: int = 40) -> DataFrame:
    """Per source the first ``n`` anomalous ``lines``, and as ``excerpt`` joined, or its first line without any."""
    opening = detected.groupBy("source_id").agg(F.min_by("line", "line_no").alias("_first"))
    return opening.join(first_anomalies(detected, n), "source_id", "left").select(
        "source_id",
        F.coalesce("_lines", F.array().cast("array<string>")).alias("lines"),
        F.coalesce(F.array_join("_lines", "\n"), F.col("_first")).alias("excerpt"),
    )
