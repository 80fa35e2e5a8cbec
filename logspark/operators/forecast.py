"""Metric forecasts, breach probabilities and their summaries.

A series is fitted from sums: each point becomes a row of model terms, and the normal equations are
aggregated per series, so a series of any length is fitted without ever being collected.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.operators.ordering import first_rows

# Default breach thresholds of the known metrics.
THRESHOLDS = {
    "cpu_utilization": 85.0,
    "memory_usage": 85.0,
    "error_rate": 5.0,
    "latency_p99": 1000.0,
    "requests_per_second": 10000.0,
}
# Width of the 95 % interval in deviations, breach factors, default spacing.
INTERVAL_WIDTH = 3.92
BREACH_FACTOR, BREACH_TIME_FACTOR = 1.2, 1.5
LIKELY = 0.5
POINT_MINUTES = 5
# Abramowitz and Stegun 26.2.17.
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
TAIL_SCALE = 0.2316419

CHANGE_POINTS = 8
DAILY, WEEKLY = 4, 3
Z95 = 1.959963984540054


def normal_tail(z: Column) -> Column:
    """Probability that a standard normal value exceeds ``z`` (error below 1e-7)."""
    size = F.abs(z)
    t = 1.0 / (1.0 + TAIL_SCALE * size)
    poly = F.lit(0.0)
    for c in reversed(TAIL):
        poly = (poly + c) * t
    upper = F.exp(-size * size / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def metric_thresholds(series: DataFrame, override: str | None = None) -> DataFrame:
    """Add ``threshold`` by metric name; a non-zero override column wins, unknown metrics get an ``error``."""
    names = F.create_map(*[F.lit(v) for pair in THRESHOLDS.items() for v in pair])
    default = F.try_element_at(names, F.col("metric"))
    own = F.nullif(F.col(override).cast("double"), F.lit(0.0)) if override else F.lit(None).cast("double")
    return series.withColumns(
        {
            "threshold": F.when(default.isNotNull(), F.coalesce(own, default)),
            "error": F.when(default.isNull(), F.concat(F.lit("Unsupported metric: "), "metric")),
        }
    )


def breach_likelihood(lower: Column, upper: Column, estimate: Column, threshold: Column) -> Column:
    """Probability that the value exceeds the threshold, from the 95 % interval."""
    deviation = (upper - lower) / INTERVAL_WIDTH
    z = F.when(deviation > 0, (threshold - estimate) / deviation).otherwise(0.0)
    return F.when(upper < threshold, 0.0).when(lower > threshold, 1.0).otherwise(normal_tail(z))


def breach_rollup(points: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Per series: probability of any breach, first likely breach time, point count and first three points."""
    order = F.struct("ds", "yhat", "yhat_lower", "yhat_upper", "likelihood")
    # Every task passes on the three earliest points only.
    few = first_rows(points, list(keys), [F.asc("ds")], 3)
    sample = few.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("sample_points"))
    rolled = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("forecast_points"),
        (1 - F.product(1 - F.col("likelihood"))).alias("breach_probability"),
        F.min(F.when(F.col("likelihood") > LIKELY, F.col("ds"))).alias("first_breach_time"),
    )
    return rolled.join(sample, list(keys))


def forecast_summary(points: DataFrame, history_max: DataFrame) -> DataFrame:
    """Per series: breach probability, breach time and trend.

    ``points`` holds ``series_id, ds, yhat, yhat_lower, yhat_upper, trend``; ``history_max`` holds
    ``series_id, y_max``. The probability is the share of points whose upper limit is above 1.2 times
    the forecast; a breach is the first upper limit above 1.5 times the highest value seen.
    """
    joined = points.join(history_max, "series_id")
    over = (F.col("yhat_upper") > F.col("yhat") * BREACH_FACTOR).cast("double")
    change = F.max_by("trend", "ds") - F.min_by("trend", "ds")
    return joined.groupBy("series_id").agg(
        F.least(F.avg(over), F.lit(1.0)).alias("breach_probability"),
        F.min(F.when(F.col("yhat_upper") > F.col("y_max") * BREACH_TIME_FACTOR, F.col("ds"))).alias("estimated_breach_time"),
        F.when(change > 0, "rising").when(change < 0, "falling").otherwise("stable").alias("trend"),
        F.count(F.lit(1)).alias("points"),
    )


def _trend_terms(at: Column) -> list[Column]:
    """Constant, slope and slope changes over the first 80 % of the history; ``at`` runs from 0 to 1."""
    knots = [0.8 * (i + 1) / (CHANGE_POINTS + 1) for i in range(CHANGE_POINTS)]
    return [F.lit(1.0), at, *[F.greatest(at - k, F.lit(0.0)) for k in knots]]


def _season_terms(seconds: Column, weekly: bool) -> list[Column]:
    terms = []
    for period, order in ((86_400.0, DAILY), (604_800.0, WEEKLY if weekly else 0)):
        for k in range(1, order + 1):
            angle = seconds * (2 * math.pi * k / period)
            terms += [F.sin(angle), F.cos(angle)]
    return terms


def fit_forecast(
    series: DataFrame, horizon: int = 60, step_minutes: int = 1, weekly: bool = True, ridge: float = 1.0
) -> DataFrame:
    """Forecast every series ``series_id, ds, y``: ``series_id, ds, yhat, yhat_lower, yhat_upper, trend, status``.

    A piecewise linear trend plus daily and weekly waves is fitted by ridge regression. ``X'X``, ``X'y``
    and ``y'y`` are summed per series with map-side combining; the small system of each series is then
    solved in a vectorised function. A series that cannot be fitted gives one row with status
    ``failed``. The interval is the 95 % range of the residuals.
    """
    clean = series.filter(F.col("ds").isNotNull() & F.col("y").isNotNull())
    seconds = F.unix_micros("ds") / 1e6
    spans = clean.groupBy("series_id").agg(F.min(seconds).alias("_lo"), F.max(seconds).alias("_hi"), F.avg("y").alias("_m"))
    placed = clean.join(spans, "series_id").withColumn("_s", seconds)
    width = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1.0))
    trend = _trend_terms((F.col("_s") - F.col("_lo")) / width)
    terms = trend + _season_terms(F.col("_s"), weekly)
    p, n_trend = len(terms), len(trend)
    # Values are centred first, so that the residual sum does not drown in a large mean.
    rows = placed.select("series_id", "_lo", "_hi", "_m", (F.col("y") - F.col("_m")).alias("y"), *[t.alias(f"_x{i}") for i, t in enumerate(terms)])
    cross = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")) for i in range(p) for j in range(i, p)]
    sums = rows.groupBy("series_id").agg(
        F.array(*cross).alias("xx"),
        F.array(*[F.sum(F.col(f"_x{i}") * F.col("y")) for i in range(p)]).alias("xy"),
        F.sum(F.col("y") * F.col("y")).alias("yy"),
        F.count(F.lit(1)).alias("n"),
        F.first("_lo").alias("lo"),
        F.first("_hi").alias("hi"),
        F.first("_m").alias("mid"),
    )

    @F.pandas_udf("struct<beta: array<double>, sigma: double>")
    def solve(xx: pd.Series, xy: pd.Series, yy: pd.Series, n: pd.Series) -> pd.DataFrame:
        upper = np.triu_indices(p)
        penalty = np.diag([1e-8, 1e-8] + [ridge] * (p - 2))
        out = []
        for a, b, c, count in zip(xx, xy, yy, n):
            try:
                gram = np.zeros((p, p))
                gram[upper] = np.asarray(a)
                gram = gram + np.triu(gram, 1).T
                beta = np.linalg.solve(gram + penalty, np.asarray(b))
                rest = c - 2 * beta @ np.asarray(b) + beta @ gram @ beta
                sigma = math.sqrt(max(rest, 0.0) / max(count - 2, 1))
                if count < 2 or not np.isfinite(beta).all():
                    raise ValueError("too few points")
                out.append((list(beta), sigma))
            except (np.linalg.LinAlgError, ValueError):
                out.append((None, None))
        return pd.DataFrame(out, columns=["beta", "sigma"])

    solved = sums.select("series_id", "lo", "hi", "mid", solve("xx", "xy", "yy", "n").alias("_f"))
    solved = series.select("series_id").distinct().join(solved, "series_id", "left")
    steps = F.explode_outer(
        F.when(F.col("_f.beta").isNotNull(), F.sequence(F.lit(1), F.lit(int(horizon // step_minutes))))
    )
    future = solved.select("series_id", "lo", "hi", "mid", "_f", steps.alias("_k")).withColumn(
        "_s", F.col("hi") + F.col("_k") * (60.0 * step_minutes)
    )
    at = (F.col("_s") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1.0))

    def weighted(columns: list[Column], offset: int) -> Column:
        total = F.lit(0.0)
        for i, column in enumerate(columns):
            total = total + column * F.get("_f.beta", F.lit(offset + i))
        return total

    level = F.col("mid") + weighted(_trend_terms(at), 0)
    value = level + weighted(_season_terms(F.col("_s"), weekly), n_trend)
    return future.select(
        "series_id",
        F.timestamp_micros((F.col("_s") * 1e6).cast("bigint")).alias("ds"),
        value.alias("yhat"),
        (value - Z95 * F.col("_f.sigma")).alias("yhat_lower"),
        (value + Z95 * F.col("_f.sigma")).alias("yhat_upper"),
        level.alias("trend"),
        F.when(F.col("_k").isNull(), "failed").otherwise("ok").alias("status"),
    )


def forecast(series: DataFrame, horizon_minutes: int = 60) -> DataFrame:
    """Summary per series of a forecast by the minute; a failed fit gives probability 0 and trend ``unknown``."""
    points = fit_forecast(series, horizon_minutes, 1)
    highest = series.groupBy("series_id").agg(F.max("y").alias("y_max"))
    summary = forecast_summary(points.filter("status = 'ok'"), highest)
    return highest.select("series_id").join(summary, "series_id", "left").select(
        "series_id",
        F.coalesce("breach_probability", F.lit(0.0)).alias("breach_probability"),
        "estimated_breach_time",
        F.coalesce("trend", F.lit("unknown")).alias("trend"),
        F.coalesce("points", F.lit(0)).cast("bigint").alias("points"),
        F.when(F.col("trend").isNull(), "failed").otherwise("ok").alias("status"),
    )


def forecast_all(series: DataFrame, horizon_hours: int = 1, interval_minutes: int = POINT_MINUTES) -> DataFrame:
    """Forecast metrics ``series_id, metric, ds, y`` against their thresholds and roll up the breach chances."""
    limits = metric_thresholds(series.select("series_id", "metric").distinct())
    points = fit_forecast(series, horizon_hours * 60, interval_minutes).filter("status = 'ok'").join(limits, "series_id")
    scored = points.filter("error is null").withColumn(
        "likelihood", breach_likelihood(F.col("yhat_lower"), F.col("yhat_upper"), F.col("yhat"), F.col("threshold"))
    )
    rolled = breach_rollup(scored)
    status = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("forecast_points").isNull(), "failed").otherwise("ok")
    return limits.join(rolled, "series_id", "left").select(
        "series_id", "metric", "threshold", "forecast_points", "breach_probability", "first_breach_time", "sample_points",
        status.alias("status"),
    )
