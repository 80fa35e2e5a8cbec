"""Planned look-ups as joins: metric statistics, log samples, resource status, cached answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.reports import slot_text
from logspark.functions.rules import matches_pattern
from logspark.operators.ordering import first_rows, number_rows
from logspark.session import save_and_read

# Statistics of a metric query, resource kinds with a status, lines of a log sample.
STATS = ("Average", "Sum", "Minimum", "Maximum", "SampleCount")
RESOURCE_KINDS = ("lambda", "rds", "ecs", "ec2")
SAMPLE_LINES = 50


def period_seconds(minutes: Column) -> Column:
    """About ten datapoints per query, at least one minute each."""
    return F.greatest(F.floor(minutes * 60 / 10), F.lit(60)).cast("bigint")


def _statistic(stat: Column, value: str) -> Column:
    return (
        F.when(F.first(stat) == "Average", F.avg(value))
        .when(F.first(stat) == "Sum", F.sum(value))
        .when(F.first(stat) == "Minimum", F.min(value))
        .when(F.first(stat) == "Maximum", F.max(value))
        .when(F.first(stat) == "SampleCount", F.count(value).cast("double"))
    )


def metric_statistics(metrics: DataFrame, minutes: int = 60, stat: str = "Average") -> DataFrame:
    """One value per series and period: ``namespace, metric_name, resource, bucket, value``."""
    seconds = max(minutes * 60 // 10, 60)
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / seconds) * seconds)
    picked = metrics.groupBy("namespace", "metric_name", "resource", bucket.alias("bucket"))
    return picked.agg(_statistic(F.lit(stat), "value").alias("value"))


def _in_slots(specs: DataFrame, minutes: Column) -> DataFrame:
    """Specs with ``_start`` and one row per time slot ``(_len, _slot)`` that ``[_start, end_ts]`` touches.

    A slot is as long as the spec's look-back, rounded up to a power of two minutes, so a spec touches
    two slots at most and few slot lengths exist.
    """
    length = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(minutes, F.lit(1))))).cast("bigint")
    asked = specs.withColumns({"_len": length, "_start": F.col("end_ts") - F.make_dt_interval(mins=minutes)})
    first, last = (F.floor(F.unix_seconds(c) / (F.col("_len") * 60)) for c in ("_start", "end_ts"))
    return asked.withColumn("_slot", F.explode(F.sequence(first, last)))


def _slots_of(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` once per slot length in use, with the slot of their ``ts``."""
    lengths = asked.agg(F.collect_set("_len").alias("_all")).scalar()
    return rows.withColumn("_len", F.explode(lengths)).withColumn("_slot", F.floor(F.unix_seconds("ts") / (F.col("_len") * 60)))


def _between(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` from the earliest start to the latest end asked for: older history is not read any further."""
    return rows.filter((F.col("ts") >= asked.agg(F.min("_start")).scalar()) & (F.col("ts") <= asked.agg(F.max("end_ts")).scalar()))


def _distinct_lookups(specs: DataFrame, *fields: Column) -> tuple[DataFrame, DataFrame]:
    """``incident_id, query_key, _lookup`` and the stored table of distinct ``_lookup``: the array of what a query asks for.

    Queries that ask for the same share one look-up, so rows are met and summed once, however many incidents ask. Specs of one incident and key (of a plan
    of about ten) are one look-up.
    """
    asking = specs.groupBy("incident_id", "query_key").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_lookup"))
    return asking, save_and_read(asking.select("_lookup").distinct(), "lookups")


def metric_datapoints(specs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Planned metric queries with their ``datapoints``, an array of ``bucket, value`` in time order: ``incident_id, query_key, datapoints``.

    ``specs`` holds ``incident_id, query_key, namespace, metric_name, dimensions, stat, period_minutes,
    end_ts``; ``metrics`` holds ``namespace, metric_name, dimensions, ts, value``. A spec reads the
    datapoints of its last period that carry all of its dimensions. Sides meet on namespace, name, one
    dimension and a time slot, so a busy metric is spread over its resources and time slots. Queries
    without datapoints are not returned.
    """
    # Sides also meet on one dimension of the spec; a spec without any meets the empty entry.
    none = F.struct(F.lit("").alias("key"), F.lit("").alias("value"))
    given = lambda c: F.coalesce(c, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    named = specs.withColumns({"_minutes": F.coalesce("period_minutes", F.lit(60)), "_stat": F.coalesce("stat", F.lit("Average"))})
    entries = F.array_sort(F.map_entries(given(F.col("dimensions")))).alias("_entries")
    asking, lookups = _distinct_lookups(named, F.col("namespace"), F.col("metric_name"), entries, F.col("_stat"), F.col("_minutes"), F.col("end_ts"))
    asked = _in_slots(lookups.select("_lookup", F.inline("_lookup")), F.col("_minutes"))
    asked = asked.withColumn("_dim", F.coalesce(F.get("_entries", F.lit(0)), none))
    metrics = _between(metrics, asked).withColumn("dimensions", given(F.col("dimensions")))
    own = F.explode(F.concat(F.map_entries("dimensions"), F.array(none)))
    meet = ["namespace", "metric_name", "_dim"]
    # Only series that a spec names are spread over slots.
    series = metrics.withColumn("_dim", own).join(asked.select(*meet).distinct(), meet, "left_semi")
    cut = _slots_of(series, asked).withColumnRenamed("dimensions", "_have")
    rest = F.forall("_entries", lambda e: F.try_element_at(F.col("_have"), e["key"]) == e["value"])
    joined = asked.join(cut, [*meet, "_len", "_slot"]).filter(
        F.col("ts").between(F.col("_start"), F.col("end_ts")) & ((F.size("_entries") < 2) | rest)
    )
    seconds = period_seconds(F.col("_minutes"))
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / seconds) * seconds)
    points = joined.groupBy("_lookup", bucket.alias("bucket")).agg(_statistic(F.col("_stat"), "value").alias("value"))
    packed = points.groupBy("_lookup").agg(F.array_sort(F.collect_list(F.struct("bucket", "value"))).alias("datapoints"))
    return asking.join(packed, "_lookup").select("incident_id", "query_key", "datapoints")


def run_metric_specs(specs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Datapoints of planned metric queries (:func:`metric_datapoints`), one row each: ``incident_id, query_key, bucket, value``."""
    return metric_datapoints(specs, metrics).select("incident_id", "query_key", F.inline("datapoints"))


def run_log_specs(specs: DataFrame, events: DataFrame, limit: int = SAMPLE_LINES) -> DataFrame:
    """Log samples of planned queries: ``incident_id, query_key, event_count, sample_lines``.

    ``specs`` holds ``incident_id, query_key, log_group, filter_pattern, lookback_minutes, end_ts``;
    ``events`` holds ``event_id, log_group, ts, message``. The first ``limit`` matches by time are kept
    and counted, as the source query is limited too. Queries without a match are not returned.

    Matches are found once per pattern and numbered by time; a query looks up the number of its first
    match and joins the next ``limit`` numbers, however many matches its time range holds. Queries that
    ask for the same share one look-up.
    """
    key = ["log_group", "_pattern"]
    minutes = F.coalesce("lookback_minutes", F.lit(60))
    start = (F.col("end_ts") - F.make_dt_interval(mins=minutes)).alias("_start")
    asking, lookups = _distinct_lookups(specs, F.col("log_group"), F.coalesce("filter_pattern", F.lit("")).alias("_pattern"), F.col("end_ts"), start)
    asked = lookups.select("_lookup", F.inline("_lookup"))
    events = _between(events.select("event_id", "log_group", "ts", "message"), asked)
    hits = events.join(asked.select(*key).distinct(), "log_group")
    hits = hits.filter(matches_pattern(F.col("message"), F.col("_pattern")))
    # One timeline per group and pattern: a query's start has a running count of the matches before it.
    starts = asked.select(*key, F.col("_start").alias("ts"), F.lit(-1).cast("bigint").alias("event_id")).distinct()
    marks = save_and_read(
        hits.select(*key, "ts", "event_id", "message", F.lit(1).alias("_hit")).unionByName(
            starts.withColumns({"message": F.lit(None).cast("string"), "_hit": F.lit(0)})
        ),
        "marks",
    )
    line = number_rows(marks, key, F.col("ts"), F.col("event_id"), out="_at", value="_hit", running="_before")
    first = line.filter("_hit = 0").select(*key, F.col("ts").alias("_start"), F.col("_before").alias("_from"))
    matched = line.filter("_hit = 1").select(*key, "ts", "message", F.col("_before").alias("_seq"))
    wanted = asked.join(first, [*key, "_start"]).withColumn(
        "_seq", F.explode(F.sequence(F.col("_from"), F.col("_from") + (limit - 1)))
    )
    few = wanted.join(matched.toDF(*matched.columns), [*key, "_seq"]).filter(F.col("ts") <= F.col("end_ts")).withColumnRenamed("_seq", "rank")
    packed = few.groupBy("_lookup").agg(F.array_sort(F.collect_list(F.struct("rank", "ts", "message"))).alias("_l"))
    lines = F.transform("_l", lambda x: F.concat(F.date_format(x["ts"], "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" "), x["message"]))
    found = packed.select("_lookup", F.size("_l").cast("bigint").alias("event_count"), lines.alias("sample_lines"))
    return asking.join(found, "_lookup").select("incident_id", "query_key", "event_count", "sample_lines")


def run_status_specs(specs: DataFrame, snapshots: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Health of planned status checks: ``incident_id, query_key, resource_type, resource_id, health, error``.

    The newest snapshot (``resource_type, resource_id, ts, health``), up to ``as_of`` if given, counts.
    Unknown resources are ``NotFound``; unsupported kinds give an error.
    """
    pair = ["resource_type", "resource_id"]
    states = snapshots.withColumn("resource_type", F.lower("resource_type"))
    if as_of is not None:
        states = states.filter(F.col("ts") <= as_of)
    newest = states.groupBy(*pair).agg(F.max_by("health", F.struct("ts", "health")).alias("_h"))
    asked = specs.select("incident_id", "query_key", F.lower("resource_type").alias("resource_type"), "resource_id")
    supported = F.col("resource_type").isin(*RESOURCE_KINDS)
    return asked.join(newest, pair, "left").select(
        "incident_id", "query_key", *pair,
        F.when(supported, F.coalesce("_h", F.lit("NotFound"))).alias("health"),
        F.when(~supported, F.concat(F.lit("Unsupported resource type: "), "resource_type")).alias("error"),
    )


def prefetch_union(metrics: DataFrame, logs: DataFrame, status: DataFrame) -> DataFrame:
    """Results of all planned look-ups of an incident: ``incident_id, category, query_key, result`` (JSON).

    ``metrics`` holds the datapoints of a query (about ten) packed in time order, or one row each; failed checks are dropped.
    """
    points = metrics
    if "datapoints" not in metrics.columns:
        points = metrics.groupBy("incident_id", "query_key").agg(F.array_sort(F.collect_list(F.struct("bucket", "value"))).alias("datapoints"))

    def part(df: DataFrame, category: str, *fields: str) -> DataFrame:
        return df.select("incident_id", F.lit(category).alias("category"), "query_key", F.to_json(F.struct(*fields)).alias("result"))

    return (
        part(points, "metrics", "datapoints")
        .unionByName(part(logs, "logs", "event_count", "sample_lines"))
        .unionByName(part(status.filter("error is null"), "status", "resource_type", "resource_id", "health"))
    )


def match_cached_query(questions: DataFrame, items: DataFrame, slots: str = "slots") -> DataFrame:
    """The cached item that answers each question: ``question_id, query_key, pos, result``.

    ``questions`` holds ``question_id, incident_id, category`` and JSON slots; ``items`` holds
    ``incident_id, category, pos, query_key, result``. The first item whose key contains a slot word of
    three or more letters wins, else the first item of the category.
    """
    spoken = F.filter(F.split(slot_text(F.col(slots)), r"\s+"), lambda w: F.char_length(w) > 2)
    asked = questions.select("question_id", "incident_id", "category", spoken.alias("_words"))
    joined = asked.join(items, ["incident_id", "category"])
    hit = F.exists("_words", lambda w: F.lower("query_key").contains(w))
    best = F.struct((~hit).alias("miss"), "pos")
    return joined.groupBy("question_id").agg(F.min_by(F.struct("query_key", "pos", "result"), best).alias("_i")).select(
        "question_id", "_i.*"
    )


def sample_lines(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], line: str = "message", k: int = SAMPLE_LINES) -> DataFrame:
    """``keys, sample``: the first ``k`` lines of each group by ``order``, joined by newlines. Null lines are left out of the text."""
    few = first_rows(rows, list(keys), list(order), k)
    packed = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(line).alias("line")))).alias("_l"))
    return packed.select(*keys, F.array_join("_l.line", "\n").alias("sample"))
