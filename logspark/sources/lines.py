"""Log lines: from files, from text columns, from stored tables; batches and admission."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.functions.text import text_lines

# Most lines and most characters (50 MB) accepted in one request.
MAX_LINES = 10_000
MAX_CHARS = 50 * 1024 * 1024


def lines_of_text(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per line of a text column: ``keys``, ``line_no`` from 0, ``line``."""
    return df.select(*keys, F.posexplode(text_lines(F.col(text))).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no").cast("bigint")
    )


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with ``source_id`` (the file) and ``line_no`` over the whole file.

    A large file is read in many splits. Lines are ranked inside their split and the line counts of
    the file's earlier splits are added, so no task sees more than one split.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_id"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.col("value").alias("line"),
    )
    sizes = lines.groupBy("source_id", "_split").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source_id").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("source_id", "_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    inside = Window.partitionBy("source_id", "_split").orderBy("_at")
    ranked = lines.withColumn("_at", F.monotonically_increasing_id()).withColumn(
        "_pos", F.row_number().over(inside) - 1
    )
    return ranked.join(starts, ["source_id", "_split"]).select(
        "source_id", (F.col("_skip") + F.col("_pos")).alias("line_no"), "line"
    )


def write_log_table(logs: DataFrame, path: str, ts: str = "ts", mode: str = "append") -> None:
    """Write log rows as parquet, one folder per day and sorted by source inside a file.

    Days are spread over many tasks by source, so one busy day is not one task.
    """
    dated = logs.withColumn("log_date", F.to_date(ts))
    tasks = int(logs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = dated.repartition("log_date", F.pmod(F.xxhash64("source_id", ts), F.lit(max(64, tasks))))
    spread.sortWithinPartitions("log_date", "source_id", ts).write.mode(mode).partitionBy("log_date").parquet(path)


def read_log_table(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """Read a log table; the time range prunes day folders and reaches the parquet scan."""
    table = spark.read.parquet(path)
    if start is not None:
        table = table.filter((F.col("log_date") >= F.to_date(F.lit(start))) & (F.col("ts") >= F.lit(start)))
    if end is not None:
        table = table.filter((F.col("log_date") <= F.to_date(F.lit(end))) & (F.col("ts") <= F.lit(end)))
    return table


def fetch_lookback(events: DataFrame, group: str, end: Column, lookback_minutes: int = 30) -> DataFrame:
    """Events of one log group in ``[end - lookback, end]``, both ends included."""
    start = end - F.expr(f"interval {int(lookback_minutes)} minutes")
    return events.filter((F.col("log_group") == group) & F.col("ts").between(start, end))


def fetch_lookbacks(events: DataFrame, requests: DataFrame, slot_minutes: int = 30) -> DataFrame:
    """:func:`fetch_lookback` for a table of requests ``run_id, log_group, end_ts, lookback_minutes``; each event once per request that covers it.

    Events and requests meet on the group and a slot of time, so a busy group is spread over its slots, and only the first and last slot of a request
    hold events outside it.
    """
    width = slot_minutes * 60
    slot = lambda ts: F.floor(F.unix_seconds(ts) / width)
    start = F.col("end_ts") - F.make_dt_interval(mins=F.col("lookback_minutes"))
    asked = requests.withColumn("_start", start).where("_start <= end_ts")
    asked = asked.withColumn("_slot", F.explode(F.sequence(slot(F.col("_start")), slot(F.col("end_ts")))))
    joined = events.withColumn("_slot", slot(F.col("ts"))).join(asked, ["log_group", "_slot"])
    return joined.filter(F.col("ts").between(F.col("_start"), F.col("end_ts"))).drop("_slot", "_start")


def resolve_log_groups(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """Expand patterns (column ``pattern``) over known groups (column ``log_group``), sorted.

    ``abc*`` is a prefix, with a slash before the star also cut; an exact name passes through even if
    it is unknown. Prefixes are matched by an equi-join: a name is cut to the prefix lengths in use.
    """
    starred = patterns.filter(F.col("pattern").endswith("*"))
    prefixes = starred.select(F.regexp_replace("pattern", r"\*+$", "").alias("prefix")).select(
        F.regexp_replace("prefix", "/+$", "").alias("prefix")
    ).distinct()
    lengths = prefixes.agg(F.collect_set(F.char_length("prefix")).alias("n")).scalar()
    cut = names.select("log_group").distinct().withColumn("_len", F.explode(lengths)).filter(
        F.col("_len") <= F.char_length("log_group")
    ).withColumn("prefix", F.expr("substring(log_group, 1, _len)"))
    hits = cut.join(prefixes, "prefix", "left_semi").select("log_group").filter(F.col("log_group") != "")
    exact = patterns.filter(~F.col("pattern").endswith("*")).select(F.col("pattern").alias("log_group"))
    return hits.union(exact).distinct().orderBy("log_group")


def dedupe_sources(first: DataFrame, *others: DataFrame, name: str = "log_group") -> DataFrame:
    """The distinct source names of several tables of hits; a null name is no source."""
    out = first.select(name)
    for more in others:
        out = out.union(more.select(name))
    return out.where(F.col(name).isNotNull()).distinct()


def admission_check(lines: DataFrame, requests: DataFrame, key: str = "request_id") -> DataFrame:
    """Status of each request: ``empty``, ``too_many_lines``, ``too_large`` or ``accepted``."""
    sizes = lines.groupBy(key).agg(
        F.count(F.lit(1)).alias("line_count"), F.sum(F.char_length("line")).alias("char_count")
    )
    joined = requests.select(key).distinct().join(sizes, key, "left")
    count, chars = F.coalesce("line_count", F.lit(0)), F.coalesce("char_count", F.lit(0))
    status = (
        F.when(count == 0, "empty").when(count > MAX_LINES, "too_many_lines").when(chars > MAX_CHARS, "too_large")
    ).otherwise("accepted")
    return joined.select(key, count.alias("line_count"), chars.alias("char_count"), status.alias("status"))


def batch_rows(lines: DataFrame, size: int, keys: Sequence[str] = ("source_id",)) -> DataFrame:
    """Chunks of ``size`` numbered lines; the last one of a source may be shorter."""
    batch = F.floor(F.col("line_no") / size).alias("batch_no")
    packed = lines.groupBy(*keys, batch).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    return packed.select(*keys, "batch_no", F.size("_l").alias("batch_size"), F.col("_l.line").alias("lines"))


def nonblank_sources(fetched: DataFrame, pushed: DataFrame) -> DataFrame:
    """Source texts to analyse: pushed text replaces a group's fetched text, blank texts are dropped.

    ``fetched`` and ``pushed`` hold ``log_group, text``. Only known groups are kept.
    """
    own = pushed.select("log_group", F.nullif("text", F.lit("")).alias("_pushed"))
    text = F.coalesce("_pushed", F.when(F.trim(F.regexp_replace("text", r"\s+", " ")) != "", F.col("text")))
    return fetched.join(own, "log_group", "left").select("log_group", text.alias("text")).filter(F.col("text").isNotNull())
