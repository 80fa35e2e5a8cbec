"""Streaming jobs (X rows): each reads its given table as a stream and runs until all of it is done."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import INCIDENTS, MESSAGE, Tables, oracle, query
from checks.learning import REWARDS
from checks.stores import UPDATES, pushed_events
from logspark.operators import bandit
from logspark.session import scratch_path
from logspark.sources.stores import live_rows
from logspark.streaming import jobs, state


def _stream(t: Tables, name: str):
    schema = t.spark.read.parquet(t.path(name)).schema
    # A pattern matches a table of one file as well as a folder of files.
    df = jobs.read_stream(t.spark, f"{t.path(name)[:-1]}[t]", schema)
    times = {f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.simpleString() == "timestamp_ntz"}
    return df.withColumns(times) if times else df


def _log_stream(t: Tables):
    return _stream(t, "events").select("event_id", "ts", F.concat(F.lit("/app/"), "event_type").alias("log_group"), F.expr(MESSAGE).alias("line"))


@query("stream_subscription", "SELECT conv_id, '/chat/' || conv_id AS log_group, text AS message FROM conversations WHERE contains(text, 'en')")
def stream_subscription(t: Tables):
    path = scratch_path(t.spark, "pushed")
    events = pushed_events(t)
    events.write.parquet(path)
    stream = jobs.subscription_stream(jobs.read_stream(t.spark, path, events.schema), "en")
    return jobs.run_to_table(stream).select("conv_id", "log_group", "message")


# Windows are kept up to date in update mode, the last ones included; sessions are only written once they have ended.


@query(
    "stream_sliding_scan",
    oracle(
        f"""SELECT make_timestamp(epoch_us(ts) // 1800000000 * 1800000000) AS window_start, log_group, count(*) AS line_count FROM (
              SELECT * FROM log_events WHERE epoch_us(ts) // 60000000 % 60 >= 30)
            GROUP BY 1, 2""",
        "log_events",
    ),
)
def stream_sliding_scan(t: Tables):
    scan = jobs.sliding_scan(_log_stream(t), [F.count(F.lit(1)).alias("line_count")])
    return jobs.run_latest(scan, ["window_start", "log_group"]).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "log_group", "line_count")


@query(
    "stream_error_burst",
    oracle(
        """SELECT * FROM (SELECT make_timestamp(epoch_us(ts) // 21600000000 * 21600000000) AS window_start, log_group, count(*) AS line_count,
             count(*) FILTER (regexp_matches(lower(message), 'error|exception|fatal')) AS error_count,
             count(*) FILTER (regexp_matches(lower(message), 'error|exception|fatal')) > count(*) * 0.3 AS burst FROM log_events GROUP BY 1, 2)""",
        "log_events",
    ),
)
def stream_error_burst(t: Tables):
    got = jobs.run_latest(jobs.error_burst_stream(_log_stream(t), "6 hours"), ["window_start", "log_group"])
    return got.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


TURNS = "SELECT conv_id, make_timestamp((1704067200 + conv_id * 3600 + turn * 60 + CASE WHEN turn >= 2 THEN 600 ELSE 0 END) * 1000000) AS ts FROM conversations"


@query(
    "stream_sessions",
    oracle(
        """SELECT conv_id, min(ts) AS session_start, max(ts) + INTERVAL 300 SECOND AS session_end, count(*) AS turns FROM (
             SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY ts) AS s FROM (
               SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY conv_id ORDER BY ts) + INTERVAL 300 SECOND THEN 1 ELSE 0 END AS opens FROM tu))
           GROUP BY conv_id, s HAVING max(ts) + INTERVAL 300 SECOND <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM tu)""",
        tu=TURNS,
    ),
)
def stream_sessions(t: Tables):
    late = F.when(F.col("turn") >= 2, 600).otherwise(0)
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 3600 + F.col("turn") * 60 + late)
    got = jobs.run_to_table(jobs.session_stream(_stream(t, "conversations").select("conv_id", at.alias("ts"))))
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("stream_ttl_state", "SELECT DISTINCT o_custkey AS id FROM orders")
def stream_ttl_state(t: Tables):
    records = _stream(t, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("ts"))
    # Longer than the table's time range, so that no record expires in between.
    return jobs.run_to_table(jobs.ttl_stream(records, "36500 days")).select("id")


@query(
    "stream_bandit",
    oracle("SELECT action_id, count(*) AS interactions, round(sum(reward), 4) AS total_reward, round(sum(x[1] * x[1]), 4) AS a00, round(sum(reward * x[5]), 4) AS b4 FROM r GROUP BY 1", "bandit_log", r=REWARDS),
)
def stream_bandit(t: Tables):
    got = jobs.run_bandit(_bandit_stream(t))
    return got.select("action_id", "interactions", *[F.round(c, 4).alias(c) for c in ("total_reward", "a00", "b4")])


def _bandit_stream(t: Tables):
    row = _stream(t, "lineitem")
    x = bandit.context_vector(F.col("l_suppkey") % 8, F.col("l_linenumber") % 4, F.col("l_suppkey") % 100, F.col("l_shipdate"))
    plans = row.select(
        F.array(((F.col("l_partkey") + F.col("l_linenumber")) % 8).cast("int")).alias("actions"), F.array(F.col("l_returnflag") == "R").alias("helpful"),
        (F.col("l_discount") * 10).alias("feedback_score"), x.alias("x"),
    )
    return bandit.apply_feedback(plans)


HEALTHY_SQL = "len(list_filter(regexp_split_to_array(rca, '\\n'), lambda x: starts_with(upper(trim(x)), 'STATUS:') AND contains(upper(x), 'HEALTHY'))) > 0"


@query("stream_notify", oracle(f"SELECT incident_id FROM incidents WHERE NOT ({HEALTHY_SQL} AND trigger_type = 'schedule')", "incidents"))
def stream_notify(t: Tables):
    from pyspark.sql import DataFrame

    def view(df: DataFrame) -> DataFrame:
        text = INCIDENTS.replace("SELECT ", "", 1)
        return df.selectExpr(*_columns(text.rsplit("FROM orders", 1)[0]))

    analyses = view(_stream(t, "orders")).withColumnRenamed("rca", "analysis")
    return jobs.run_notify(analyses).select("incident_id")


def _columns(text: str) -> list[str]:
    """Split a select list at its outer commas."""
    parts, depth, start, quoted = [], 0, 0, False
    for i, c in enumerate(text):
        quoted ^= c == "'"
        if not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                parts.append(text[start:i].strip())
                start = i + 1
    return [*parts, text[start:].strip()]


@query(
    "stream_upsert",
    oracle("SELECT incident_id, prefetch_status, cached_data FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY ts DESC, prefetch_status DESC, cached_data DESC) AS place FROM up) WHERE place = 1", up=UPDATES),
)
def stream_upsert(t: Tables):
    text = UPDATES.replace("SELECT ", "", 1).rsplit("FROM lineitem", 1)[0]
    return jobs.run_upsert(_stream(t, "lineitem").selectExpr(*_columns(text))).select("incident_id", "prefetch_status", "cached_data")


@query(
    "stream_open_sessions",
    oracle(
        """SELECT conv_id, min(ts) AS session_start, max(ts) + INTERVAL 300 SECOND AS session_end, count(*) AS turns FROM (
             SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY ts) AS s FROM (
               SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY conv_id ORDER BY ts) + INTERVAL 300 SECOND THEN 1 ELSE 0 END AS opens FROM tu))
           GROUP BY conv_id, s""",
        tu=TURNS,
    ),
)
def stream_open_sessions(t: Tables):
    late = F.when(F.col("turn") >= 2, 600).otherwise(0)
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 3600 + F.col("turn") * 60 + late)
    got = state.run_sessions(_stream(t, "conversations").select("conv_id", at.alias("ts")))
    return got.select("conv_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")), "turns")


# A record lives for 200 days: most customers' orders expire and come back.
LIFE_DAYS = 200


@query(
    "stream_ttl_expiry",
    f"""WITH RECURSIVE e AS (
          SELECT o_custkey AS id, min(o_orderdate) AS ts FROM orders GROUP BY 1
          UNION ALL SELECT id, nts FROM (SELECT e.id, min(o.o_orderdate) AS nts FROM e JOIN orders o ON o.o_custkey = e.id AND o.o_orderdate >= e.ts + INTERVAL {LIFE_DAYS} DAY GROUP BY e.id, e.ts))
        SELECT id, ts, ts + INTERVAL {LIFE_DAYS} DAY > (SELECT max(o_orderdate) FROM orders) AS lives FROM e""",
)
def stream_ttl_expiry(t: Tables):
    records = _stream(t, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    got = state.run_sightings(records, LIFE_DAYS * 86_400)
    live = live_rows(got, t.orders.agg(F.max(F.col("o_orderdate").cast("timestamp"))).scalar()).select("id", "ts", F.lit(True).alias("lives"))
    both = got.select("id", "ts").join(live, ["id", "ts"], "left")
    return both.select("id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.coalesce("lives", F.lit(False)).alias("lives"))
