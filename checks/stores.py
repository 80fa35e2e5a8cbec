"""Sources, sinks and stored tables (S rows), and the incident plans over them (E7-E9)."""

from __future__ import annotations

import base64
import gzip
import json
import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from checks.base import Tables, oracle, query
from logspark.functions import reports
from logspark.operators import lookups, training
from logspark.plans import incidents as plans
from logspark.session import scratch_path
from logspark.sources import lines, stores, triggers
from logspark.sources.registry import CalibrationLog, ReportTables, join_reports


@query(
    "log_tables",
    oracle(
        """SELECT event_id, source_id, line FROM lines WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20 18:30:00'""",
        "lines",
    ),
)
def log_tables(t: Tables):
    path = scratch_path(t.spark, "logs")
    lines.write_log_table(t.lines(), path)
    return lines.read_log_table(t.spark, path, "2024-01-05 06:00:00", "2024-01-20 18:30:00").select("event_id", "source_id", "line")


@query(
    "fetch_lookback",
    oracle(
        """SELECT event_id, message FROM log_events WHERE log_group = '/app/error'
             AND ts BETWEEN (SELECT max(ts) FROM events) - INTERVAL 3000 MINUTE AND (SELECT max(ts) FROM events)""",
        "log_events",
    ),
)
def fetch_lookback(t: Tables):
    end = t.events.agg(F.max("ts")).scalar()
    return lines.fetch_lookback(t.log_events(), "/app/error", end, 3000).select("event_id", "message")


@query(
    "resolve_log_groups",
    """WITH names AS (SELECT DISTINCT '/aws/' || lower(replace(c_mktsegment, ' ', '')) || '/' || c_nationkey AS g FROM customer),
         pats AS (SELECT DISTINCT '/aws/' || lower(substr(o_orderpriority, 3, 1)) || '*' AS p FROM orders
           UNION SELECT '/aws/mach*' UNION SELECT '/aws/building/*' UNION SELECT '/not/known' UNION SELECT n_name FROM nation)
       SELECT DISTINCT log_group FROM (
         SELECT g AS log_group FROM names JOIN pats ON p LIKE '%*' AND starts_with(g, rtrim(rtrim(p, '*'), '/'))
         UNION SELECT p FROM pats WHERE p NOT LIKE '%*')""",
)
def resolve_log_groups(t: Tables):
    names = t.customer.select(
        F.concat_ws("/", F.lit("/aws"), F.lower(F.replace("c_mktsegment", F.lit(" "), F.lit(""))), "c_nationkey").alias("log_group")
    )
    pats = t.orders.select(F.concat(F.lit("/aws/"), F.lower(F.substring("o_orderpriority", 3, 1)), F.lit("*")).alias("pattern"))
    fixed = t.nation.select(F.explode(F.array(F.lit("/aws/mach*"), F.lit("/aws/building/*"), F.lit("/not/known"), "n_name")))
    return lines.resolve_log_groups(names, pats.union(fixed))


@query(
    "dedupe_sources",
    "SELECT DISTINCT '/app/' || event_type AS log_group FROM events UNION SELECT DISTINCT '/doc/' || source FROM documents",
)
def dedupe_sources(t: Tables):
    a = t.events.select(F.concat(F.lit("/app/"), "event_type").alias("log_group"))
    return lines.dedupe_sources(a, t.documents.select(F.concat(F.lit("/doc/"), "source").alias("log_group")))


@F.pandas_udf(StringType())
def _pack(payloads: pd.Series) -> pd.Series:
    def event(text: str) -> str:
        data = base64.b64encode(gzip.compress(text.encode("utf-8"), mtime=0)).decode("ascii")
        return json.dumps({"awslogs": {"data": data}})

    return payloads.map(event)


def pushed_events(t: Tables):
    """One pushed payload per conversation; every turn is a message."""
    turn = F.struct(F.col("turn").cast("string").alias("id"), (F.col("turn") * 1000).alias("timestamp"), F.col("text").alias("message"))
    packed = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("logEvents"))
    group = F.concat(F.lit("/chat/"), F.col("conv_id").cast("string")).alias("logGroup")
    return packed.select("conv_id", _pack(F.to_json(F.struct(group, "logEvents"))).alias("event"))


@query("decode_subscription", "SELECT conv_id, '/chat/' || conv_id AS log_group, turn * 1000 AS timestamp_ms, text AS message FROM conversations")
def decode_subscription(t: Tables):
    return triggers.decode_subscription(pushed_events(t)).select("conv_id", "log_group", "timestamp_ms", "message")


EVENT_JSON = """SELECT event_id, CASE event_type
  WHEN 'error' THEN concat('{"detail-type": "CloudWatch Alarm State Change", "detail": {"alarmName": "HighLatency-', user_id, '", "state": {"reason": "value ', event_id, '"}}}')
  WHEN 'signup' THEN '{"detail-type": "CloudWatch Alarm State Change", "detail": {}}'
  WHEN 'purchase' THEN concat('{"awslogs": {"data": "', event_id, '"}, "detail-type": "CloudWatch Alarm State Change"}')
  WHEN 'view' THEN '{"detail-type": "Scheduled Event", "detail": {}}' ELSE '{}' END AS event FROM events"""


@query(
    "route_trigger_events",
    oracle(
        """SELECT event_id, CASE WHEN json_exists(event, '$.awslogs') THEN 'subscription'
             WHEN contains(coalesce(event ->> '$."detail-type"', ''), 'CloudWatch Alarm') THEN 'alarm' ELSE 'schedule' END AS trigger_type,
             CASE WHEN json_exists(event, '$.awslogs') OR NOT contains(coalesce(event ->> '$."detail-type"', ''), 'CloudWatch Alarm') THEN NULL
               ELSE coalesce(event ->> '$.detail.alarmName', 'Unknown') END AS alarm_name,
             CASE WHEN json_exists(event, '$.awslogs') OR NOT contains(coalesce(event ->> '$."detail-type"', ''), 'CloudWatch Alarm') THEN NULL
               ELSE coalesce(event ->> '$.detail.state.reason', '') END AS alarm_reason,
             CASE WHEN json_exists(event, '$.awslogs') THEN NULL ELSE 30 END::BIGINT AS lookback_minutes FROM j""",
        j=EVENT_JSON,
    ),
)
def route_trigger_events(t: Tables):
    return triggers.route_trigger_events(t.sql(EVENT_JSON, "events")).drop("event")


# Incident items as exported: tagged attribute values.
ITEMS = """SELECT o_orderkey, concat('{"incident_id": {"S": "', o_orderkey, '"}, "rca": {"S": "STATUS: High"}, "ttl": {"N": "', o_custkey, '"},
  "prefetch_status": {"S": "', CASE o_orderstatus WHEN 'F' THEN 'complete' ELSE 'pending' END, '"}, "log_groups": {"L": [{"S": "/a"}, {"S": "', o_orderpriority, '"}]},
  "cached_data": {"S": "', CASE o_orderstatus WHEN 'F' THEN '[1, 2]' WHEN 'O' THEN 'not json' ELSE '{}' END, '"},
  "anomalous_logs": {"L": [{"S": "plain ', o_orderpriority, '"}, {"M": {"text": {"S": "text ', o_custkey, '"}, "log": {"S": "unused"}}}, {"M": {"other": {"N": "1"}}}]},
  "is_critical": {"BOOL": ', CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END, '}, "needs_escalation": {"BOOL": ', CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END, '}',
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat(', "confidence": {"N": "0.', o_orderkey % 10, '"}') END, '}') AS item FROM orders"""


@query(
    "import_incident_export",
    """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS incident_id, CAST(o_custkey AS VARCHAR) AS ttl,
         CASE o_orderstatus WHEN 'F' THEN 'complete' ELSE 'pending' END AS prefetch_status, '/a,' || o_orderpriority AS log_groups,
         o_orderstatus <> 'O' AS decoded FROM orders""",
)
def import_incident_export(t: Tables):
    got = stores.import_incident_export(t.sql(ITEMS, "orders"))
    return got.select(
        "o_orderkey", "incident_id", "ttl", "prefetch_status", F.array_join("log_groups", ",").alias("log_groups"),
        F.col("cached_data").isNotNull().alias("decoded"),
    )


LABEL = """CASE WHEN o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0 THEN 'INFO' WHEN o_orderkey % 2 <> 0 THEN 'WARNING'
  WHEN o_orderkey % 5 = 0 OR o_orderkey % 10 < 8 THEN 'HIGH' ELSE 'CRITICAL' END"""
TRAIN = f"SELECT CAST(o_orderkey AS VARCHAR) AS record_id, 'plain ' || o_orderpriority || ' text ' || o_custkey AS text, {LABEL} AS label FROM orders"


@query("training_data_job", TRAIN)
def training_data_job(t: Tables):
    return plans.training_data(t.sql(ITEMS, "orders").select("item"))


@query("label_distribution", oracle(f"SELECT l AS label, (SELECT count(*) FROM tr WHERE tr.label = l) AS count FROM (VALUES ('INFO'), ('WARNING'), ('HIGH'), ('CRITICAL')) v(l)", tr=TRAIN))
def label_distribution(t: Tables):
    return stores.label_distribution(plans.training_data(t.sql(ITEMS, "orders").select("item")))


@query("dataset_writer", oracle("SELECT text, label FROM tr", tr=TRAIN))
def dataset_writer(t: Tables):
    path = scratch_path(t.spark, "dataset")
    stores.write_dataset(plans.training_data(t.sql(ITEMS, "orders").select("item")), path)
    return t.spark.read.schema("text string, label string").json(f"{path}/samples")


RECORDS = """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN concat('{"message": "m ', l_comment_key, '", "text": "t"}')
  WHEN 1 THEN concat('{"log": "l ', l_comment_key, '"}') WHEN 2 THEN concat('"s ', l_comment_key, '"') ELSE '{"x": 1}' END AS entry
  FROM (SELECT *, l_suppkey AS l_comment_key FROM lineitem)"""


@query(
    "concat_record_logs",
    """SELECT l_orderkey, coalesce(string_agg(CASE l_linenumber % 4 WHEN 0 THEN 'm ' || l_suppkey WHEN 1 THEN 'l ' || l_suppkey
         WHEN 2 THEN 's ' || l_suppkey END, ' ' ORDER BY l_linenumber, l_suppkey, l_partkey), '') AS text FROM lineitem GROUP BY 1""",
)
def concat_record_logs(t: Tables):
    base = t.lineitem.withColumn("l_comment_key", F.col("l_suppkey"))
    k = F.col("l_linenumber") % 4
    key = F.col("l_suppkey").cast("string")
    entry = (
        F.when(k == 0, F.concat(F.lit('{"message": "m '), key, F.lit('", "text": "t"}')))
        .when(k == 1, F.concat(F.lit('{"log": "l '), key, F.lit('"}')))
        .when(k == 2, F.concat(F.lit('"s '), key, F.lit('"')))
        .otherwise(F.lit('{"x": 1}'))
    )
    packed = base.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", entry.alias("e")))).alias("l")
    )
    return packed.select("l_orderkey", reports.concat_record_logs(F.col("l.e")).alias("text"))


@query(
    "usable_training_text",
    oracle("SELECT doc_id, line_no FROM l WHERE length(line) >= 10", l="""SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents"""),
)
def usable_training_text(t: Tables):
    split = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return training.usable_training_text(split, "line").select("doc_id", F.col("line_no").cast("bigint").alias("line_no"))


@query(
    "feedback_store",
    """SELECT CAST(o_orderkey AS VARCHAR) AS feedback_id, CASE WHEN o_orderkey % 4 = 0 THEN 5 ELSE CAST(o_orderkey % 11 AS INT) END AS suggestion_quality,
         CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 0.25 END::DOUBLE AS relevance_score, o_orderkey % 2 = 0 AS was_helpful, 5 AS overall_satisfaction
       FROM orders WHERE o_orderstatus <> 'P'""",
)
def feedback_store(t: Tables):
    key = F.col("o_orderkey")
    body = F.to_json(
        F.struct(
            key.cast("string").alias("feedback_id"),
            F.when(key % 4 != 0, key % 11).alias("suggestion_quality"),
            F.when(key % 3 != 0, 0.25).alias("relevance_score"),
            F.when(key % 2 == 0, True).alias("was_helpful"),
        )
    )
    value = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("{broken "), body)).otherwise(body)
    path = scratch_path(t.spark, "feedback")
    t.orders.select(value.alias("value")).write.text(path)
    return stores.read_feedback(t.spark, path).select(
        "feedback_id", "suggestion_quality", "relevance_score", "was_helpful", "overall_satisfaction"
    )


# Updates of incidents: every line of an order updates its incident.
UPDATES = """SELECT l_orderkey AS incident_id, l_shipdate AS ts, concat('part ', l_partkey) AS cached_data,
  CASE WHEN l_returnflag = 'R' THEN concat('failed-', l_linenumber) ELSE concat('complete-', l_linenumber) END AS prefetch_status FROM lineitem"""


@query(
    "incident_upsert",
    oracle(
        """SELECT i.incident_id, epoch(i.ts)::BIGINT + 604800 AS ttl, u.cached_data, coalesce(u.prefetch_status, 'pending') AS prefetch_status
           FROM incidents i LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY ts DESC, prefetch_status DESC, cached_data DESC) AS place FROM up) u
             ON u.incident_id = i.incident_id AND place = 1""",
        "incidents",
        up=UPDATES,
    ),
)
def incident_upsert(t: Tables):
    updates = t.sql(UPDATES, "lineitem")
    # One row per incident, time and status, so that the newest is unique.
    single = updates.groupBy("incident_id", "ts", "prefetch_status").agg(F.max("cached_data").alias("cached_data"))
    return stores.upsert_incidents(stores.new_incidents(t.incidents()), single).select("incident_id", "ttl", "cached_data", "prefetch_status")


@query(
    "latest_by_key",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey
         ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS place FROM lineitem) WHERE place = 1""",
)
def latest_by_key(t: Tables):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return stores.latest_by_key(rows, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]).drop("l_shipdate")


@query(
    "calibration_registry",
    """SELECT l_suppkey % 5 AS model_id, round(max_by(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_partkey)), 4) AS threshold, count(*) AS versions
       FROM lineitem GROUP BY 1""",
)
def calibration_registry(t: Tables):
    rows = t.lineitem.select((F.col("l_suppkey") % 5).alias("model_id"), "l_extendedprice", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    active = stores.latest_by_key(rows, ["model_id"], order)
    versions = rows.groupBy("model_id").agg(F.count(F.lit(1)).alias("versions"))
    return active.join(versions, "model_id").select("model_id", F.round("l_extendedprice", 4).alias("threshold"), "versions")


@query(
    "forecast_alert_sink",
    """SELECT l_orderkey, l_linenumber, l_discount * 5 AS breach_probability, epoch(m)::BIGINT + 86400 AS ttl
       FROM lineitem, (SELECT max(l_shipdate) AS m FROM lineitem) WHERE l_discount * 5 > 0.3""",
)
def forecast_alert_sink(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_discount") * 5).alias("breach_probability"))
    return stores.forecast_alerts(rows, t.lineitem.agg(F.max("l_shipdate")).scalar())


@query(
    "notification_table",
    oracle(
        """SELECT incident_id, substr('Logspark - ' || label, 1, 100) AS subject,
             'Trigger: ' || label || chr(10) || 'Time: ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' || chr(10) || chr(10) || rca AS body
           FROM (SELECT *, CASE trigger_type WHEN 'alarm' THEN 'Alarm: ' || coalesce(nullif(alarm_name, ''), 'Unknown')
             WHEN 'subscription' THEN 'Subscription filter match' ELSE 'Scheduled scan' END AS label FROM incidents)""",
        "incidents",
    ),
)
def notification_table(t: Tables):
    return stores.notifications(t.incidents().withColumnRenamed("rca", "analysis")).select("incident_id", "subject", "body")


@query(
    "admission_check",
    """SELECT c_custkey AS request_id, coalesce(n, 0) AS line_count, coalesce(c, 0)::BIGINT AS char_count,
         CASE WHEN n IS NULL THEN 'empty' WHEN n > 10000 THEN 'too_many_lines' WHEN c > 52428800 THEN 'too_large' ELSE 'accepted' END AS status
       FROM customer LEFT JOIN (SELECT user_id, count(*) AS n, sum(length(props)) AS c FROM events GROUP BY 1) ON user_id = c_custkey""",
)
def admission_check(t: Tables):
    rows = t.events.select(F.col("user_id").alias("request_id"), F.col("props").alias("line"))
    return lines.admission_check(rows, t.customer.select(F.col("c_custkey").alias("request_id")))


FETCHED = """SELECT o_orderkey, concat('/app/', o_orderkey) AS log_group, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat(' ', chr(10), ' ')
  ELSE concat('line of ', o_custkey) END AS text FROM orders"""
PUSHED = "SELECT concat('/app/', l_orderkey) AS log_group, concat('pushed ', max(l_suppkey)) AS text FROM lineitem GROUP BY l_orderkey HAVING max(l_linenumber) >= 5"


@query(
    "nonblank_sources",
    oracle(
        "SELECT log_group, coalesce(p.text, f.text) AS text FROM f LEFT JOIN p USING (log_group) WHERE p.text IS NOT NULL OR trim(replace(f.text, chr(10), ' ')) <> ''",
        f=FETCHED,
        p=PUSHED,
    ),
)
def nonblank_sources(t: Tables):
    fetched = t.sql(FETCHED, "orders").select("log_group", "text")
    return lines.nonblank_sources(fetched, t.sql(PUSHED, "lineitem"))


@query(
    "report_log_join",
    oracle(
        """SELECT r.event_id, e.source_id, e.message, r.severity FROM log_events e JOIN (
             SELECT event_id, CASE WHEN value > 100 THEN 'HIGH' ELSE 'INFO' END AS severity FROM events) r USING (event_id)""",
        "log_events",
    ),
)
def report_log_join(t: Tables):
    verdicts = t.events.select("event_id", F.when(F.col("value") > 100, "HIGH").otherwise("INFO").alias("severity"))
    joined = join_reports(verdicts.withColumnRenamed("event_id", "log_id"), t.log_events().withColumnRenamed("event_id", "log_id"))
    return joined.select(F.col("log_id").alias("event_id"), "source_id", "message", "severity")


# Look-up specs: one of each kind per incident that was triggered by an alarm or a push.
END = "TIMESTAMP '2024-01-15 12:00:00'"
KIND = "CASE o_custkey % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'view' WHEN 2 THEN 'click' WHEN 3 THEN 'signup' ELSE 'purchase' END"
STAT = "CASE o_orderkey % 5 WHEN 0 THEN 'Average' WHEN 1 THEN 'Sum' WHEN 2 THEN 'Minimum' WHEN 3 THEN 'Maximum' ELSE 'SampleCount' END"
PERIOD = "CAST(60 + o_orderkey % 7 * 300 AS BIGINT)"
SPECS = f"""SELECT o_orderkey AS incident_id, {END} + o_custkey % 100 * INTERVAL '1' HOUR AS end_ts, concat('key ', o_custkey) AS query_key,
  concat('App/', upper({KIND})) AS namespace, 'Latency' AS metric_name, concat('user-', o_orderkey % 20) AS resource, {STAT} AS stat, {PERIOD} AS period_minutes,
  concat('/app/', {KIND}) AS log_group, CASE o_orderkey % 4 WHEN 0 THEN 'ERROR connection' WHEN 1 THEN '?FATAL ?Timeout' WHEN 2 THEN '' ELSE 'request' END AS filter_pattern,
  CASE o_orderkey % 6 WHEN 0 THEN 'RDS' WHEN 1 THEN 'lambda' WHEN 2 THEN 'ec2' WHEN 3 THEN 'ecs' WHEN 4 THEN 'queue' ELSE 'rds' END AS resource_type,
  concat('r-', o_custkey) AS resource_id FROM orders"""
SNAPSHOTS = """SELECT CASE l_suppkey % 4 WHEN 0 THEN 'rds' WHEN 1 THEN 'lambda' WHEN 2 THEN 'ec2' ELSE 'ecs' END AS resource_type,
  concat('r-', l_orderkey % 3000) AS resource_id, l_shipdate AS ts, concat('state ', l_quantity) AS health FROM lineitem"""
SECONDS = "greatest(period_minutes * 60 // 10, 60)"
STAT_SQL = """CASE any_value(stat) WHEN 'Average' THEN avg(value) WHEN 'Sum' THEN sum(value) WHEN 'Minimum' THEN min(value)
  WHEN 'Maximum' THEN max(value) ELSE count(value) END"""
POINTS = f"""SELECT incident_id, query_key, make_timestamp((epoch_us(ts) // 1000000 // {SECONDS} * {SECONDS}) * 1000000) AS bucket, {STAT_SQL} AS value
  FROM specs s JOIN metrics m USING (namespace, metric_name, resource)
  WHERE ts BETWEEN end_ts - to_minutes(period_minutes) AND end_ts GROUP BY 1, 2, 3"""


def _specs(t: Tables):
    return t.sql(SPECS, "orders").withColumn("dimensions", F.create_map(F.lit("user"), F.col("resource")))


def _metrics(t: Tables):
    return t.metrics().withColumn("dimensions", F.create_map(F.lit("user"), F.col("resource"), F.lit("zone"), F.lit("a")))


@query(
    "metric_statistics",
    oracle(
        """SELECT namespace, metric_name, resource, make_timestamp((epoch_us(ts) // 1000000 // 360 * 360) * 1000000) AS bucket, round(avg(value), 6) AS value
           FROM metrics GROUP BY ALL""",
        "metrics",
    ),
)
def metric_statistics(t: Tables):
    got = lookups.metric_statistics(t.metrics(), 60, "Average")
    return got.withColumns({"value": F.round("value", 6), "bucket": F.col("bucket").cast("timestamp_ntz")})


@query("run_metric_specs", oracle("SELECT incident_id, query_key, bucket, round(value, 6) AS value FROM p", "metrics", specs=SPECS, p=POINTS))
def run_metric_specs(t: Tables):
    got = lookups.run_metric_specs(_specs(t).drop("resource"), _metrics(t).drop("resource"))
    return got.withColumns({"value": F.round("value", 6), "bucket": F.col("bucket").cast("timestamp_ntz")})


LOG_HIT = """CASE filter_pattern WHEN 'ERROR connection' THEN contains(message, 'ERROR') AND contains(message, 'connection')
  WHEN '?FATAL ?Timeout' THEN contains(message, 'FATAL') OR contains(message, 'Timeout') WHEN '' THEN true ELSE contains(message, 'request') END"""
SAMPLES = f"""SELECT incident_id, query_key, count(*) AS event_count,
    string_agg(strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' ' || message, chr(10) ORDER BY place) AS sample FROM (
  SELECT *, row_number() OVER (PARTITION BY incident_id, query_key ORDER BY ts, event_id) AS place FROM specs s JOIN log_events e USING (log_group)
  WHERE ts BETWEEN end_ts - to_minutes(period_minutes) AND end_ts AND {LOG_HIT}) WHERE place <= 50 GROUP BY 1, 2"""


@query("run_log_specs", oracle("SELECT * FROM p", "log_events", specs=SPECS, p=SAMPLES))
def run_log_specs(t: Tables):
    got = lookups.run_log_specs(_specs(t).withColumnRenamed("period_minutes", "lookback_minutes"), t.log_events())
    return got.select("incident_id", "query_key", "event_count", F.array_join("sample_lines", "\n").alias("sample"))


@query(
    "sample_lines",
    oracle(
        """SELECT log_group, string_agg(message, chr(10) ORDER BY place) AS sample FROM (
             SELECT *, row_number() OVER (PARTITION BY log_group ORDER BY ts, event_id) AS place FROM log_events) WHERE place <= 50 GROUP BY 1""",
        "log_events",
    ),
)
def sample_lines(t: Tables):
    return lookups.sample_lines(t.log_events(), ["log_group"], [F.asc("ts"), F.asc("event_id")])


STATUS = """SELECT incident_id, query_key, lower(s.resource_type) AS resource_type, s.resource_id,
    CASE WHEN lower(s.resource_type) IN ('lambda', 'rds', 'ecs', 'ec2') THEN coalesce(n.health, 'NotFound') END AS health,
    CASE WHEN lower(s.resource_type) NOT IN ('lambda', 'rds', 'ecs', 'ec2') THEN 'Unsupported resource type: ' || lower(s.resource_type) END AS error
  FROM specs s LEFT JOIN (SELECT resource_type, resource_id, max_by(health, (ts, health)) AS health FROM snaps GROUP BY 1, 2) n
    ON n.resource_type = lower(s.resource_type) AND n.resource_id = s.resource_id"""


@query("run_status_specs", oracle("SELECT * FROM p", specs=SPECS, snaps=SNAPSHOTS.replace("l_quantity", "CAST(l_quantity AS INT)"), p=STATUS))
def run_status_specs(t: Tables):
    return lookups.run_status_specs(_specs(t), _snapshots(t))


def _snapshots(t: Tables):
    return t.sql(SNAPSHOTS.replace("l_quantity", "CAST(l_quantity AS INT)"), "lineitem")


UNION = """SELECT incident_id, 'metrics' AS category, query_key, count(*) AS size FROM points GROUP BY 1, 2, 3
  UNION ALL SELECT incident_id, 'logs', query_key, event_count FROM samples UNION ALL
  SELECT incident_id, 'status', query_key, length(health) FROM status WHERE error IS NULL"""
LOOKUPS = dict(specs=SPECS, snaps=SNAPSHOTS.replace("l_quantity", "CAST(l_quantity AS INT)"), points=POINTS, samples=SAMPLES, status=STATUS)


def _sizes(df):
    got = F.try_parse_json("result")
    points = F.size(F.try_variant_get(got, "$.datapoints", "array<variant>")).cast("bigint")
    size = (
        F.when(F.col("category") == "metrics", points)
        .when(F.col("category") == "logs", F.try_variant_get(got, "$.event_count", "bigint"))
        .otherwise(F.char_length(F.try_variant_get(got, "$.health", "string")).cast("bigint"))
    )
    return df.withColumn("size", size).drop("result")


# Stored plan replies that ask for the same look-ups.
def _replies(t: Tables):
    s = _specs(t)
    metric = F.struct("query_key", "namespace", "metric_name", "dimensions", "stat", "period_minutes")
    log = F.struct("query_key", "log_group", "filter_pattern", F.col("period_minutes").alias("lookback_minutes"))
    status = F.struct("query_key", "resource_type", "resource_id")
    body = F.to_json(F.struct(F.array(metric).alias("metrics"), F.array(log).alias("log_queries"), F.array(status).alias("status_checks")))
    k = F.col("incident_id") % 10
    reply = (
        F.when(k == 0, F.lit(None).cast("string"))
        .when(k == 1, F.lit("no plan"))
        .when(k < 5, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(body)
    )
    return s.select("incident_id", "end_ts", reply.alias("reply"))


@query("prefetch_union", oracle(f"SELECT * FROM u WHERE incident_id % 10 > 1", "metrics", "log_events", **LOOKUPS, u=UNION))
def prefetch_union(t: Tables):
    got = plans.run_plans(_replies(t), _metrics(t).drop("resource"), t.log_events(), _snapshots(t))
    return _sizes(got)


@query(
    "incident_prefetch",
    oracle(
        """SELECT i.incident_id, CASE WHEN i.incident_id % 10 = 0 THEN 'failed' ELSE 'complete' END AS prefetch_status, coalesce(n, 0) AS results
           FROM incidents i LEFT JOIN (SELECT incident_id, count(*) AS n FROM u WHERE incident_id % 10 > 1 GROUP BY 1) USING (incident_id)""",
        "metrics", "log_events", "incidents", **LOOKUPS, u=UNION,
    ),
)
def incident_prefetch(t: Tables):
    got = plans.incident_prefetch(
        stores.new_incidents(t.incidents()), _replies(t), _metrics(t).drop("resource"), t.log_events(), _snapshots(t)
    )
    n = F.size(F.try_variant_get(F.try_parse_json("cached_data"), "$", "array<variant>")).cast("bigint")
    return got.select("incident_id", "prefetch_status", n.alias("results"))


# Cached items: the parts of an order; questions: one per order.
CACHED = """SELECT l_orderkey AS incident_id, CASE l_linenumber % 3 WHEN 0 THEN 'metrics' WHEN 1 THEN 'logs' ELSE 'status' END AS category,
  CAST(l_linenumber * 1000000 + l_partkey AS BIGINT) AS pos, concat('Part ', p_type, ' ', p_brand) AS query_key, concat('result ', l_partkey) AS result
  FROM lineitem JOIN part ON p_partkey = l_partkey"""
QUESTIONS = """SELECT o_orderkey AS question_id, o_orderkey AS incident_id, CASE o_orderkey % 5 WHEN 0 THEN 'CheckMetrics' WHEN 1 THEN 'CheckLogs'
  WHEN 2 THEN 'CheckStatus' WHEN 3 THEN 'Summarize' ELSE 'CheckMetrics' END AS intent,
  CASE o_orderkey % 3 WHEN 0 THEN '{}' ELSE concat('{"a": {"value": {"interpretedValue": "STEEL"}}, "b": null, "resource": {"value": {"interpretedValue": "of Brand#', o_custkey % 5 + 1, '"}}}') END AS slots
  FROM orders"""
ASKED = """SELECT question_id, incident_id, CASE intent WHEN 'CheckMetrics' THEN 'metrics' WHEN 'CheckLogs' THEN 'logs' WHEN 'CheckStatus' THEN 'status' END AS category,
  CASE WHEN slots = '{}' THEN '' ELSE lower(json_extract_string(slots, '$.a.value.interpretedValue') || ' ' || json_extract_string(slots, '$.resource.value.interpretedValue')) END AS words FROM q"""
MATCH = """SELECT question_id, query_key, pos, result FROM (SELECT question_id, query_key, pos, result, row_number() OVER (PARTITION BY question_id ORDER BY
    CASE WHEN words <> '' AND len(list_filter(string_split(words, ' '), lambda w: length(w) > 2 AND contains(lower(query_key), w))) > 0 THEN 0 ELSE 1 END, pos) AS place
  FROM a JOIN c USING (incident_id, category)) WHERE place = 1"""


@query("match_cached_query", oracle("SELECT * FROM m", c=CACHED, q=QUESTIONS, a=ASKED, m=MATCH))
def match_cached_query(t: Tables):
    names = F.create_map(*[F.lit(v) for pair in plans.CATEGORIES.items() for v in pair])
    asked = t.sql(QUESTIONS, "orders").withColumn("category", F.try_element_at(names, F.col("intent"))).filter("category is not null")
    return lookups.match_cached_query(asked, _cached(t))


def _cached(t: Tables):
    return t.sql(CACHED.replace("JOIN part ", "JOIN (SELECT * FROM part) "), "lineitem", "part")


@query(
    "answer_context",
    oracle(
        """SELECT question_id, CASE WHEN m.result IS NOT NULL OR n > 0 THEN 'cache' ELSE 'none' END AS source,
             CASE WHEN m.result IS NOT NULL THEN m.result WHEN n > 0 THEN 'items' ELSE 'No data available.' END AS data
           FROM a LEFT JOIN m USING (question_id) LEFT JOIN (SELECT incident_id, count(*) AS n FROM c GROUP BY 1) k ON k.incident_id = a.incident_id AND category IS NULL""",
        c=CACHED, q=QUESTIONS, a=ASKED, m=MATCH,
    ),
)
def answer_context(t: Tables):
    got = plans.answer_context(t.sql(QUESTIONS, "orders"), _cached(t), _metrics(t).drop("resource"), t.events.agg(F.max("ts")).scalar())
    data = F.when(F.col("data").startswith("[{"), F.lit("items")).otherwise(F.col("data"))
    return got.withColumn("data", data)


@query(
    "briefing_once",
    "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS briefing FROM conversations",
)
def briefing_once(t: Tables):
    return plans.briefing_once(t.conversations).select("conv_id", "turn", "briefing")


@query(
    "triage_reports",
    oracle(
        """SELECT event_id * 10 + k AS report_id, event_id AS log_id, CASE WHEN value > 100 THEN 'HIGH' ELSE 'INFO' END AS severity, source_id, message
           FROM log_events, (VALUES (0), (1)) r(k) WHERE k = 0 OR value > 100""",
        "log_events",
    ),
)
def triage_reports(t: Tables):
    """Two deltas of reports, the second for high values only, joined to bucketed logs."""
    store = ReportTables(t.spark, scratch_path(t.spark, "reports"), f"reports_{uuid.uuid4().hex}", 8)
    logs = t.log_events().withColumnRenamed("event_id", "log_id")
    store.append_logs(logs.select("log_id", "source_id", "ts", "message"))
    for k in (0, 1):
        own = logs if k == 0 else logs.where("value > 100")
        store.append_reports(
            own.select(
                (F.col("log_id") * 10 + k).alias("report_id"), "log_id", F.when(F.col("value") > 100, "HIGH").otherwise("INFO").alias("severity"), F.lit("none").alias("root_cause"),
                F.lit(0.5).alias("confidence"), F.lit("rules").alias("model_used"), "ts",
            )
        )
    return store.joined().select("report_id", "log_id", "severity", "source_id", "message")


@query(
    "calibration_log",
    """SELECT 'model ' || m AS kind, max_by(l_extendedprice, (l_shipdate, l_extendedprice)) AS threshold, max(l_shipdate) AS ts, count(*) AS versions
       FROM (SELECT *, l_suppkey % 5 AS m FROM lineitem) GROUP BY m""",
)
def calibration_log(t: Tables):
    """Calibrations in three appends, with a snapshot between them."""
    log = CalibrationLog(t.spark, scratch_path(t.spark, "calibrations"))
    rows = t.lineitem.select(
        F.concat(F.lit("model "), (F.col("l_suppkey") % 5).cast("string")).alias("kind"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_extendedprice").alias("threshold"), "l_orderkey",
    )
    for part in range(3):
        log.append(rows.where(F.col("l_orderkey") % 3 == part).drop("l_orderkey"))
        if part == 1:
            log.compact()
    versions = log.history().groupBy("kind").agg(F.count(F.lit(1)).alias("versions"))
    return log.active().join(versions, "kind").select("kind", "threshold", F.col("ts").cast("timestamp_ntz").alias("ts"), "versions")
