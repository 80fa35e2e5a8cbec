"""The whole scan, from trigger events to notifications: one event per supplier over the logs of a day."""

from pyspark.sql import functions as F

from checks.base import Tables, oracle, query
from checks.stores import _pack
from logspark.functions.rules import CAUSE_RULES
from logspark.plans import scan
from logspark.session import save_and_read

LOOKBACK = 1440
TS = "TIMESTAMP '2024-01-03 00:00:00' + s_suppkey % 100 * INTERVAL '6' HOUR"
WINDOW = "2000 + s_suppkey % 5 * 600"
# Two pushed messages, one of them of two lines; every other push is empty.
RUNS = f"""SELECT s_suppkey AS run_id, {TS} AS ts, {WINDOW} AS context_window, CASE s_suppkey % 4 WHEN 1 THEN 'alarm' WHEN 2 THEN 'subscription' ELSE 'schedule' END AS kind,
  CASE WHEN s_suppkey % 4 = 1 THEN 'Latency of ' || s_name END AS alarm_name, CASE WHEN s_suppkey % 4 = 1 THEN 'crossed ' || s_acctbal END AS alarm_reason,
  'WARN disk slow on ' || s_name AS m1, 'INFO retry of ' || s_name || chr(10) || 'second line ' || s_nationkey AS m2, s_suppkey % 8 = 2 AS filled FROM supplier"""


def _events(t: Tables):
    runs = t.sql(RUNS, "supplier")
    event = lambda k, text: F.struct(F.lit(str(k)).alias("id"), F.lit(k).alias("timestamp"), text.alias("message"))
    sent = F.when(F.col("filled"), F.array(event(1, F.col("m1")), event(2, F.col("m2")))).otherwise(F.array(event(1, F.lit(""))))
    payload = F.to_json(F.struct(F.lit("/app/error").alias("logGroup"), sent.alias("logEvents")))
    detail = F.struct(F.col("alarm_name").alias("alarmName"), F.struct(F.col("alarm_reason").alias("reason")).alias("state"))
    alarm = F.to_json(F.struct(F.lit("CloudWatch Alarm State Change").alias("detail-type"), detail.alias("detail")))
    text = F.when(F.col("kind") == "subscription", _pack(payload)).when(F.col("kind") == "alarm", alarm).otherwise(F.lit("{}"))
    return save_and_read(runs.select("run_id", "ts", "context_window", text.alias("event")), "scan-events")


def _scan(t: Tables):
    logs = t.log_events().select("log_group", "ts", F.col("event_id").alias("seq"), "message")
    patterns = t.spark.createDataFrame([("/app/e*",), ("/app/view",), ("/app/s/*",), ("/none",)], "pattern string")
    return scan.scan_events(_events(t), patterns, logs, F.col("context_window"), F.lit(256), F.lit(50), LOOKBACK)


CONTEXT = r"""concat_ws(chr(10), 'Trigger type: ' || kind, 'Alarm: ' || alarm_name, 'Reason: ' || alarm_reason,
  CASE WHEN kind = 'schedule' THEN 'This is a scheduled scan, not triggered by a specific alarm.' END)"""
LINES = f"""SELECT run_id, log_group, row_number() OVER (PARTITION BY run_id, log_group ORDER BY ts, seq, part) - 1 AS line_no, line FROM (
    SELECT r.run_id, e.log_group, e.ts, event_id AS seq, 0 AS part, strftime(e.ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(e.ts) // 1000 % 1000 = 0 THEN '' ELSE printf('.%06d', epoch_us(e.ts) // 1000 % 1000 * 1000) END || '+00:00 ' || message AS line
    FROM log_events e JOIN runs r ON e.ts BETWEEN r.ts - INTERVAL {LOOKBACK} MINUTE AND r.ts
    WHERE e.log_group IN ('/app/error', '/app/view', '/app/signup') AND NOT (e.log_group = '/app/error' AND kind = 'subscription' AND filled)
    UNION ALL SELECT run_id, '/app/error', NULL, k, p, part FROM (
      SELECT run_id, k, unnest(range(len(parts))) AS p, unnest(parts) AS part FROM (
        SELECT run_id, k, string_split(m, chr(10)) AS parts FROM (SELECT run_id, 1 AS k, m1 AS m FROM runs WHERE kind = 'subscription' AND filled UNION ALL SELECT run_id, 2, m2 FROM runs WHERE kind = 'subscription' AND filled)))
  )"""
PARTS = dict(
    runs=RUNS,
    ln=LINES,
    av=f"SELECT run_id, greatest(context_window - (256 + 50 + length({CONTEXT}) // 4 + 500), 0)::BIGINT AS available FROM runs",
    size="SELECT run_id, log_group, (sum(length(line)) + count(*) - 1) // 4 AS tokens FROM ln GROUP BY 1, 2",
    ordered="""SELECT run_id, log_group, tokens, available, row_number() OVER (PARTITION BY run_id ORDER BY tokens, log_group) AS i, count(*) OVER (PARTITION BY run_id) AS n,
        sum(tokens) OVER (PARTITION BY run_id) AS total FROM size JOIN av USING (run_id)""",
    step="""SELECT run_id, i, n, log_group, tokens, total, available, available::BIGINT AS budget FROM ordered WHERE i = 1
      UNION ALL SELECT o.run_id, o.i, o.n, o.log_group, o.tokens, o.total, o.available, (s.budget - least(s.tokens, s.budget // (s.n - s.i + 1)))::BIGINT
        FROM step s JOIN ordered o ON o.run_id = s.run_id AND o.i = s.i + 1""",
    pl="""SELECT run_id, log_group, i - 1 AS place, CASE WHEN total > available AND tokens > budget // (n - i + 1) THEN least(greatest((budget // (n - i + 1)) / tokens, 0.01), 1.0) END AS share FROM step""",
    lab="""SELECT *, CASE WHEN share IS NULL THEN '[' || log_group || '] (full logs)' ELSE '[' || log_group || '] (reduced to top ' || CAST(round_even(CAST(share AS DECIMAL(20, 10)) * 100, 0) AS BIGINT) || '%)' END AS label FROM pl""",
    hv=r"""SELECT run_id, log_group, line_no, d, c / sqrt(sum(c * c) OVER (PARTITION BY run_id, log_group, line_no)) AS x FROM (
      SELECT run_id, log_group, line_no, d, count(*) AS c FROM (SELECT run_id, log_group, line_no, unnest(list_transform(regexp_extract_all(lower(substr(line, 1, 1024)), '[\p{L}_]+'),
        lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 64)) AS d FROM ln JOIN pl USING (run_id, log_group) WHERE share IS NOT NULL) GROUP BY 1, 2, 3, 4)""",
    starts="SELECT run_id, log_group, share, unnest(range(n - 3)) AS start, n - 3 AS windows FROM (SELECT run_id, log_group, share, count(*) AS n FROM ln JOIN pl USING (run_id, log_group) WHERE share IS NOT NULL GROUP BY ALL HAVING count(*) >= 4)",
    wv="""SELECT run_id, log_group, start, list(coalesce(x, 0) ORDER BY d) AS e FROM (SELECT run_id, log_group, start, unnest(range(64)) AS d FROM starts) LEFT JOIN (
        SELECT run_id, log_group, start, d, sum(x) AS x FROM starts JOIN hv USING (run_id, log_group) WHERE line_no BETWEEN start AND start + 3 GROUP BY ALL) USING (run_id, log_group, start, d) GROUP BY ALL""",
    near="""SELECT a.run_id, a.log_group, a.start, 1 - list_cosine_similarity(a.e, b.e) AS dist, row_number() OVER (PARTITION BY a.run_id, a.log_group, a.start ORDER BY 1 - list_cosine_similarity(a.e, b.e)) AS k
      FROM wv a JOIN wv b ON a.run_id = b.run_id AND a.log_group = b.log_group AND a.start <> b.start""",
    scored="SELECT run_id, log_group, start, windows, share, round(coalesce(score, 0), 9) AS score FROM starts LEFT JOIN (SELECT run_id, log_group, start, avg(dist) AS score FROM near WHERE k <= 5 GROUP BY ALL) USING (run_id, log_group, start)",
    kept="SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY run_id, log_group ORDER BY score DESC, start) <= ceil(share * windows)",
    isl="SELECT *, sum(opens) OVER (PARTITION BY run_id, log_group ORDER BY start) AS b FROM (SELECT *, CASE WHEN start <= lag(start) OVER (PARTITION BY run_id, log_group ORDER BY start) + 4 THEN 0 ELSE 1 END AS opens FROM kept)",
    bl="SELECT run_id, log_group, min(start) AS a, max(start) + 3 AS z, max(score) AS score FROM isl GROUP BY run_id, log_group, b",
    sections="""SELECT run_id, place, log_group, label, NULL::VARCHAR AS block, line_no, line FROM ln JOIN lab USING (run_id, log_group) WHERE share IS NULL
      UNION ALL SELECT run_id, place, log_group, label, printf('<anomalous_block lines="%d-%d" score="%.4f">', a + 1, z + 1, score), line_no, line
        FROM ln JOIN lab USING (run_id, log_group) JOIN bl USING (run_id, log_group) WHERE line_no BETWEEN a AND z""",
)


def _recursive(body: str) -> str:
    return oracle(body, "log_events", **PARTS).replace("WITH ", "WITH RECURSIVE ", 1)


@query("full_scan_sections", _recursive("SELECT * FROM sections"))
def full_scan_sections(t: Tables):
    return _scan(t).sections


_RULES = [r for r in CAUSE_RULES["service"] if r.keywords]
_HITS = ", ".join(f"bool_or({' OR '.join(f'contains(low, {chr(39)}{k}{chr(39)})' for k in r.keywords)}) AS r{i}" for i, r in enumerate(_RULES))
_STATUS = "CASE " + " ".join(f"WHEN r{i} THEN '{r.severity.capitalize()}'" for i, r in enumerate(_RULES)) + " ELSE 'Healthy' END"
_SUMMARY = "CASE " + " ".join(f"WHEN r{i} THEN '{r.label}'" for i, r in enumerate(_RULES)) + " ELSE 'No known problem found' END"


@query(
    "full_scan",
    _recursive(
        f"""SELECT run_id, substr('Logspark - ' || name, 1, 100) AS subject, 'Trigger: ' || name || chr(10) || 'Time: ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' || chr(10) || chr(10) || analysis AS body FROM (
          SELECT run_id, ts, kind, status, CASE kind WHEN 'alarm' THEN 'Alarm: ' || alarm_name WHEN 'subscription' THEN 'Subscription filter match' ELSE 'Scheduled scan' END AS name,
            'STATUS: ' || status || chr(10) || 'SUMMARY: ' || summary || chr(10) || 'LINES: ' || n AS analysis FROM (
            SELECT run_id, {_STATUS} AS status, {_SUMMARY} AS summary, n FROM (SELECT run_id, count(*) AS n, {_HITS} FROM (SELECT run_id, lower(line) AS low FROM sections) GROUP BY 1)) JOIN runs USING (run_id))
          WHERE NOT (kind = 'schedule' AND status = 'Healthy')"""
    ),
)
def full_scan(t: Tables):
    return _scan(t).notifications.select("run_id", "subject", "body")
