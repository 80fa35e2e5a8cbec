"""Registry of queries with their DuckDB counterparts, and the views both sides read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.operators.ordering import number_rows
from logspark.session import save_and_read, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a Spark query and, if given, the SQL that must return the same rows."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(name)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship(spark)
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn

    return add


MESSAGE = """CASE
    WHEN event_type = 'error' AND value >= 150 THEN 'FATAL worker out of memory, process killed'
    WHEN event_type = 'error' AND value >= 100 THEN 'ERROR connection refused to db-primary'
    WHEN event_type = 'error' AND value >= 60 THEN 'ERROR Timeout waiting for response'
    WHEN event_type = 'error' AND value >= 30 THEN 'ERROR unhandled exception at app.Main(Main.java:42)'
    WHEN event_type = 'error' THEN 'ERROR request failed'
    WHEN event_type = 'signup' AND value >= 100 THEN 'WARNING slow response from auth'
    WHEN event_type = 'signup' THEN 'INFO user login accepted'
    WHEN event_type = 'purchase' THEN 'INFO request processed'
    WHEN event_type = 'view' THEN 'DEBUG cache hit'
    ELSE 'INFO health check passed' END"""

FEEDBACK = """SELECT o_orderkey AS feedback_id, o_custkey AS incident_id,
  concat('Check ', lower(substr(o_orderpriority, 3))) AS suggestion,
  CAST(o_orderkey % 11 AS INT) AS suggestion_quality, (o_orderkey % 101) / 100.0 AS relevance_score,
  o_orderkey % 3 = 0 AS was_helpful, CAST(o_custkey % 11 AS INT) AS overall_satisfaction, o_orderdate AS ts,
  CASE o_orderstatus WHEN 'F' THEN 'CRITICAL' WHEN 'P' THEN 'HIGH' ELSE 'WARNING' END AS incident_severity
FROM orders"""

BANDIT = """SELECT l_orderkey AS incident_id, CAST((l_partkey + l_linenumber) % 8 AS INT) AS action_id,
  CAST(l_suppkey % 8 AS INT) AS alarm_type_idx, CAST(l_linenumber % 4 AS INT) AS severity_idx,
  CAST(l_suppkey % 100 AS INT) AS service_idx, l_shipdate AS ts, l_linenumber AS line_number,
  l_discount * 10 AS feedback_score, l_returnflag = 'R' AS was_helpful
FROM lineitem"""

# One incident per order: a stored root-cause text, with every status word, missing parts and odd forms.
INCIDENTS = """SELECT o_orderkey AS incident_id, o_orderdate AS ts, o_custkey AS service_no,
  concat(CASE WHEN o_orderkey % 5 = 0 THEN concat('Notes for ', o_orderkey, chr(10)) ELSE '' END,
    CASE o_orderkey % 7 WHEN 0 THEN 'STATUS: Critical' WHEN 1 THEN '  status: high ' WHEN 2 THEN 'STATUS: Medium'
      WHEN 3 THEN 'STATUS: Low' WHEN 4 THEN 'STATUS: Healthy' WHEN 5 THEN 'STATUS: Unhealthy'
      ELSE 'SEVERITY: High' END, chr(10),
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('SUMMARY: order ', o_orderkey, ': ', lower(o_orderpriority), chr(10)) END,
    'NEXT STEPS:', chr(10), '1. check ', o_custkey,
    CASE WHEN o_orderkey % 4 = 0 THEN concat(chr(10), 'SPOKEN SUMMARY:  service ', o_custkey, ' is slow ') ELSE '' END) AS rca,
  CASE o_orderstatus WHEN 'F' THEN 'alarm' WHEN 'P' THEN 'subscription' ELSE 'schedule' END AS trigger_type,
  CASE WHEN o_orderstatus <> 'F' THEN '' WHEN o_orderkey % 2 = 0 THEN concat('HighCPU-', o_custkey) ELSE '' END AS alarm_name,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 <> 0 THEN concat('crossed ', o_custkey) ELSE '' END AS alarm_reason
FROM orders"""

# One metric datapoint per event.
METRICS = """SELECT event_id, concat('App/', upper(event_type)) AS namespace, 'Latency' AS metric_name,
  concat('user-', user_id % 20) AS resource, ts, value FROM events"""


class Tables:
    """The given tables of one folder and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def path(self, name: str) -> str:
        return f"{self.sf_dir.rstrip('/')}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(self.path(name))
        times = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
        return df.withColumns(times) if times else df

    def sql(self, text: str, *tables: str) -> DataFrame:
        """Run ``text`` over the named tables or DataFrames."""
        frames = {name: getattr(self, name) for name in tables}
        text = text.replace("{", "{{").replace("}", "}}")
        for name in frames:
            text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
        return self.spark.sql(text, **frames)

    def log_events(self) -> DataFrame:
        """``event_id, source_id, ts, log_group, message``, one row per event."""
        return self.events.select(
            "event_id",
            F.col("user_id").alias("source_id"),
            "ts",
            F.concat(F.lit("/app/"), "event_type").alias("log_group"),
            F.expr(MESSAGE).alias("message"),
            "value",
        )

    def lines(self) -> DataFrame:
        """Log lines with a time stamp, not numbered."""
        stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
        return self.log_events().select("event_id", "source_id", "ts", F.concat_ws(" ", stamp, "message").alias("line"))

    def log_lines(self) -> DataFrame:
        """Log lines numbered per source in time order."""
        return number_rows(self.lines(), ["source_id"], F.col("ts"), F.col("event_id"))

    def log_table(self) -> DataFrame:
        """:meth:`log_lines` written once as a table, for queries that read it several times."""
        return save_and_read(self.log_lines().select("source_id", "line_no", "line"), "log-lines")

    def feedback(self) -> DataFrame:
        return self.sql(FEEDBACK, "orders")

    def bandit_log(self) -> DataFrame:
        return self.sql(BANDIT, "lineitem")

    def incidents(self) -> DataFrame:
        return self.sql(INCIDENTS, "orders")

    def metrics(self) -> DataFrame:
        return self.sql(METRICS, "events")


VIEWS = {
    "log_events": f"SELECT event_id, user_id AS source_id, ts, '/app/' || event_type AS log_group, {MESSAGE} AS message, value FROM events",
    "lines": f"SELECT event_id, user_id AS source_id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' ' || {MESSAGE} AS line FROM events",
    "log_lines": "SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts, event_id) - 1 AS line_no FROM lines",
    "feedback": FEEDBACK,
    "bandit_log": BANDIT,
    "incidents": INCIDENTS,
    "metrics": METRICS,
}


def oracle(body: str, *views: str, **ctes: str) -> str:
    """DuckDB SQL: the named views, then extra CTEs, then ``body``."""
    names = []
    for view in views:
        if view == "log_lines" and "lines" not in names:
            names.append("lines")
        if view not in names:
            names.append(view)
    parts = [f"{name} AS ({VIEWS[name]})" for name in names] + [f"{k} AS ({v})" for k, v in ctes.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body
