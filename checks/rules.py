"""Rule tables derived from the documents: thousands of keywords of three and five words, found over line ends."""

from pyspark.sql import functions as F

from checks.base import Tables, query
from logspark.operators import explain, rule_tables

DOCS = r"SELECT doc_id, lang, source, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents"
PHRASES = """SELECT doc_id * 2 + k AS rule_id, doc_id % 7 AS priority, array_to_string(w[a:b], ' ') AS keyword, source || '-' || lang || '-' || k AS label,
    CASE doc_id % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'INFO' END AS severity, (doc_id % 10) / 10.0 AS confidence
  FROM d, (VALUES (0, 2, 4), (1, 10, 14)) p(k, a, b) WHERE len(w) >= 20"""
HITS = "SELECT doc_id, rule_id, priority, label, severity, confidence FROM (SELECT doc_id, lower(array_to_string(w, ' ')) AS t FROM d) JOIN r ON contains(t, lower(keyword))"
WITH = f"WITH d AS ({DOCS}), r AS ({PHRASES}), h AS MATERIALIZED ({HITS}) "


def _words():
    split = F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+")
    return F.filter(split, lambda x: x != "")


def _rules(t: Tables):
    docs = t.documents.select("doc_id", "lang", "source", _words().alias("w")).where(F.size("w") >= 20)
    parts = F.array(*(F.struct(F.lit(k).alias("k"), F.array_join(F.slice("w", a, n), " ").alias("keyword")) for k, a, n in ((0, 2, 3), (1, 10, 5))))
    label = F.concat_ws("-", F.col("source"), F.col("lang"), F.col("p.k").cast("string"))
    severity = F.when(F.col("doc_id") % 3 == 0, "CRITICAL").when(F.col("doc_id") % 3 == 1, "HIGH").otherwise("INFO")
    rows = docs.withColumn("p", F.explode(parts))
    return rows.select(
        (F.col("doc_id") * 2 + F.col("p.k")).alias("rule_id"), (F.col("doc_id") % 7).alias("priority"), "p.keyword", label.alias("label"),
        severity.alias("severity"), ((F.col("doc_id") % 10) / F.lit(10.0)).alias("confidence"),
    )


def _lines(t: Tables):
    """Lines of seven words."""
    at = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 7))
    cut = F.transform(at, lambda k: F.array_join(F.slice("w", k.cast("int") * 7 + 1, 7), " "))
    docs = t.documents.select(F.col("doc_id").alias("source_id"), _words().alias("w")).where(F.size("w") > 0)
    return docs.select("source_id", F.posexplode(cut).alias("line_no", "line"))


@query(
    "rule_table_signals",
    WITH
    + """SELECT d.doc_id AS source_id, coalesce(signals, '') AS signals FROM d LEFT JOIN (SELECT doc_id, string_agg(label, '|' ORDER BY place) AS signals FROM (
           SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY min((priority, rule_id))) AS place FROM h GROUP BY 1, 2) WHERE place <= 10 GROUP BY 1) s USING (doc_id)
         WHERE len(w) > 0""",
)
def rule_table_signals(t: Tables):
    found = explain.extract_signals(_lines(t), _rules(t))
    return found.select("source_id", F.array_join("signals", "|").alias("signals"))


@query(
    "rule_table_cause",
    WITH
    + """SELECT doc_id, coalesce(b.label, 'Unknown') AS root_cause, coalesce(b.severity, 'WARNING') AS severity, CAST(coalesce(b.confidence, 0.5) AS DOUBLE) AS confidence,
           b IS NULL AS is_default FROM d LEFT JOIN (SELECT doc_id, arg_min({'label': label, 'severity': severity, 'confidence': confidence}, (priority, rule_id)) AS b FROM h GROUP BY 1) x USING (doc_id)""",
)
def rule_table_cause(t: Tables):
    rules = _rules(t).unionByName(t.spark.createDataFrame([(-1, 100, "", "Unknown", "WARNING", 0.5)], "rule_id long, priority long, keyword string, label string, severity string, confidence double"))
    docs = t.documents.select("doc_id", F.array_join(_words(), " ").alias("joined"))
    got = rule_tables.table_cause(docs, F.col("joined"), rules)
    return got.select("doc_id", "root_cause", "severity", "confidence", (F.col("model_used") == "fallback-default").alias("is_default"))


@query(
    "rule_table_severity",
    WITH
    + """SELECT doc_id, severity, CAST(confidence AS DOUBLE) AS confidence, CAST(CASE severity WHEN 'CRITICAL' THEN 0.2 WHEN 'HIGH' THEN 0.65 ELSE 0.1 END AS DOUBLE) AS high_score FROM d LEFT JOIN (
           SELECT doc_id, unnest(arg_min({'severity': severity, 'confidence': confidence}, (priority, rule_id))) FROM h GROUP BY 1) x USING (doc_id) WHERE severity IS NOT NULL
         UNION ALL SELECT doc_id, NULL, NULL, NULL FROM d WHERE doc_id NOT IN (SELECT doc_id FROM h)""",
)
def rule_table_severity(t: Tables):
    docs = t.documents.select("doc_id", F.array_join(_words(), " ").alias("joined"))
    got = rule_tables.table_severity(docs, F.col("joined"), _rules(t))
    return got.select("doc_id", "severity", "confidence", F.try_element_at("scores", F.lit("HIGH")).alias("high_score"))
