"""Line aggregates, windows, scores and triage (A1-A13, W, K, C, E1-E3 rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Tables, oracle, query
from logspark.functions import rules
from logspark.functions.text import words
from logspark.functions.vectors import l2_normalize
from logspark.operators import anomaly, explain, ordering, windows
from logspark.plans.triage import triage
from logspark.session import save_and_read
from logspark.sources import lines as sources

# Log lines, and the same lines of each source again as one word per line (source_id below zero).
WORD_LINES = """SELECT source_id, line_no, line FROM log_lines UNION ALL
  SELECT -1 - source_id, line_no * 100 + unnest(range(len(string_split(line, ' ')))), unnest(string_split(line, ' ')) FROM log_lines"""


def _word_lines(t: Tables):
    own = t.log_table()
    split = own.select("source_id", F.col("line_no").alias("n"), F.posexplode(F.split("line", " ")).alias("p", "line"))
    return own.union(split.select(-1 - F.col("source_id"), F.col("n") * 100 + F.col("p"), "line"))


SIGNAL_RULES = "(VALUES " + ", ".join(f"({i}, '{r.keywords[0]}', '{r.label}')" for i, r in enumerate(rules.SIGNALS)) + ") r(rule, keyword, label)"
JOINED = "SELECT source_id, lower(string_agg(line, ' ' ORDER BY line_no)) AS joined FROM w GROUP BY 1"
SIGNALS = f"""SELECT source_id, coalesce(string_agg(label, '|' ORDER BY first) FILTER (first IS NOT NULL AND place <= 10), '') AS signals FROM (
  SELECT source_id, label, first, row_number() OVER (PARTITION BY source_id ORDER BY first NULLS LAST) AS place FROM (
    SELECT source_id, label, min(rule) FILTER (contains(joined, keyword)) AS first FROM joined, {SIGNAL_RULES} GROUP BY 1, 2)) GROUP BY 1"""


@query("extract_signals", oracle(SIGNALS, "log_lines", w=WORD_LINES, joined=JOINED))
def extract_signals(t: Tables):
    return explain.extract_signals(_word_lines(t)).select("source_id", F.array_join("signals", "|").alias("signals"))


TOKENS = """SELECT source_id, line_no, unnest(range(len(ts))) AS pos, lower(unnest(ts)) AS token FROM (
  SELECT source_id, line_no, list_filter(regexp_extract_all(line, '[\\p{L}\\p{N}_]+'),
    lambda x: regexp_matches(x, '^[A-Za-z][A-Za-z0-9_]{2,}$')) AS ts FROM w)"""
RARITY = f"""SELECT source_id, token, score, place AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, common) AS place FROM (
    SELECT *, round_even(1 - n / total, 4) AS score FROM (
      SELECT *, sum(n) OVER (PARTITION BY source_id) AS total,
        row_number() OVER (PARTITION BY source_id ORDER BY n DESC, first) AS common FROM (
        SELECT source_id, token, count(*) AS n, min((line_no, pos)) AS first FROM tokens GROUP BY 1, 2))
    WHERE common <= 50 AND length(token) > 3 AND token NOT IN {explain.STOPWORDS})) WHERE place <= 20"""
DOC_WORDS = "SELECT doc_id AS source_id, line_no, line FROM doc_lines"


@query("token_rarity", oracle(RARITY, "log_lines", w="SELECT source_id, line_no, line FROM log_lines", tokens=TOKENS))
def token_rarity(t: Tables):
    return explain.token_rarity(t.log_table())


BURST = """SELECT source_id, count(*) FILTER (regexp_matches(lower(line), 'error|exception|fatal')) AS error_count, count(*) AS line_count,
  count(*) FILTER (regexp_matches(lower(line), 'error|exception|fatal')) > count(*) * 0.3 AS burst FROM log_lines GROUP BY 1"""


@query("error_burst", oracle(BURST, "log_lines"))
def error_burst(t: Tables):
    return explain.error_burst(t.log_lines())


SPAM = """SELECT source_id, line, n AS repeats FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, first) AS place FROM (
  SELECT source_id, line, count(*) AS n, min(line_no) AS first FROM m GROUP BY 1, 2)) WHERE place = 1 AND n > 5"""
# Messages without their time stamp, so that lines repeat.
PLAIN = "SELECT source_id, line_no, substr(line, 21) AS line FROM log_lines"


def _plain(t: Tables):
    return t.log_lines().select("source_id", "line_no", F.substring("line", 21, 1 << 30).alias("line"))


@query("log_spam", oracle(SPAM, "log_lines", m=PLAIN))
def log_spam(t: Tables):
    return explain.log_spam(_plain(t))


@query("stack_trace_flag", oracle("SELECT source_id, bool_or(contains(line, 'at ') AND contains(line, '(')) AS stack_trace FROM log_lines GROUP BY 1", "log_lines"))
def stack_trace_flag(t: Tables):
    return explain.pattern_facts(t.log_lines()).select("source_id", "stack_trace")


@query(
    "rapid_sequence",
    oracle(
        """SELECT source_id, CAST(sum(CASE WHEN line_no < 20 THEN len(regexp_extract_all(line, '[0-9]{2}:[0-9]{2}:[0-9]{2}')) ELSE 0 END) AS BIGINT) AS stamps
           FROM log_lines GROUP BY 1""",
        "log_lines",
    ),
)
def rapid_sequence(t: Tables):
    return explain.pattern_facts(t.log_lines()).select("source_id", "stamps")


FACTS = """SELECT source_id, count(*) AS n, count(*) FILTER (regexp_matches(lower(line), 'error|exception|fatal')) AS e,
  bool_or(contains(line, 'at ') AND contains(line, '(')) AS st,
  sum(CASE WHEN line_no < 20 THEN len(regexp_extract_all(line, '[0-9]{2}:[0-9]{2}:[0-9]{2}')) ELSE 0 END) AS ts FROM w GROUP BY 1"""
PATTERNS = """SELECT source_id, concat_ws('|', CASE WHEN e > n * 0.3 THEN 'Error burst: ' || e || '/' || n || ' lines are errors' END,
  CASE WHEN repeats IS NOT NULL THEN 'Log spam: ''' || substr(line, 1, 60) || ''' repeated ' || repeats || 'x' END,
  CASE WHEN st THEN 'Stack trace present — unhandled exception' END,
  CASE WHEN ts >= 2 THEN 'Rapid log sequence: ' || n || ' lines' END) AS patterns FROM facts LEFT JOIN spam USING (source_id)"""
EXPLAIN_PARTS = dict(
    joined=JOINED,
    sig=SIGNALS,
    facts=FACTS,
    m="SELECT * FROM w",
    spam=SPAM,
    pat=PATTERNS,
    tokens=TOKENS,
    rare=RARITY,
)
TEXT_SQL = f"""coalesce(nullif(concat_ws(' ', CASE WHEN signals <> '' THEN 'Detected signals: ' ||
  array_to_string(list_slice(string_split(signals, '|'), 1, 3), ', ') || '.' END,
  CASE WHEN patterns <> '' THEN 'Structural patterns: ' || string_split(patterns, '|')[1] || '.' END), ''), '{explain.DEFAULT_TEXT}')"""


@query(
    "explanation_text",
    oracle(
        f"SELECT source_id, {TEXT_SQL} AS explanation FROM sig JOIN pat USING (source_id)",
        "log_lines",
        w="SELECT source_id, line_no, substr(line, 21) AS line FROM log_lines",
        **{k: v for k, v in EXPLAIN_PARTS.items() if k not in ("tokens", "rare")},
    ),
)
def explanation_text(t: Tables):
    lines = t.log_table().withColumn("line", F.substring("line", 21, 1 << 30))
    both = explain.extract_signals(lines).join(explain.find_patterns(lines), "source_id")
    return both.select("source_id", explain.explanation_text(F.col("signals"), F.col("patterns")).alias("explanation"))


@query(
    "explain",
    oracle(
        f"""SELECT source_id, signals, patterns, {TEXT_SQL} AS explanation, tokens FROM sig JOIN pat USING (source_id)
            LEFT JOIN (SELECT source_id, string_agg(token || '=' || CAST(CAST(score * 10000 AS BIGINT) AS VARCHAR), ' ' ORDER BY rank) AS tokens FROM rare GROUP BY 1) USING (source_id)""",
        "log_lines",
        w="SELECT source_id, line_no, line FROM log_lines",
        **EXPLAIN_PARTS,
    ),
)
def explain_sources(t: Tables):
    entries = F.transform(
        F.map_entries("token_scores"),
        lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 10000).cast("bigint").cast("string")),
    )
    return explain.explain(t.log_table()).select(
        "source_id",
        F.array_join("signals", "|").alias("signals"),
        F.array_join("patterns", "|").alias("patterns"),
        "explanation",
        F.array_join(entries, " ").alias("tokens"),
    )


# Vectors as lines: one source per label, numbered by vec_id.
VECTORS = "SELECT label AS source_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS line_no, vec_id, embedding FROM embeddings"
LONG = "SELECT source_id, vec_id, unnest(range(len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM v"
ZSCORE = """SELECT source_id, vec_id, CASE WHEN s < 1e-9 THEN dist ELSE abs((dist - m) / s) END AS score, s >= 1e-9 AND abs((dist - m) / s) > 2 AS is_anomaly
  FROM (SELECT *, avg(dist) OVER (PARTITION BY source_id) AS m, stddev_pop(dist) OVER (PARTITION BY source_id) AS s FROM (
    SELECT source_id, vec_id, sqrt(sum((x - c) * (x - c))) AS dist FROM long JOIN (SELECT source_id, d, avg(x) AS c FROM long GROUP BY 1, 2) USING (source_id, d) GROUP BY 1, 2))"""


def _vectors(t: Tables):
    rows = t.embeddings.select(F.col("label").alias("source_id"), "vec_id", "embedding")
    return ordering.number_rows(rows, ["source_id"], F.col("vec_id"), F.col("vec_id"))


@query("zscore_anomaly", oracle("SELECT source_id, vec_id, round(score, 6) AS score, is_anomaly FROM z", v=VECTORS, long=LONG, z=ZSCORE))
def zscore_anomaly(t: Tables):
    rows = t.embeddings.select(F.col("label").alias("source_id"), "vec_id", "embedding")
    return anomaly.zscore_anomaly(rows).select("source_id", "vec_id", F.round("score", 6).alias("score"), "is_anomaly")


# Lengths differ after scaling each vector by its number.
LENGTHS = """SELECT source_id, vec_id, z / max(z) OVER (PARTITION BY source_id) AS score, z >= 3 AS is_anomaly FROM (
  SELECT *, abs((n - avg(n) OVER (PARTITION BY source_id)) / stddev_pop(n) OVER (PARTITION BY source_id)) AS z FROM (
    SELECT source_id, vec_id, sqrt(sum(x * x)) * (1 + vec_id * vec_id) AS n FROM long GROUP BY 1, 2))"""


@query("zscore_anomaly_service", oracle("SELECT source_id, vec_id, round(score, 6) AS score, is_anomaly FROM z", v=VECTORS, long=LONG, z=LENGTHS))
def zscore_anomaly_service(t: Tables):
    by = 1 + F.col("vec_id") * F.col("vec_id")
    rows = t.embeddings.select(
        F.col("label").alias("source_id"), "vec_id", F.transform("embedding", lambda x: x.cast("double") * by).alias("embedding")
    )
    scored = anomaly.zscore_anomaly(rows, profile="service")
    return scored.select("source_id", "vec_id", F.round("score", 6).alias("score"), "is_anomaly")


@query(
    "l2_normalize",
    """SELECT vec_id, round(sqrt(sum(y * y)), 6) AS length, round(sum(y * (d + 1)), 6) AS mark FROM (
         SELECT vec_id, d, x / CASE WHEN n = 0 THEN 1 ELSE n END AS y FROM (
           SELECT *, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS n FROM (
             SELECT vec_id, unnest(range(len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) * (vec_id % 4) AS x FROM embeddings)))
       GROUP BY 1""",
)
def l2_normalize_vectors(t: Tables):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 4))
    unit = t.embeddings.select("vec_id", l2_normalize(scaled).alias("u"))
    length = F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x))
    mark = F.aggregate(F.transform("u", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return unit.select("vec_id", F.round(length, 6).alias("length"), F.round(mark, 6).alias("mark"))


# Scores and labels used by thresholds: one row per lineitem.
SCORES = """SELECT l_orderkey, l_linenumber, l_extendedprice / 100000 + l_discount AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
  l_linestatus AS kind FROM lineitem"""


def _scores(t: Tables):
    return t.sql(SCORES, "lineitem")


@query(
    "flag_threshold",
    oracle(
        "SELECT l_orderkey, l_linenumber, score > 0.5 AS strict, score >= 0.5 AS service FROM s",
        s="SELECT l_orderkey, l_linenumber, l_quantity / 50 AS score FROM lineitem",
    ),
)
def flag_threshold(t: Tables):
    score = F.col("l_quantity") / 50
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        anomaly.flag_threshold(score, 0.5).alias("strict"),
        anomaly.flag_threshold(score, 0.5, strict=False).alias("service"),
    )


@query(
    "calibrate_sigma",
    oracle(
        """SELECT kind, round(m, 6) AS baseline_mean, round(sd, 6) AS baseline_std, n AS samples, round(m + 2 * sd, 6) AS threshold,
             round(avg(CASE WHEN score > m + 2 * sd THEN 1.0 ELSE 0.0 END), 6) AS anomaly_rate
           FROM s JOIN (SELECT kind, avg(score) AS m, stddev_pop(score) AS sd, count(*) AS n FROM s GROUP BY 1) USING (kind) GROUP BY kind, m, sd, n""",
        s=SCORES,
    ),
)
def calibrate_sigma(t: Tables):
    got = anomaly.calibrate_sigma(_scores(t), k=2.0, keys=["kind"])
    rounded = ("baseline_mean", "baseline_std", "threshold", "anomaly_rate")
    return got.select("kind", "samples", *[F.round(c, 6).alias(c) for c in rounded])


@query("calibrate_percentile", oracle("SELECT round(quantile_cont(score, 0.95) FILTER (label = 0), 6) AS threshold, count(*) FILTER (label = 0) AS samples FROM s", s=SCORES))
def calibrate_percentile(t: Tables):
    return anomaly.calibrate_percentile(_scores(t)).select(F.round("threshold", 6).alias("threshold"), "samples")


STATS = ", ".join(
    f"count(*) FILTER (label = {v}) AS {n}_samples, round(avg(score) FILTER (label = {v}), 6) AS {n}_mean,"
    f" round(stddev_pop(score) FILTER (label = {v}), 6) AS {n}_std, round(min(score) FILTER (label = {v}), 6) AS {n}_min,"
    f" round(max(score) FILTER (label = {v}), 6) AS {n}_max"
    for n, v in (("normal", 0), ("anomaly", 1))
)


@query(
    "calibration_stats",
    oracle(
        f"""SELECT {STATS}, round(quantile_cont(score, 0.95) FILTER (label = 0), 6) AS normal_p95,
              round(avg(CASE WHEN score >= 0.4 THEN 1.0 ELSE 0.0 END) FILTER (label = 0), 6) AS false_positive_rate,
              round(avg(CASE WHEN score >= 0.4 THEN 1.0 ELSE 0.0 END) FILTER (label = 1), 6) AS true_positive_rate FROM s""",
        s=SCORES,
    ),
)
def calibration_stats(t: Tables):
    got = anomaly.calibration_stats(_scores(t), 0.4)
    return got.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in got.dtypes])


def _window_sql(size, stride, source="log_lines"):
    return f"""SELECT w.source_id, w.start, l.line_no FROM (
        SELECT source_id, unnest(range(0, n - {size} + 1, {stride})) AS start FROM (SELECT source_id, count(*) AS n FROM {source} GROUP BY 1) WHERE n >= {size}) w
      JOIN {source} l ON l.source_id = w.source_id AND l.line_no BETWEEN w.start AND w.start + {size - 1}"""


LINE_SCORE = "(CASE WHEN contains(line, 'FATAL') THEN 0.9 WHEN contains(line, 'ERROR') THEN 0.5 WHEN contains(line, 'WARNING') THEN 0.3 ELSE 0.0 END)::DOUBLE"
SCORED = f"SELECT *, {LINE_SCORE} AS score, CASE WHEN contains(line, 'ERROR') OR contains(line, 'INFO') THEN 1 ELSE 0 END AS label FROM log_lines"


def _scored(t: Tables):
    line = F.col("line")
    score = F.when(line.contains("FATAL"), 0.9).when(line.contains("ERROR"), 0.5).when(line.contains("WARNING"), 0.3).otherwise(0.0)
    label = F.when(line.contains("ERROR") | line.contains("INFO"), 1).otherwise(0)
    return t.log_lines().select("source_id", "line_no", "line", score.alias("score"), label.alias("label"))


@query(
    "sliding_line_windows",
    oracle(
        "SELECT source_id, start, round(sum(score), 4) AS total, min(line) AS first_line FROM w JOIN sc USING (source_id, line_no) GROUP BY 1, 2",
        "log_lines",
        w=_window_sql(16, 4),
        sc=SCORED,
    ),
)
def sliding_line_windows(t: Tables):
    got = windows.sliding_windows(_scored(t), 16, 4, [F.sum("score").alias("total"), F.min("line").alias("first_line")])
    return got.withColumn("total", F.round("total", 4))


@query("context_windows", oracle("SELECT source_id, start, max(score) AS score FROM w JOIN sc USING (source_id, line_no) GROUP BY 1, 2", "log_lines", w=_window_sql(4, 1), sc=SCORED))
def context_windows(t: Tables):
    return windows.sliding_windows(_scored(t), 4, 1, [F.max("score").alias("score")])


@query("windows_to_lines", oracle("SELECT * FROM w", "log_lines", w=_window_sql(16, 4)))
def windows_to_lines(t: Tables):
    found = windows.sliding_windows(t.log_lines(), 16, 4, [])
    return windows.windows_to_lines(found, 16).select("source_id", "start", "line_no")


WINDOW_SCORE = "SELECT source_id, start, round(avg(score), 6) AS score FROM w JOIN sc USING (source_id, line_no) GROUP BY 1, 2"


@query(
    "max_overlap_score",
    oracle(
        """SELECT l.source_id, l.line_no, coalesce(max(ws.score), 0.0) AS score FROM log_lines l LEFT JOIN w USING (source_id, line_no)
           LEFT JOIN ws ON ws.source_id = w.source_id AND ws.start = w.start GROUP BY 1, 2""",
        "log_lines",
        w=_window_sql(16, 4),
        sc=SCORED,
        ws=WINDOW_SCORE,
    ),
)
def max_overlap_score(t: Tables):
    lines = _scored(t)
    scored = windows.sliding_windows(lines, 16, 4, [F.round(F.avg("score"), 6).alias("score")])
    return windows.max_overlap_score(lines.drop("score"), scored, 16).select("source_id", "line_no", "score")


MAJORITY = "SELECT source_id, start, CAST(avg(label) > 0.5 AS INT) AS label FROM w JOIN sc USING (source_id, line_no) GROUP BY 1, 2"


@query("window_labels", oracle("SELECT * FROM m", "log_lines", w=_window_sql(16, 4), sc=SCORED, m=MAJORITY))
def window_labels(t: Tables):
    majority = (F.avg("label") > 0.5).cast("int").alias("label")
    return windows.sliding_windows(_scored(t), 16, 4, [majority])


@query(
    "window_majority_label",
    oracle("SELECT source_id, count(*) AS windows, CAST(sum(label) AS BIGINT) AS anomalous FROM m GROUP BY 1", "log_lines", w=_window_sql(16, 4), sc=SCORED, m=MAJORITY),
)
def window_majority_label(t: Tables):
    labelled = window_labels(t)
    return labelled.groupBy("source_id").agg(F.count(F.lit(1)).alias("windows"), F.sum("label").alias("anomalous"))


KEPT = """SELECT source_id, start, score FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, start) AS place,
  count(*) OVER (PARTITION BY source_id) AS n FROM ws) WHERE place <= ceil(0.25 * n)"""
BLOCKS = """SELECT source_id, min(start) AS line_start, max(start) + 3 AS line_end, max(score) AS score FROM (
  SELECT *, sum(opens) OVER (PARTITION BY source_id ORDER BY start) AS block FROM (
    SELECT *, CASE WHEN start <= lag(start) OVER (PARTITION BY source_id ORDER BY start) + 4 THEN 0 ELSE 1 END AS opens FROM kept))
  GROUP BY source_id, block"""


def _kept(t: Tables):
    scored = windows.sliding_windows(_scored(t), 4, 1, [F.round(F.avg("score"), 6).alias("score")])
    return ordering.top_share(save_and_read(scored, "windows"), ["source_id"], F.lit(0.25), "score", "start")


@query("top_percentile_windows", oracle("SELECT * FROM kept", "log_lines", w=_window_sql(4, 1), sc=SCORED, ws=WINDOW_SCORE, kept=KEPT))
def top_percentile_windows(t: Tables):
    return _kept(t).select("source_id", "start", "score")


@query("merge_blocks", oracle(BLOCKS, "log_lines", w=_window_sql(4, 1), sc=SCORED, ws=WINDOW_SCORE, kept=KEPT))
def merge_blocks(t: Tables):
    return windows.merge_blocks(save_and_read(_kept(t), "kept"), 4)


# Line scores by hashed words, as SQL.
DIM = 64
ENCODED = f"""SELECT *, array_to_string(regexp_extract_all(lower(substr(line, 1, 1024)), '[\\p{{L}}_]+'), ' ') AS t FROM log_lines"""
WORDED = "SELECT source_id, t, count(*) AS n FROM enc GROUP BY 1, 2"
SLOTTED = f"""SELECT source_id, t, n, d, count(*) AS c FROM (
  SELECT source_id, t, n, unnest(list_transform(string_split(t, ' '), lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % {DIM})) AS d FROM worded) GROUP BY 1, 2, 3, 4"""
UNIT = "SELECT source_id, t, n, d, c / sqrt(sum(c * c) OVER (PARTITION BY source_id, t)) AS x FROM slotted"
CENTRE = "SELECT source_id, d, sum(x * n) / (SELECT sum(n) FROM worded w WHERE w.source_id = u.source_id) AS m FROM unit u GROUP BY 1, 2"
DIST = """SELECT w.source_id, w.t, w.n, sqrt(greatest(sum((coalesce(u.x, 0) - c.m) * (coalesce(u.x, 0) - c.m)), 0)) AS dist FROM worded w JOIN centre c USING (source_id)
  LEFT JOIN unit u ON u.source_id = w.source_id AND u.t = w.t AND u.d = c.d GROUP BY 1, 2, 3"""
WSCORE = """SELECT d.source_id, t, CASE WHEN s < 1e-9 THEN dist ELSE abs((dist - m) / s) END AS score, s >= 1e-9 AND abs((dist - m) / s) > 2 AS is_anomaly
  FROM dist d JOIN (SELECT d.source_id, m, sqrt(sum((dist - m) * (dist - m) * n) / sum(n)) AS s FROM dist d
    JOIN (SELECT source_id, sum(dist * n) / sum(n) AS m FROM dist GROUP BY 1) e USING (source_id) GROUP BY 1, 2) st USING (source_id)"""
DETECTED = "SELECT e.source_id, e.line_no, e.line, z.score, z.is_anomaly FROM enc e JOIN z USING (source_id, t)"
DETECT = dict(enc=ENCODED, worded=WORDED, slotted=SLOTTED, unit=UNIT, centre=CENTRE, dist=DIST, z=WSCORE, detected=DETECTED)


@query("detect", oracle("SELECT source_id, line_no, round(score, 6) AS score, is_anomaly FROM detected", "log_lines", **DETECT))
def detect(t: Tables):
    return anomaly.detect_lines(t.log_table()).select("source_id", "line_no", F.round("score", 6).alias("score"), "is_anomaly")


@query(
    "detect_cascade",
    oracle(
        """SELECT u AS source_id, count(d.line_no) AS total_lines, count(*) FILTER (d.is_anomaly) AS anomalous_lines,
             CASE WHEN count(d.line_no) = 0 THEN 'empty' ELSE 'zscore' END AS method
           FROM (SELECT DISTINCT user_id AS u FROM events UNION SELECT c_custkey FROM customer) LEFT JOIN detected d ON d.source_id = u GROUP BY 1""",
        "log_lines",
        **DETECT,
    ),
)
def detect_cascade(t: Tables):
    listed = t.events.select(F.col("user_id").alias("source_id")).union(t.customer.select("c_custkey"))
    found = anomaly.detect_cascade(t.log_table())
    return anomaly.detect_summary(found, listed).drop("threshold")


def _excerpt_sql(n):
    return f"""SELECT source_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (is_anomaly AND place <= {n}), min_by(line, line_no)) AS excerpt
      FROM (SELECT *, row_number() OVER (PARTITION BY source_id, is_anomaly ORDER BY line_no) AS place FROM detected) GROUP BY 1"""


@query("anomalous_excerpt", oracle(_excerpt_sql(5), "log_lines", **DETECT))
def anomalous_excerpt(t: Tables):
    return anomaly.anomalous_excerpt(anomaly.detect_lines(t.log_table()), 5).select("source_id", "excerpt")


def _first_rule(text, rule_list, value):
    arms = " ".join(
        f"WHEN {' OR '.join(f'contains({text}, {chr(39)}{k}{chr(39)})' for k in r.keywords)} THEN {value(r)}" for r in rule_list if r.keywords
    )
    return f"CASE {arms} ELSE {value(rule_list[-1])} END"


def _quoted(attr):
    return lambda r: "'" + getattr(r, attr) + "'"


for _profile in ("library", "service"):
    _suffix = "" if _profile == "library" else "_service"
    _rules = rules.SEVERITY_RULES[_profile]
    _table = {
        r.severity: rules.SEVERITY_SCORES[r.severity]
        if _profile == "library"
        else tuple(r.confidence if s == r.severity else 0.1 for s in rules.SEVERITIES)
        for r in _rules
    }
    _high = "CASE severity " + " ".join(f"WHEN '{s}' THEN {v[2]}" for s, v in _table.items()) + " END"

    @query(
        f"keyword_severity{_suffix}",
        oracle(
            f"SELECT event_id, severity, CAST(confidence AS DOUBLE) AS confidence, CAST({_high} AS DOUBLE) AS high_score FROM x",
            "lines",
            x=f"SELECT event_id, {_first_rule('lower(line)', _rules, _quoted('severity'))} AS severity,"
            f" {_first_rule('lower(line)', _rules, lambda r: r.confidence)} AS confidence FROM lines",
        ),
    )
    def keyword_severity(t: Tables, profile=_profile):
        got = t.lines().select("event_id", rules.keyword_severity(F.col("line"), profile).alias("s"))
        return got.select("event_id", "s.severity", "s.confidence", F.try_element_at("s.scores", F.lit("HIGH")).alias("high_score"))

    _causes = rules.CAUSE_RULES[_profile]

    @query(
        f"rule_root_cause{_suffix}",
        oracle(
            f"""SELECT event_id, {_first_rule('lower(line)', _causes, _quoted('label'))} AS root_cause,
                  {_first_rule('lower(line)', _causes, _quoted('severity'))} AS severity,
                  CAST({_first_rule('lower(line)', _causes, lambda r: r.confidence)} AS DOUBLE) AS confidence FROM lines""",
            "lines",
        ),
    )
    def rule_root_cause(t: Tables, profile=_profile):
        got = t.lines().select("event_id", rules.rule_root_cause(F.col("line"), profile).alias("c"))
        return got.select("event_id", "c.root_cause", "c.severity", "c.confidence")


@query(
    "merge_severity",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 50 > 0.82 THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
         greatest(l_quantity / 50, l_discount * 10) AS confidence FROM lineitem""",
)
def merge_severity(t: Tables):
    merged = rules.merge_severity(F.lit("CRITICAL"), F.col("l_quantity") / 50, F.lit("HIGH"), F.col("l_discount") * 10)
    return t.lineitem.select("l_orderkey", "l_linenumber", merged.alias("m")).select("l_orderkey", "l_linenumber", "m.severity", "m.confidence")


_S, _C = rules.SEVERITY_RULES["library"], rules.CAUSE_RULES["library"]
TRIAGE = f"""SELECT u AS source_id, coalesce(severity, 'INFO') AS severity, coalesce(root_cause, 'No logs provided') AS root_cause,
    coalesce(confidence, 0.5) AS confidence, coalesce(a, 0) AS anomalous_line_count, coalesce(n, 0) AS total_line_count,
    CASE WHEN coalesce(a, 0) > 0 THEN signals ELSE '' END AS top_signals
  FROM (SELECT DISTINCT user_id AS u FROM events UNION SELECT c_custkey FROM customer) LEFT JOIN (
    SELECT c.source_id, {_first_rule('lower(t50)', _C, _quoted('severity'))} AS severity, {_first_rule('lower(t50)', _C, _quoted('label'))} AS root_cause,
      CAST(greatest({_first_rule('lower(t50)', _C, lambda r: r.confidence)}, {_first_rule('lower(t40)', _S, lambda r: r.confidence)}) AS DOUBLE) AS confidence, a, n
    FROM (SELECT source_id, excerpt AS t50 FROM x50) c JOIN (SELECT source_id, excerpt AS t40 FROM x40) USING (source_id)
    JOIN (SELECT source_id, count(*) AS n, count(*) FILTER (is_anomaly) AS a FROM detected GROUP BY 1) USING (source_id)) r ON r.source_id = u
  LEFT JOIN sig ON sig.source_id = u"""


@query(
    "triage",
    oracle(
        TRIAGE, "log_lines", **DETECT, x50=_excerpt_sql(50), x40=_excerpt_sql(40), w="SELECT source_id, line_no, line FROM log_lines", joined=JOINED, sig=SIGNALS
    ),
)
def triage_sources(t: Tables):
    listed = t.events.select(F.col("user_id").alias("source_id")).union(t.customer.select("c_custkey"))
    got = triage(t.log_table(), listed)
    return got.select(
        "source_id", "severity", "root_cause", "confidence", "anomalous_line_count", "total_line_count",
        F.array_join("top_signals", "|").alias("top_signals"),
    )


@query("triage_service")
def triage_service(t: Tables):
    got = triage(t.log_table(), profile="service")
    return got.select("source_id", "severity", "root_cause", "confidence", "anomalous_line_count", "total_line_count")


@query(
    "evidence_lines",
    oracle(
        "SELECT source_id, string_agg(line, chr(10) ORDER BY line_no) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY line_no) AS place FROM detected WHERE is_anomaly) WHERE place <= 3 GROUP BY 1",
        "log_lines",
        **DETECT,
    ),
)
def evidence_lines(t: Tables):
    got = anomaly.anomalous_excerpt(anomaly.detect_lines(t.log_table()), 3).filter(F.size("lines") > 0)
    return got.select("source_id", F.array_join(F.slice("lines", 1, 3), "\n").alias("evidence"))


@query(
    "build_prompt",
    oracle(
        "SELECT source_id, md5(excerpt) AS text_hash, CAST(length(excerpt) AS BIGINT) AS text_chars FROM x50",
        "log_lines",
        **DETECT,
        x50=_excerpt_sql(50),
    ),
)
def build_prompt(t: Tables):
    from logspark.functions.reports import ANALYSIS_PROMPT, build_prompt

    found = anomaly.anomalous_excerpt(anomaly.detect_lines(t.log_table()), 50)
    lines = F.when(F.size("lines") > 0, F.col("lines")).otherwise(F.array("excerpt"))
    head, tail = (len(part) for part in ANALYSIS_PROMPT.split("%s"))
    prompt = found.select("source_id", build_prompt(lines).alias("prompt"))
    inner = F.expr(f"substring(prompt, {head + 1}, char_length(prompt) - {head + tail})")
    return prompt.select("source_id", F.md5(inner).alias("text_hash"), F.char_length(inner).cast("bigint").alias("text_chars"))


@query(
    "batch_rows",
    oracle(
        "SELECT source_id, line_no // 20 AS batch_no, count(*) AS batch_size, min_by(line, line_no) AS first_line, max_by(line, line_no) AS last_line FROM log_lines GROUP BY 1, 2",
        "log_lines",
    ),
)
def batch_rows(t: Tables):
    got = sources.batch_rows(t.log_lines(), 20)
    return got.select(
        "source_id", "batch_no", F.col("batch_size").cast("bigint").alias("batch_size"),
        F.element_at("lines", 1).alias("first_line"), F.element_at("lines", -1).alias("last_line"),
    )
