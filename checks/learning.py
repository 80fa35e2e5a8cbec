"""Similarity, budgets, feedback, bandit, forecasts, models and training sets (J, W, A, B, T, M, C rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Tables, oracle, query
from checks.lines import SCORES, VECTORS, _vectors
from logspark.functions import reports
from logspark.functions.text import estimate_tokens
from logspark.operators import anomaly, bandit, budget, feedback, forecast, models, similarity, training, windows
from logspark.operators.vector_store import VectorStore
from logspark.plans import scan
from logspark.session import save_and_read, scratch_path

# ---- similarity -------------------------------------------------------------------------------

# The query set of searches: every row whose id is divisible by 20, against all rows.
ASKED = "SELECT * FROM embeddings WHERE vec_id % 20 = 0"


def _queries(t: Tables):
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _corpus(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("corpus_id"), F.col("embedding").alias("vector"))


_D = "CAST(embedding AS DOUBLE[])"
PAIRS = f"""SELECT q.vec_id AS query_id, c.vec_id AS corpus_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS cosine,
  -list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS euclidean,
  list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS dot FROM f q, embeddings c"""


@query("pairwise_similarity", oracle("SELECT query_id, corpus_id, round(cosine, 5) + 0 AS cosine, round(euclidean, 5) + 0 AS euclidean FROM p", f=ASKED, p=PAIRS))
def pairwise_similarity(t: Tables):
    got = similarity.similarity_matrices(_queries(t), _corpus(t), ["cosine", "euclidean"])
    return got.select("query_id", "corpus_id", (F.round("cosine", 5) + 0).alias("cosine"), (F.round("euclidean", 5) + 0).alias("euclidean"))


def _top_sql(metric, k):
    return f"SELECT query_id, corpus_id, round({metric}, 5) AS similarity, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {metric} DESC, corpus_id) AS place FROM p) WHERE place <= {k}"


@query("top_k_similar", oracle(_top_sql("cosine", 5), f=ASKED, p=PAIRS))
def top_k_similar(t: Tables):
    return similarity.top_k_similar(_queries(t), _corpus(t), 5).withColumn("similarity", F.round("similarity", 5))


@query(
    "similar_log_search",
    oracle("SELECT query_id, corpus_id, similarity, rank, 'vector ' || corpus_id AS line, CAST(label AS VARCHAR) AS label FROM s JOIN embeddings ON vec_id = corpus_id", f=ASKED, p=PAIRS, s=_top_sql("dot", 10)),
)
def similar_log_search(t: Tables):
    store = t.embeddings.select(
        F.col("vec_id").alias("corpus_id"), F.col("embedding").alias("vector"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("line"),
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"),
    )
    got = similarity.similar_log_search(_queries(t), store, 10)
    return got.select("query_id", "corpus_id", F.round("similarity", 5).alias("similarity"), "rank", "line", F.try_element_at("metadata", F.lit("label")).alias("label"))


@query("vector_store_search", oracle("SELECT query_id, corpus_id, similarity, rank, label FROM s JOIN embeddings ON vec_id = corpus_id", f=ASKED, p=PAIRS, s=_top_sql("dot", 10)))
def vector_store_search(t: Tables):
    """A store filled in three deltas."""
    rows = t.embeddings.select(F.col("vec_id").alias("corpus_id"), F.col("embedding").alias("vector"), "label")
    store = VectorStore.create(t.spark, scratch_path(t.spark, "store"), rows)
    for part in range(3):
        store.append(rows.where(F.pmod("label", F.lit(3)) == part))
    got = store.search(_queries(t), 10, columns=("label",))
    return got.withColumn("similarity", F.round("similarity", 5)).drop("cells")


@query(
    "knn_join",
    """SELECT id, neighbour, round(d, 5) AS dist, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbour) AS place FROM (
         SELECT a.vec_id AS id, b.vec_id AS neighbour, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d
         FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE place <= 5""",
)
def knn_join(t: Tables):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return similarity.knn_join(rows, 5).withColumn("dist", F.round("dist", 5))


DENSE_WINDOWS = f"""SELECT w.source_id, w.start, d, avg(x) AS x FROM (SELECT source_id, unnest(range(0, n - 3)) AS start FROM (SELECT source_id, count(*) AS n FROM v GROUP BY 1) WHERE n >= 4) w
  JOIN long l ON l.source_id = w.source_id AND l.line_no BETWEEN w.start AND w.start + 3 GROUP BY 1, 2, 3"""
DENSE = """SELECT source_id, start, avg(d) AS score FROM (SELECT a.source_id, a.start, 1 - list_cosine_similarity(a.e, b.e) AS d,
    row_number() OVER (PARTITION BY a.source_id, a.start ORDER BY 1 - list_cosine_similarity(a.e, b.e), b.start) AS place
  FROM dw a JOIN dw b ON a.source_id = b.source_id AND a.start <> b.start) WHERE place <= 5 GROUP BY 1, 2"""
DENSITY = dict(
    v=VECTORS,
    long="SELECT source_id, line_no, unnest(range(len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM v",
    lw=DENSE_WINDOWS,
    dw="SELECT source_id, start, list(x ORDER BY d) AS e FROM lw GROUP BY 1, 2",
    dense=DENSE,
)


@query("density_anomaly", oracle("SELECT source_id, start, round(score, 5) AS score FROM dense", **DENSITY))
def density_anomaly(t: Tables):
    return similarity.density_windows(_vectors(t)).withColumn("score", F.round("score", 5))


# ---- budget and scan --------------------------------------------------------------------------

SOURCES = """SELECT source AS run_id, concat('doc-', doc_id) AS log_group, text FROM documents"""
# Two runs per document source: one with room for everything, one too small.
BUDGETS = "SELECT source AS run_id, CASE WHEN substr(source, 4)::INT % 4 = 0 THEN 10000000 ELSE 2000 + 100 * substr(source, 4)::INT END AS available FROM documents GROUP BY 1"
PLAN = """WITH RECURSIVE ordered AS (
    SELECT run_id, log_group, length(text) // 4 AS tokens, row_number() OVER (PARTITION BY run_id ORDER BY length(text) // 4, log_group) AS i,
      count(*) OVER (PARTITION BY run_id) AS n, sum(length(text) // 4) OVER (PARTITION BY run_id) AS total, available
    FROM (SELECT source AS run_id, 'doc-' || doc_id AS log_group, text FROM documents) JOIN (%s) b USING (run_id)),
  step AS (
    SELECT run_id, i, n, log_group, tokens, total, available, available::BIGINT AS budget FROM ordered WHERE i = 1
    UNION ALL
    SELECT o.run_id, o.i, o.n, o.log_group, o.tokens, o.total, o.available, (s.budget - least(s.tokens, s.budget // (s.n - s.i + 1)))::BIGINT
    FROM step s JOIN ordered o ON o.run_id = s.run_id AND o.i = s.i + 1)
  SELECT run_id, log_group, tokens::BIGINT AS tokens, total > available AND tokens > budget // (n - i + 1) AS needs_reduction,
    CASE WHEN total > available AND tokens > budget // (n - i + 1) THEN round(least(greatest((budget // (n - i + 1)) / tokens, 0.01), 1.0), 9) END AS share FROM step""" % BUDGETS


def _budgets(t: Tables):
    number = F.substring("source", 4, 9).cast("int")
    sizes = t.documents.select("source", F.when(number % 4 == 0, 10_000_000).otherwise(2000 + 100 * number).cast("bigint").alias("available"))
    return sizes.distinct().withColumnRenamed("source", "run_id")


@query("token_budget_plan", PLAN)
def token_budget_plan(t: Tables):
    rows = t.documents.select(
        F.col("source").alias("run_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("log_group"), estimate_tokens(F.col("text")).alias("tokens")
    )
    return budget.token_budget_plan(rows, _budgets(t)).withColumn("share", F.round("share", 9)).drop("place")


@query(
    "available_tokens",
    """SELECT doc_id, greatest(CASE WHEN n_chars % 3 = 0 THEN 1000000 ELSE n_chars * 4 END - (4096 + length(text) // 4 + 7 + 500), 0)::BIGINT AS available FROM documents""",
)
def available_tokens(t: Tables):
    window = F.when(F.col("n_chars") % 3 == 0, F.lit(0)).otherwise(F.col("n_chars") * 4)
    left = budget.available_tokens(window, F.lit(4096), estimate_tokens(F.col("text")), F.lit(7))
    return t.documents.select("doc_id", left.alias("available"))


@query("multi_source_scan")
def multi_source_scan(t: Tables):
    days = F.date_format("ts", "yyyy-MM-dd")
    from logspark.operators.ordering import number_rows

    rows = t.lines().join(t.log_events().select("event_id", "log_group"), "event_id").withColumn("run_id", days)
    lines = number_rows(rows, ["run_id", "log_group"], F.col("ts"), F.col("event_id"))
    lines = save_and_read(lines.select("run_id", "log_group", "line_no", "line"), "log-lines")
    budgets = lines.select("run_id").distinct().withColumn("available", F.lit(2000).cast("bigint"))
    return scan.multi_source_scan(lines, budgets)


# ---- feedback ---------------------------------------------------------------------------------


@query("feedback_for_training", oracle("SELECT feedback_id, suggestion, suggestion_quality FROM feedback WHERE suggestion_quality >= 6 ORDER BY feedback_id LIMIT 200", "feedback"))
def feedback_for_training(t: Tables):
    return feedback.feedback_for_training(t.feedback(), 100).select("feedback_id", "suggestion", "suggestion_quality")


@query(
    "feedback_statistics",
    oracle(
        """SELECT count(*) AS total_feedback, round(avg(suggestion_quality), 6) AS avg_suggestion_quality, round(avg(overall_satisfaction), 6) AS avg_satisfaction,
             count(*) FILTER (was_helpful) AS helpful_count, round(count(*) FILTER (was_helpful) / count(*), 6) AS helpful_rate FROM feedback""",
        "feedback",
    ),
)
def feedback_statistics(t: Tables):
    got = feedback.feedback_statistics(t.feedback())
    return got.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in got.dtypes])


@query(
    "trending_suggestions",
    oracle(
        """SELECT suggestion, count(*) AS count, round(avg(suggestion_quality), 6) AS avg_quality, round(avg(was_helpful::INT), 6) AS helpful_rate,
             count(*) FILTER (was_helpful) AS helpful FROM feedback WHERE suggestion_quality >= 6 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
        "feedback",
    ),
)
def trending_suggestions(t: Tables):
    good = t.feedback().filter("suggestion_quality >= 6")
    return feedback.trending_suggestions(good).withColumns({c: F.round(c, 6) for c in ("avg_quality", "helpful_rate")})


@query("problem_suggestions", oracle("SELECT feedback_id, suggestion, suggestion_quality, incident_severity FROM feedback WHERE suggestion_quality <= 4", "feedback"))
def problem_suggestions(t: Tables):
    return feedback.problem_suggestions(t.feedback()).select("feedback_id", "suggestion", "suggestion_quality", "incident_severity")


@query("reward_target", oracle("SELECT feedback_id, round(0.7 * suggestion_quality / 10 + 0.3 * was_helpful::INT, 6)::DOUBLE AS target FROM feedback", "feedback"))
def reward_target(t: Tables):
    target = feedback.reward_target(F.col("suggestion_quality"), F.col("was_helpful"))
    return t.feedback().select("feedback_id", F.round(target, 6).alias("target"))


@query(
    "preference_pairs",
    oracle(
        """SELECT chosen, rejected, chosen_quality, n * m AS pairs FROM
             (SELECT suggestion AS chosen, suggestion_quality AS chosen_quality, count(*) AS n FROM feedback WHERE suggestion_quality >= 7 GROUP BY 1, 2),
             (SELECT suggestion AS rejected, count(*) AS m FROM feedback WHERE suggestion_quality <= 4 GROUP BY 1)""",
        "feedback",
    ),
)
def preference_pairs(t: Tables):
    return feedback.preference_pairs(t.feedback())


EPISODES = "SELECT incident_id, action_id, feedback_score, row_number() OVER (ORDER BY incident_id, line_number, action_id, ts, feedback_score) - 1 AS episode FROM bandit_log"


@query(
    "rolling_feedback",
    """SELECT feedback_id, round(avg(q) OVER (ORDER BY feedback_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS rolling
       FROM (SELECT o_orderkey AS feedback_id, o_orderkey % 11 AS q FROM orders)""",
)
def rolling_feedback(t: Tables):
    from logspark.operators.ordering import number_rows

    rows = t.feedback().select("feedback_id", "suggestion_quality", F.lit(0).alias("g"))
    numbered = number_rows(rows, ["g"], F.col("feedback_id"), F.col("feedback_id"), out="episode")
    got = feedback.rolling_feedback(numbered, "episode", "suggestion_quality")
    return got.select("feedback_id", F.round("rolling", 6).alias("rolling"))


# ---- bandit -----------------------------------------------------------------------------------

ALARMS = "CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(bandit.ALARM_TYPES)) + " ELSE 'Odd' END"
CASES = f"""SELECT o_orderkey AS incident_id, {ALARMS} AS alarm_type, CASE o_orderstatus WHEN 'F' THEN 'CRITICAL' WHEN 'P' THEN 'HIGH' ELSE 'WARNING' END AS severity,
  concat('svc-', o_custkey % 90) AS service, o_orderdate + o_orderkey % 24 * INTERVAL '1' HOUR AS ts FROM orders"""
IDS = "SELECT service, row_number() OVER (ORDER BY min(ts), min((ts, incident_id))) - 1 AS service_idx FROM cs GROUP BY 1"


@query("service_ids", oracle("SELECT * FROM ids", cs=CASES, ids=IDS))
def service_ids(t: Tables):
    return bandit.service_ids(t.sql(CASES, "orders"))


@query(
    "bandit_context",
    oracle(
        f"""SELECT incident_id, round(greatest(coalesce(list_position({list(bandit.ALARM_TYPES)}, alarm_type), 1) - 1, 0) / 8
              + 10 * (CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) / 4 + 100 * service_idx / 100
              + 1000 * hour(ts) / 24 + 10000 * (isodow(ts) - 1) / 7 + CASE WHEN hour(ts) >= 9 AND hour(ts) < 18 THEN 100000 ELSE 0 END, 5) AS mark
            FROM cs JOIN ids USING (service)""",
        cs=CASES,
        ids=IDS,
    ),
)
def bandit_context(t: Tables):
    x = bandit.bandit_context(t.sql(CASES, "orders"))
    mark = F.aggregate(F.transform("x", lambda v, i: v * F.pow(F.lit(10.0), i)), F.lit(0.0), lambda s, v: s + v)
    return x.select("incident_id", F.round(mark, 5).alias("mark"))


REWARDS = """SELECT *, [alarm_type_idx / 8, severity_idx / 4, service_idx / 100, hour(ts) / 24, (isodow(ts) - 1) / 7, CASE WHEN hour(ts) >= 9 AND hour(ts) < 18 THEN 1 ELSE 0 END] AS x,
  feedback_score * CASE WHEN was_helpful THEN 1.0 ELSE 0.5 END AS reward FROM bandit_log"""


def _plans(t: Tables):
    x = bandit.context_vector(F.col("alarm_type_idx"), F.col("severity_idx"), F.col("service_idx"), F.col("ts"))
    return t.bandit_log().withColumns({"x": x, "actions": F.array("action_id"), "helpful": F.array("was_helpful")}).drop("action_id")


def _rewards(t: Tables):
    return bandit.apply_feedback(_plans(t))


@query(
    "apply_feedback",
    """SELECT l_orderkey, a AS action_id, count(*) AS n, round(sum(r), 5) AS reward FROM (
         SELECT l_orderkey, unnest(actions) AS a, unnest(flags) AS f, l_discount * 10 * CASE WHEN unnest(flags) THEN 1.0 ELSE 0.5 END AS r FROM (
           SELECT *, [l_partkey % 8, l_suppkey % 8][1:k] AS actions, [l_returnflag = 'R', l_linestatus = 'O'][1:k] AS flags FROM (
             SELECT *, CASE l_linenumber WHEN 1 THEN 1 ELSE 2 END AS k FROM lineitem WHERE l_linenumber <> 2)
           UNION ALL SELECT *, [l_partkey % 8, l_suppkey % 8], [true, true] FROM (SELECT *, 2 AS k FROM lineitem WHERE l_linenumber = 2)))
       GROUP BY 1, 2""",
)
def apply_feedback(t: Tables):
    chosen = F.array((F.col("l_partkey") % 8), (F.col("l_suppkey") % 8))
    flags = F.array(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")
    given = F.when(F.col("l_linenumber") == 1, F.slice(flags, 1, 1)).when(F.col("l_linenumber") != 2, flags)
    rows = t.lineitem.select("l_orderkey", chosen.alias("actions"), given.alias("helpful"), (F.col("l_discount") * 10).alias("feedback_score"))
    return bandit.apply_feedback(rows).groupBy("l_orderkey", "action_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("reward"), 5).alias("reward"))


@query(
    "linucb_fit",
    oracle(
        """SELECT action_id, count(*) AS interactions, round(sum(reward), 4) AS total_reward, round(1 + sum(x[1] * x[1]), 4) AS a00, round(sum(x[2] * x[4]), 4) AS a13,
             round(1 + sum(x[6] * x[6]), 4) AS a55, round(sum(reward * x[1]), 4) AS b0, round(sum(reward * x[5]), 4) AS b4 FROM r GROUP BY 1""",
        "bandit_log",
        r=REWARDS,
    ),
)
def linucb_fit(t: Tables):
    got = bandit.linucb_fit(_rewards(t), bandit.actions(t.spark))
    cells = {"a00": F.get("a", F.lit(0)), "a13": F.get("a", F.lit(9)), "a55": F.get("a", F.lit(35)), "b0": F.get("b", F.lit(0)), "b4": F.get("b", F.lit(4))}
    return got.select("action_id", "interactions", F.round("total_reward", 4).alias("total_reward"), *[F.round(c, 4).alias(n) for n, c in cells.items()])


@query("bandit_performance", oracle("SELECT count(*) AS total_interactions, round(sum(reward), 4) AS total_reward, round(avg(reward), 6) AS average_reward FROM r", "bandit_log", r=REWARDS))
def bandit_performance(t: Tables):
    return bandit.bandit_performance(_rewards(t)).withColumns({"total_reward": F.round("total_reward", 4), "average_reward": F.round("average_reward", 6)})


def _contexts(t: Tables):
    return bandit.bandit_context(t.sql(CASES, "orders")).select("incident_id", "x")


def _model(t: Tables):
    return bandit.linucb_fit(_rewards(t), bandit.actions(t.spark))


@query("score_actions")
def score_actions(t: Tables):
    got = bandit.score_actions(_contexts(t), _model(t))
    return got.withColumns({"estimate": F.round("estimate", 6), "ucb": F.round("ucb", 6)})


@query("linucb_select")
def linucb_select(t: Tables):
    return bandit.linucb_select(_contexts(t), _model(t)).withColumns({"estimate": F.round("estimate", 6), "ucb": F.round("ucb", 6)})


@query("prefetch_plan")
def prefetch_plan(t: Tables):
    return bandit.prefetch_plan(_contexts(t), _model(t)).select("incident_id", F.array_join("actions", ",").alias("actions"))


# An episode per order: its distinct actions and its mean score.
EPISODE = """SELECT l_orderkey AS incident_id, list_sort(list(DISTINCT (l_partkey + l_linenumber) % 8)) AS actions, avg(l_discount * 10) AS feedback FROM lineitem GROUP BY 1"""


def _episodes(t: Tables):
    return t.bandit_log().groupBy("incident_id").agg(F.array_sort(F.collect_set("action_id")).alias("actions"), F.avg("feedback_score").alias("feedback"))


NAMES = "(VALUES " + ", ".join(f"({a[0]}, '{a[1]}', {a[3]}, {a[4]})" for a in bandit.ACTIONS) + ") n(action_id, name, estimated_cost, estimated_latency_ms)"
REPORT = f"""SELECT action_id, name, estimated_cost::DOUBLE AS estimated_cost, estimated_latency_ms::DOUBLE AS estimated_latency_ms, coalesce(k, 0) AS total_selections,
    coalesce(k / sum(k) OVER (), 0) AS selection_rate, coalesce(r / k, 0) AS avg_reward FROM {NAMES}
  LEFT JOIN (SELECT a, count(*) AS k, sum(f) AS r FROM (SELECT unnest(actions) AS a, feedback / len(actions) AS f FROM ep) GROUP BY 1) ON a = action_id"""


@query(
    "policy_action_report",
    oracle(
        """SELECT action_id, name, estimated_cost, estimated_latency_ms, total_selections, round(selection_rate, 6) AS selection_rate, round(avg_reward, 6) AS avg_reward,
             action_id = (SELECT arg_max(action_id, avg_reward) FROM rep) AS best, action_id = (SELECT arg_min(action_id, avg_reward) FROM rep) AS worst FROM rep""",
        ep=EPISODE,
        rep=REPORT,
    ),
)
def policy_action_report(t: Tables):
    got = bandit.policy_action_report(_episodes(t), bandit.actions(t.spark)).drop("description")
    return got.withColumns({c: F.round(c, 6) for c in ("selection_rate", "avg_reward")})


SUMMARY = """SELECT count(*) AS num_episodes, round(avg(feedback), 6) AS avg_reward, round(stddev_pop(feedback), 6) AS std_reward, round(min(feedback), 6) AS min_reward,
  round(max(feedback), 6) AS max_reward, round(sum(feedback), 4) AS total_reward, round(avg(len(actions)), 6) AS avg_actions_per_incident FROM ep"""


@query("policy_summary", oracle(SUMMARY, ep=EPISODE))
def policy_summary(t: Tables):
    got = bandit.policy_summary(_episodes(t))
    return got.select(*[F.round(c, 4 if c == "total_reward" else 6).alias(c) if k == "double" else F.col(c) for c, k in got.dtypes])


@query("report_writer", oracle("SELECT incident_id, array_to_string(actions, ',') AS actions, round(feedback, 6) AS feedback FROM ep", ep=EPISODE))
def report_writer(t: Tables):
    from logspark.session import scratch_path

    path = scratch_path(t.spark, "report")
    bandit.write_policy_report(_episodes(t), bandit.actions(t.spark), path)
    return t.spark.read.parquet(f"{path}/results").select("incident_id", F.array_join("actions", ",").alias("actions"), F.round("feedback", 6).alias("feedback"))


# ---- forecasts --------------------------------------------------------------------------------

METRIC_NAMES = list(forecast.THRESHOLDS)
LIMITS = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in forecast.THRESHOLDS.items()) + ") d(metric, lim)"
SERIES = f"""SELECT s_suppkey, CASE s_suppkey % 6 {' '.join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(METRIC_NAMES))} ELSE 'odd' END AS metric,
  CASE WHEN s_suppkey % 4 = 0 THEN 0.0 WHEN s_suppkey % 4 = 1 THEN s_acctbal END AS own FROM supplier"""


@query(
    "metric_thresholds",
    oracle(
        f"""SELECT s_suppkey, s.metric, CASE WHEN lim IS NOT NULL THEN coalesce(nullif(own, 0), lim) END::DOUBLE AS threshold,
              CASE WHEN lim IS NULL THEN 'Unsupported metric: ' || s.metric END AS error FROM s LEFT JOIN {LIMITS} ON d.metric = s.metric""",
        s=SERIES,
    ),
)
def metric_thresholds(t: Tables):
    return forecast.metric_thresholds(t.sql(SERIES, "supplier"), "own").drop("own")


# Forecast points: one per event.
POINTS = "SELECT event_id, event_type AS series_id, ts AS ds, value AS yhat, value * 0.8 - user_id / 10.0 AS yhat_lower, value * (1 + user_id / 400.0) AS yhat_upper, 100 + user_id AS threshold FROM events"
_T = "(1 / (1 + 0.2316419 * abs(z)))"
_TAIL = "exp(-z * z / 2) / sqrt(2 * pi()) * (" + " + ".join(f"{c} * pow({_T}, {i + 1})" for i, c in enumerate(forecast.TAIL)) + ")"
LIKELY = f"""SELECT *, CASE WHEN yhat_upper < threshold THEN 0.0 WHEN yhat_lower > threshold THEN 1.0 WHEN z >= 0 THEN {_TAIL} ELSE 1 - {_TAIL} END::DOUBLE AS likelihood FROM (
  SELECT *, CASE WHEN yhat_upper > yhat_lower THEN (threshold - yhat) / ((yhat_upper - yhat_lower) / 3.92) ELSE 0 END AS z FROM pts)"""


def _likely(t: Tables):
    chance = forecast.breach_likelihood(F.col("yhat_lower"), F.col("yhat_upper"), F.col("yhat"), F.col("threshold"))
    return t.sql(POINTS, "events").withColumn("likelihood", chance)


@query("breach_likelihood", oracle("SELECT event_id, round(likelihood, 5) AS likelihood FROM l", pts=POINTS, l=LIKELY))
def breach_likelihood(t: Tables):
    return _likely(t).select("event_id", F.round("likelihood", 5).alias("likelihood"))


@query(
    "breach_rollup",
    oracle(
        """SELECT p.series_id, forecast_points, breach_probability, first_breach_time, sample FROM (
             SELECT series_id, count(*) AS forecast_points, round(1 - product(1 - likelihood / 50), 6) AS breach_probability, min(ds) FILTER (likelihood > 0.5) AS first_breach_time FROM l GROUP BY 1) p
           JOIN (SELECT series_id, string_agg(CAST(CAST(round(yhat * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY ds) AS sample FROM (
             SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS place FROM l) WHERE place <= 3 GROUP BY 1) s ON s.series_id = p.series_id""",
        pts=POINTS,
        l=LIKELY,
    ),
)
def breach_rollup(t: Tables):
    scaled = _likely(t).withColumn("full", F.col("likelihood"))
    rolled = forecast.breach_rollup(scaled.withColumn("likelihood", F.col("likelihood") / 50))
    first = forecast.breach_rollup(_likely(t)).select("series_id", "first_breach_time")
    values = F.transform("sample_points", lambda p: F.round(p["yhat"] * 100).cast("bigint").cast("string"))
    return rolled.drop("first_breach_time").join(first, "series_id").select(
        "series_id", "forecast_points", F.round("breach_probability", 6).alias("breach_probability"),
        F.col("first_breach_time").cast("timestamp_ntz").alias("first_breach_time"), F.array_join(values, ",").alias("sample"),
    )


@query(
    "forecast_summary",
    oracle(
        """SELECT series_id, round(avg((yhat_upper > yhat * 1.2)::INT), 6) AS breach_probability, min(ds) FILTER (yhat_upper > m / 4 * 1.5) AS estimated_breach_time,
             CASE WHEN max_by(yhat, ds) > min_by(yhat, ds) THEN 'rising' WHEN max_by(yhat, ds) < min_by(yhat, ds) THEN 'falling' ELSE 'stable' END AS trend, count(*) AS points
           FROM pts, (SELECT event_type AS s, max(value) AS m FROM events GROUP BY 1) WHERE s = series_id GROUP BY 1""",
        pts=POINTS,
    ),
)
def forecast_summary(t: Tables):
    highest = t.events.groupBy(F.col("event_type").alias("series_id")).agg((F.max("value") / 4).alias("y_max"))
    got = forecast.forecast_summary(t.sql(POINTS, "events").withColumn("trend", F.col("yhat")), highest)
    return got.withColumns({"breach_probability": F.round("breach_probability", 6), "estimated_breach_time": F.col("estimated_breach_time").cast("timestamp_ntz")})


def _series(t: Tables):
    return t.events.select(F.col("event_type").alias("series_id"), F.col("ts").alias("ds"), F.col("value").alias("y"))


@query("fit_forecast")
def fit_forecast(t: Tables):
    got = forecast.fit_forecast(_series(t), 60, 5)
    return got.withColumns({c: F.round(c, 3) for c in ("yhat", "yhat_lower", "yhat_upper", "trend")})


@query("forecast")
def forecast_series(t: Tables):
    return forecast.forecast(_series(t), 60)


@query("forecast_all")
def forecast_all(t: Tables):
    names = F.create_map(F.lit("error"), F.lit("error_rate"), F.lit("view"), F.lit("cpu_utilization"), F.lit("click"), F.lit("memory_usage"),
                         F.lit("purchase"), F.lit("latency_p99"), F.lit("signup"), F.lit("unknown_metric"))
    rows = _series(t).withColumn("metric", F.try_element_at(names, F.col("series_id")))
    return forecast.forecast_all(rows).withColumn("breach_probability", F.round("breach_probability", 4)).drop("sample_points")


# ---- training ---------------------------------------------------------------------------------

LOGS = "SELECT doc_id AS id, source AS incident_id, text FROM documents"


@query(
    "contrastive_pairs",
    oracle(
        """SELECT id, string_agg(text, '|' ORDER BY o) AS negatives FROM (SELECT a.id, b.text, b.id AS o, row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS place
             FROM (SELECT id, incident_id FROM logs) a JOIN logs b ON a.incident_id <> b.incident_id) WHERE place <= 3 GROUP BY 1""",
        logs=LOGS,
    ),
)
def contrastive_pairs(t: Tables):
    got = training.contrastive_pairs(t.sql(LOGS, "documents"))
    return got.select("id", F.array_join("negatives", "|").alias("negatives"))


@query(
    "train_val_split",
    "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY n_chars, doc_id) <= floor((SELECT count(*) FROM documents) * 0.8) THEN 'train' ELSE 'val' END AS split FROM documents",
)
def train_val_split(t: Tables):
    return training.train_val_split(t.documents.select("doc_id", "n_chars"), "n_chars", tie="doc_id").select("doc_id", "split")


@query(
    "classification_metrics",
    oracle(
        """SELECT round(avg(((score >= 0.5)::INT = label)::INT), 6) AS accuracy, round(avg(((score >= 0.5)::INT = label)::INT) FILTER (label = 1), 6) AS sensitivity,
             round(avg(((score >= 0.5)::INT = label)::INT) FILTER (label = 0), 6) AS specificity FROM s""",
        s=SCORES,
    ),
)
def classification_metrics(t: Tables):
    got = training.classification_metrics(t.sql(SCORES, "lineitem"))
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


@query("prediction_correlation", "SELECT round(corr(l_extendedprice, l_quantity), 6) AS correlation FROM lineitem")
def prediction_correlation(t: Tables):
    return training.prediction_correlation(t.lineitem, "l_extendedprice", "l_quantity").select(F.round("correlation", 6).alias("correlation"))


@query(
    "operation_durations",
    "SELECT event_type AS operation, count(nullif(d, 0)) AS runs, round(avg(nullif(d, 0)), 6) AS mean_ms, min(nullif(d, 0)) AS min_ms, max(nullif(d, 0)) AS max_ms FROM (SELECT event_type, CASE WHEN user_id % 3 = 0 THEN 0 WHEN user_id % 3 = 1 THEN value END AS d FROM events) GROUP BY 1",
)
def operation_durations(t: Tables):
    d = F.when(F.col("user_id") % 3 == 0, 0.0).when(F.col("user_id") % 3 == 1, F.col("value"))
    got = training.operation_durations(t.events.select(F.col("event_type").alias("operation"), d.alias("duration_ms")))
    return got.withColumn("mean_ms", F.round("mean_ms", 6))


# Training histories: the events of a user are the epochs of a run.
HISTORY = "SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, value AS val_loss FROM events"


@query(
    "early_stopping",
    oracle(
        """SELECT run_id, max(epoch) FILTER (up) AS best_epoch, min(val_loss) AS best_loss, any_value(stop) AS stop_epoch FROM (
             SELECT *, min(epoch) FILTER (wait >= 5) OVER (PARTITION BY run_id) AS stop FROM (
               SELECT *, epoch - max(CASE WHEN up THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch) AS wait FROM (
                 SELECT *, coalesce(val_loss < min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS up FROM h)))
           WHERE stop IS NULL OR epoch <= stop GROUP BY 1""",
        h=HISTORY,
    ),
)
def early_stopping(t: Tables):
    from logspark.operators.ordering import number_rows

    rows = number_rows(t.events.select(F.col("user_id").alias("run_id"), "event_id", F.col("value").alias("val_loss")), ["run_id"], F.col("event_id"), F.col("event_id"), out="epoch")
    return training.early_stopping(rows.select("run_id", (F.col("epoch") + 1).alias("epoch"), "val_loss"))


# ---- models -----------------------------------------------------------------------------------


ENCODED = """SELECT event_id, d, count(*) AS c FROM (SELECT event_id, unnest(list_transform(regexp_extract_all(lower(substr(line, 1, 1024)), '[\\p{L}_]+'),
  lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 64)) AS d FROM lines) GROUP BY 1, 2"""


@query(
    "embed_lines",
    oracle("SELECT event_id, round(sum(x * x), 6) AS length, round(sum(x * (d + 1)), 6) AS mark FROM (SELECT event_id, d, c / sqrt(sum(c * c) OVER (PARTITION BY event_id)) AS x FROM e) GROUP BY 1", "lines", e=ENCODED),
)
def embed_lines(t: Tables):
    got = models.embed_lines(t.lines())
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    mark = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return got.select("event_id", F.round(length, 6).alias("length"), F.round(mark, 6).alias("mark"))


def _labelled(t: Tables):
    """Vectors as lines in order of vec_id; one in ten labels is anomalous."""
    from logspark.operators.ordering import number_rows

    rows = t.embeddings.select((F.col("vec_id") % 4).alias("source_id"), "vec_id", "embedding", (F.col("label") < 6).cast("int").alias("label"))
    return number_rows(rows, ["source_id"], F.col("vec_id"), F.col("vec_id"))


@query("reconstruction_anomaly")
def reconstruction_anomaly(t: Tables):
    model = models.fit_reconstruction(t.embeddings, "vec_id")
    return model.detect(t.embeddings).select("vec_id", F.round("score", 6).alias("score"), "is_anomaly")


@query("sequence_anomaly")
def sequence_anomaly(t: Tables):
    lines = save_and_read(_labelled(t), "labelled")
    model = models.fit_sequence(lines)
    scored = models.sequence_anomaly(model, lines)
    limit = anomaly.calibrate_percentile(models.score_windows(model, lines, label="label"))
    return scored.select("source_id", "line_no", F.round("score", 4).alias("score"), (F.col("score") > limit.select("threshold").scalar()).alias("is_anomaly"))


def _severity_rows(t: Tables):
    from logspark.functions.rules import keyword_severity

    return t.lines().select("event_id", F.col("line").alias("text"), keyword_severity(F.col("line"))["severity"].alias("label"))


@query("severity_model")
def severity_model(t: Tables):
    rows = _severity_rows(t)
    split = training.random_split(rows, ["event_id"])
    model = models.fit_severity(split.filter("split = 'train'"))
    got = models.predict_severity(rows, model)
    return got.select("event_id", "severity", F.round("confidence", 3).alias("confidence"))


@query("reward_model")
def reward_model(t: Tables):
    _, scored = models.fit_reward(t.feedback())
    return scored.select("feedback_id", F.round("target", 4).alias("target"), F.round("prediction", 4).alias("prediction"))


@query("train")
def train(t: Tables):
    lines = t.log_table()
    _, registry = models.train_detector(lines)
    return registry.select("kind", F.round("threshold", 6).alias("threshold"), F.round("val_loss", 6).alias("val_loss"))
