"""Choice of look-ups with a linear contextual bandit (LinUCB).

The model of an action is a sum over its feedback rows, so fitting is one aggregation and can also
be kept up to date by a stream.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.operators.ordering import first_rows, number_rows

# Look-up actions as id, name, description, relative cost, latency in milliseconds.
ACTIONS = (
    (0, "cpu_metrics", "Fetch CPU utilization metrics", 1.0, 100.0),
    (1, "memory_metrics", "Fetch memory usage metrics", 1.0, 100.0),
    (2, "error_rate", "Fetch error rate metrics", 1.2, 150.0),
    (3, "latency_p99", "Fetch P99 latency metrics", 1.2, 150.0),
    (4, "recent_logs", "Query recent error logs", 2.0, 300.0),
    (5, "dependencies", "Check service dependencies", 1.5, 200.0),
    (6, "database_perf", "Query database performance", 1.8, 250.0),
    (7, "dynamodb_throttle", "Check DynamoDB throttling", 1.0, 120.0),
)
# Alarm types and severities in index order.
ALARM_TYPES = (
    "HighCPU", "HighMemory", "HighErrorRate", "HighLatency",
    "ServiceDown", "DatabaseIssue", "DependencyFailure", "UnexpectedBehavior",
)
SEVERITIES = ("INFO", "WARNING", "HIGH", "CRITICAL")
DIM = 6
ALPHA, RIDGE = 0.1, 1.0
PLAN_SIZE = 3
UNHELPFUL_FACTOR = 0.5


def actions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(ACTIONS), "action_id int, name string, description string, estimated_cost double, estimated_latency_ms double"
    )


def _position(value: Column, names: tuple[str, ...]) -> Column:
    """Index in a fixed list; an unknown or missing name counts as the first."""
    found = F.array_position(F.array(*[F.lit(n) for n in names]), value)
    return F.coalesce(F.greatest(found - 1, F.lit(0)), F.lit(0)).cast("int")


def context_vector(alarm_idx: Column, severity_idx: Column, service_idx: Column, ts: Column) -> Column:
    """The six features of an incident, each scaled to about 0..1."""
    hour = F.hour(ts)
    busy = F.when((hour >= 9) & (hour < 18), 1.0).otherwise(0.0)
    parts = [alarm_idx / 8.0, severity_idx / 4.0, service_idx / 100.0, hour / 24.0, F.weekday(ts) / 7.0, busy]
    return F.array(*[p.cast("double") for p in parts])


def service_ids(incidents: DataFrame) -> DataFrame:
    """``service, service_idx``: dense ids in the order of first appearance (``ts``, then id)."""
    first = incidents.groupBy("service").agg(F.min(F.struct("ts", "incident_id")).alias("_f"))
    flat = first.select("service", F.col("_f.ts").alias("_ts"), F.col("_f.incident_id").alias("_id"), F.lit(0).alias("_g"))
    numbered = number_rows(flat, ["_g"], F.col("_ts"), F.col("_id"), out="service_idx")
    return numbered.select("service", "service_idx")


def bandit_context(incidents: DataFrame) -> DataFrame:
    """Incidents ``incident_id, alarm_type, severity, service, ts`` with their feature vector ``x``."""
    ids = service_ids(incidents).withColumnRenamed("service", "_service")
    known = incidents.join(ids, incidents["service"].eqNullSafe(ids["_service"])).drop("_service")
    x = context_vector(
        _position(F.col("alarm_type"), ALARM_TYPES), _position(F.col("severity"), SEVERITIES), F.col("service_idx"), F.col("ts")
    )
    return known.withColumn("x", x)


def apply_feedback(plans: DataFrame) -> DataFrame:
    """One row per chosen action: ``action_id, x, reward``.

    ``plans`` holds ``actions`` and ``helpful`` arrays, ``feedback_score`` and ``x``. Without flags all
    actions count as helpful; unhelpful ones earn half. Arrays are paired up to the shorter one.
    """
    flags = F.coalesce("helpful", F.transform("actions", lambda _: F.lit(True)))
    n = F.least(F.size("actions"), F.size(flags))
    pairs = F.arrays_zip(F.slice("actions", F.lit(1), n).alias("action_id"), F.slice(flags, F.lit(1), n).alias("ok"))
    rows = plans.withColumn("_p", F.explode(pairs))
    reward = F.col("feedback_score") * F.when(F.col("_p.ok"), 1.0).otherwise(UNHELPFUL_FACTOR)
    kept = [c for c in plans.columns if c not in ("actions", "helpful")]
    return rows.select(*kept, F.col("_p.action_id").alias("action_id"), reward.alias("reward"))


def linucb_fit(feedback: DataFrame, actions_table: DataFrame, ridge: float = RIDGE) -> DataFrame:
    """Per action the design matrix ``a`` (36 values, row by row), vector ``b``, count and reward sum.

    ``feedback`` holds ``action_id, x, reward``. Actions without feedback keep the start values.
    """
    sums = [F.sum(F.get("x", F.lit(i)) * F.get("x", F.lit(j))).alias(f"_a{i}{j}") for i in range(DIM) for j in range(i, DIM)]
    sums += [F.sum(F.col("reward") * F.get("x", F.lit(i))).alias(f"_b{i}") for i in range(DIM)]
    totals = feedback.groupBy("action_id").agg(*sums, F.count(F.lit(1)).alias("interactions"), F.sum("reward").alias("total_reward"))
    joined = actions_table.select("action_id").join(totals, "action_id", "left")

    def cell(i: int, j: int) -> Column:
        start = F.lit(ridge if i == j else 0.0)
        return start + F.coalesce(f"_a{min(i, j)}{max(i, j)}", F.lit(0.0))

    return joined.select(
        "action_id",
        F.array(*[cell(i, j) for i in range(DIM) for j in range(DIM)]).alias("a"),
        F.array(*[F.coalesce(f"_b{i}", F.lit(0.0)) for i in range(DIM)]).alias("b"),
        F.coalesce("interactions", F.lit(0)).cast("bigint").alias("interactions"),
        F.coalesce("total_reward", F.lit(0.0)).alias("total_reward"),
    )


#: Actions of a model that is read by the driver: a bound on memory, far above any list of look-ups.
MAX_ACTIONS = 10_000


def score_actions(contexts: DataFrame, model: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Every context with every action: ``incident_id, action_id, estimate, ucb``.

    The model holds one row per action, at most ``MAX_ACTIONS``; it is read by the driver, inverted, and
    used as constants in a vectorised function, so contexts are neither shuffled nor joined.
    """
    rows = model.orderBy("action_id").limit(MAX_ACTIONS + 1).collect()
    if len(rows) > MAX_ACTIONS:
        raise ValueError(f"the model holds more than {MAX_ACTIONS} actions")
    ids = [row["action_id"] for row in rows]
    inverse = np.array([np.linalg.inv(np.array(row["a"]).reshape(DIM, DIM)) for row in rows])
    theta = np.array([inv @ np.array(row["b"]) for inv, row in zip(inverse, rows)])

    @F.pandas_udf("array<struct<action_id: int, estimate: double, ucb: double>>")
    def score(xs: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, dtype=np.float64) for v in xs])
        estimate = x @ theta.T
        spread = np.sqrt(np.einsum("ni,aij,nj->na", x, inverse, x))
        ucb = estimate + alpha * spread
        return pd.Series(
            [[{"action_id": i, "estimate": e, "ucb": u} for i, e, u in zip(ids, es, us)] for es, us in zip(estimate, ucb)]
        )

    kept = [c for c in contexts.columns if c != "x"]
    return contexts.select(*kept, F.inline(score("x")))


def linucb_select(contexts: DataFrame, model: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The best action of each context; ties go to the lowest id."""
    scored = score_actions(contexts, model, alpha)
    return first_rows(scored, ["incident_id"], [F.desc("ucb"), F.asc("action_id")], 1).drop("rank")


def prefetch_plan(contexts: DataFrame, model: DataFrame, budget: int = PLAN_SIZE, alpha: float = ALPHA, compat: bool = False) -> DataFrame:
    """``incident_id, actions``: the best ``budget`` actions, as sorted ids.

    The original picks the same best action ``budget`` times and keeps one; ``compat`` gives that.
    """
    top = first_rows(score_actions(contexts, model, alpha), ["incident_id"], [F.desc("ucb"), F.asc("action_id")], 1 if compat else budget)
    return top.groupBy("incident_id").agg(F.array_sort(F.collect_list("action_id")).alias("actions"))


def policy_action_report(episodes: DataFrame, actions_table: DataFrame) -> DataFrame:
    """Per action: selections, share, mean reward (an episode's reward is split over its actions), cost, latency.

    ``episodes`` holds ``actions`` arrays and ``feedback``. ``best`` and ``worst`` mark the extremes.
    """
    share = F.col("feedback") / F.size("actions")
    used = episodes.select(F.explode("actions").alias("action_id"), share.alias("r")).groupBy("action_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("r").alias("r")
    )
    total = used.agg(F.sum("n").alias("t")).scalar()
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    report = actions_table.join(used, "action_id", "left").select(
        "action_id", "name", "description", n.alias("total_selections"),
        F.coalesce(F.try_divide(n, total), F.lit(0.0)).alias("selection_rate"),
        F.coalesce(F.try_divide(F.col("r"), F.col("n")), F.lit(0.0)).alias("avg_reward"),
        "estimated_cost", "estimated_latency_ms",
    )
    ends = report.agg(
        F.max_by("action_id", F.struct("avg_reward", -F.col("action_id"))).alias("hi"),
        F.min_by("action_id", F.struct(F.when(F.col("total_selections") > 0, F.col("avg_reward")).otherwise(1.0), "action_id")).alias("lo"),
    )
    return report.withColumns(
        {"best": F.col("action_id") == ends.select("hi").scalar(), "worst": F.col("action_id") == ends.select("lo").scalar()}
    )


def policy_summary(episodes: DataFrame) -> DataFrame:
    """One row over all episodes: count, mean, deviation, range and total of the reward, actions per episode."""
    return episodes.agg(
        F.count(F.lit(1)).alias("num_episodes"), F.avg("feedback").alias("avg_reward"), F.stddev_pop("feedback").alias("std_reward"),
        F.min("feedback").alias("min_reward"), F.max("feedback").alias("max_reward"),
        F.sum("feedback").alias("total_reward"), F.avg(F.size("actions")).alias("avg_actions_per_incident"),
    )


def bandit_performance(feedback: DataFrame) -> DataFrame:
    """One row: interactions, total and mean reward (0 without feedback)."""
    return feedback.agg(
        F.count(F.lit(1)).alias("total_interactions"), F.coalesce(F.sum("reward"), F.lit(0.0)).alias("total_reward"),
        F.coalesce(F.avg("reward"), F.lit(0.0)).alias("average_reward"),
    )


def write_policy_report(episodes: DataFrame, actions_table: DataFrame, path: str) -> None:
    """Write the policy summary, the action report and the raw episodes below ``path``."""
    policy_summary(episodes).write.mode("overwrite").json(f"{path}/summary")
    policy_action_report(episodes, actions_table).write.mode("overwrite").json(f"{path}/actions")
    episodes.write.mode("overwrite").parquet(f"{path}/results")
