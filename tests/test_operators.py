"""Operators against golden cases and brute force, with hot groups, ties and empty input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.operators import anomaly, bandit, budget, explain, feedback, forecast, lookups, ordering, similarity, training, windows
from logspark.sources.lines import read_log_files, resolve_log_groups

LINES = "source_id string, line_no bigint, line string"


def lines(spark, source, texts):
    return spark.createDataFrame([(source, i, x) for i, x in enumerate(texts)], LINES)


@pytest.mark.parametrize("partitions", [1, 7])
def test_numbers_with_a_hot_group_and_ties(spark, partitions):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"g{i % 9}", 5 if rng.random() < 0.5 else rng.randrange(100), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, t int, i int").repartition(partitions)
    got = ordering.number_rows(df, ["g"], F.col("t"), F.col("i"), out="n", value="t", running="before", parts=16).collect()
    assert len(got) == len(rows)
    for group in {r[0] for r in rows}:
        want = sorted((t, i) for g, t, i in rows if g == group)
        mine = sorted((r.n, r.t, r.i, r.before) for r in got if r.g == group)
        assert [(t, i) for _, t, i, _ in mine] == want
        assert [n for n, *_ in mine] == list(range(len(want)))
        assert [b for *_, b in mine] == [sum(t for t, _ in want[:k]) for k in range(len(want))]


def test_rows_without_a_group_key_are_kept(spark):
    df = spark.createDataFrame([(None, 2), ("a", 1), (None, 1)], "g string, i int")
    got = ordering.number_rows(df, ["g"], F.col("i"), F.col("i"), out="n").collect()
    assert sorted((r.g or "", r.i, r.n) for r in got) == [("", 1, 0), ("", 2, 1), ("a", 1, 0)]


def test_top_share_with_equal_scores(spark):
    df = spark.createDataFrame([("a", i, 1.0 if i % 3 else 2.0) for i in range(300)], "source_id string, start int, score double")
    got = ordering.top_share(df, ["source_id"], F.lit(0.5), "score", "start").collect()
    want = sorted(((-(1.0 if i % 3 else 2.0)), i) for i in range(300))[:150]
    assert sorted((-r.score, r.start) for r in got) == want


def fold(tokens, available):
    if sum(tokens) <= available:
        return {i: None for i in range(len(tokens))}
    out, left, count = {}, available, len(tokens)
    for i in sorted(range(len(tokens)), key=lambda i: (tokens[i], i)):
        fair = left // count
        if tokens[i] <= fair:
            out[i] = None
            left -= tokens[i]
        else:
            out[i] = min(max(fair / tokens[i], 0.01), 1.0)
            left -= fair
        count -= 1
    return out


def test_budget_equals_the_step_by_step_rule(spark):
    rng = random.Random(3)
    runs = {"a": ([2000], 1000), "b": ([100, 800], 500), "c": ([1000, 1000], 500), "d": ([9999], 10), "e": ([100, 800, 333, 50, 334], 500), "f": ([5, 5], 100)}
    for k in range(60):
        runs[f"r{k:02}"] = ([rng.randrange(1, 60) for _ in range(rng.randrange(1, 12))], rng.randrange(1, 300))
    sources = spark.createDataFrame([(r, f"{i:03}", t) for r, (ts, _) in runs.items() for i, t in enumerate(ts)], "run_id string, log_group string, tokens bigint")
    budgets = spark.createDataFrame([(r, b) for r, (_, b) in runs.items()], "run_id string, available bigint")
    for row in budget.token_budget_plan(sources, budgets).collect():
        want = fold(*runs[row.run_id])[int(row.log_group)]
        assert row.needs_reduction == (want is not None), row
        assert want is None or row.share == pytest.approx(want)


def test_signals_over_line_ends(spark):
    df = lines(spark, "a", ["x out", "of", "memory y", "disk", "full", "out", "of memory"]).union(lines(spark, "b", ["out", "of ", "memory", "disk  full"]))
    got = {r.source_id: r.signals for r in explain.extract_signals(df).collect()}
    assert got == {"a": ["Out of memory", "Storage exhausted"], "b": []}


def test_explain_goldens(spark):
    df = lines(spark, "a", ["ERROR OOM error"] * 10 + ["INFO connection refused rarely"] * 2)
    row = explain.explain(df).first()
    assert row.signals == ["Out of memory", "Network failure"]
    assert row.patterns[0] == "Error burst: 10/12 lines are errors"
    assert row.patterns[1] == "Log spam: 'ERROR OOM error' repeated 10x"
    assert row.token_scores["rarely"] > row.token_scores["error"]
    assert explain.explain(lines(spark, "a", ["x"]).limit(0)).collect() == []


def test_equal_lines_are_not_anomalous(spark):
    got = anomaly.detect_lines(lines(spark, "a", ["same words"] * 50)).collect()
    assert len(got) == 50 and not any(r.is_anomaly for r in got)


def test_windows_count_and_tail(spark):
    df = lines(spark, "a", ["x"] * 21).withColumn("score", F.col("line_no") * 1.0)
    found = windows.sliding_windows(df, 16, 4, [F.max("score").alias("score")])
    assert sorted(r.start for r in found.collect()) == [0, 4]
    got = {r.line_no: r.score for r in windows.max_overlap_score(df.drop("score"), found, 16).collect()}
    assert got[0] == 15.0 and got[4] == 19.0 and got[20] == 0.0


@pytest.mark.parametrize("chunk", [3, 1 << 20])
def test_merge_blocks_across_chunks(spark, chunk):
    kept = spark.createDataFrame([("a", s, s / 10) for s in (0, 2, 6, 11, 30, 34)], "source_id string, start bigint, score double")
    got = sorted((r.line_start, r.line_end, r.score) for r in windows.merge_blocks(kept, 4, chunk=chunk).collect())
    assert got == [(0, 9, 0.6), (11, 14, 1.1), (30, 37, 3.4)]


@pytest.mark.parametrize("block", [16, 4096])
def test_knn_equals_brute_force_with_copies(spark, block):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(90, 6)).round(2)
    vectors = np.vstack([base, np.repeat(base[:1], 40, axis=0), np.repeat(base[1:2], 2, axis=0)])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id bigint, vector array<double>")
    got = {}
    for r in similarity.knn_join(df, 5, block=block).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour, r.dist))
    dist = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(-1))
    for i in range(len(vectors)):
        order = sorted((round(dist[i, j], 6), j) for j in range(len(vectors)) if j != i)[:5]
        mine = sorted(got[i])
        assert [n for _, n, _ in mine] == [j for _, j in order]
        assert [d for *_, d in mine] == pytest.approx([d for d, _ in order], abs=1e-5)


def test_pairs_and_trends(spark):
    df = spark.createDataFrame([(1, "good", 9, True, 5), (2, "bad", 2, False, 5), (3, "mid", 5, True, 5)], "feedback_id int, suggestion string, suggestion_quality int, was_helpful boolean, overall_satisfaction int")
    assert [tuple(r) for r in feedback.preference_pairs(df).collect()] == [("good", "bad", 9, 1)]
    assert feedback.preference_pairs(df.limit(0)).collect() == []


def test_bandit_matches_direct_solution(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), [float(v) for v in x], float(r)) for a, x, r in zip(rng.integers(0, 7, 200), rng.random((200, 6)), rng.random(200))]
    model = bandit.linucb_fit(spark.createDataFrame(rows, "action_id int, x array<double>, reward double"), bandit.actions(spark))
    contexts = spark.createDataFrame([(i, [float(v) for v in rng.random(6)]) for i in range(5)], "incident_id int, x array<double>")
    got = {r.incident_id: r.action_id for r in bandit.linucb_select(contexts, model).collect()}
    for row in contexts.collect():
        best = []
        for a in range(8):
            xs = np.array([x for k, x, _ in rows if k == a]).reshape(-1, 6)
            inv = np.linalg.inv(np.eye(6) + xs.T @ xs)
            theta = inv @ (xs.T @ np.array([r for k, _, r in rows if k == a]))
            x = np.array(row.x)
            best.append(theta @ x + 0.1 * np.sqrt(x @ inv @ x))
        assert got[row.incident_id] == int(np.argmax(best))
    plans = bandit.prefetch_plan(contexts, model).collect()
    assert all(len(p.actions) == 3 and p.actions == sorted(set(p.actions)) for p in plans)


def test_forecast_follows_a_line_and_reports_failures(spark):
    start = 1_700_000_000
    rows = [("up", start + 60 * i, 100.0 + i) for i in range(600)] + [("one", start, 1.0)]
    df = spark.createDataFrame(rows, "series_id string, s bigint, y double").select("series_id", F.timestamp_seconds("s").alias("ds"), "y")
    got = forecast.fit_forecast(df, 60, 10, weekly=False).orderBy("ds").collect()
    up = [r for r in got if r.series_id == "up"]
    assert len(up) == 6 and all(r.status == "ok" for r in up) and up[-1].yhat > 700
    assert [r.status for r in got if r.series_id == "one"] == ["failed"]
    summary = {r.series_id: r.trend for r in forecast.forecast(df, 10).collect()}
    assert summary == {"up": "rising", "one": "unknown"}


def test_early_stopping(spark):
    losses = [5, 4, 4, 4, 3, 3, 3, 3, 3, 3, 1]
    df = spark.createDataFrame([("r", i, float(x)) for i, x in enumerate(losses)], "run_id string, epoch int, val_loss double")
    row = training.early_stopping(df).first()
    assert (row.best_epoch, row.best_loss, row.stop_epoch) == (4, 3.0, 9)


def test_log_look_up_limit(spark):
    events = spark.sql("SELECT id AS event_id, 'g' AS log_group, timestamp_seconds(id * 10) AS ts, concat('ERROR ', id) AS message FROM range(500)")
    specs = spark.sql("SELECT 1 AS incident_id, 'k' AS query_key, 'g' AS log_group, 'ERROR' AS filter_pattern, 60L AS lookback_minutes, timestamp_seconds(4000) AS end_ts")
    row = lookups.run_log_specs(specs, events).first()
    assert row.event_count == 50 and row.sample_lines[0].endswith("ERROR 40") and row.sample_lines[-1].endswith("ERROR 89")


def test_log_groups(spark):
    names = spark.createDataFrame([("/aws/a/x",), ("/aws/a/y",), ("/aws/b",)], "log_group string")
    def resolve(*patterns):
        return [r.log_group for r in resolve_log_groups(names, spark.createDataFrame([(p,) for p in patterns], "pattern string")).collect()]
    assert resolve("/aws/a/*") == ["/aws/a/x", "/aws/a/y"]
    assert resolve("/other", "/aws/a/x", "/aws/a*") == ["/aws/a/x", "/aws/a/y", "/other"]
    assert resolve("/none*") == []


def test_files_are_numbered_over_their_splits(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(f"line {i}" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = read_log_files(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.line_no: r.line for r in got} == {i: f"line {i}" for i in range(5000)}


def test_neighbours_break_ties_by_id(spark):
    from logspark.operators.similarity import knn_join

    rows = [(0, [0.0] * 64)] + [(k, [1.0 if d == k - 1 else 0.0 for d in range(64)]) for k in range(64, 0, -1)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = knn_join(df, 3).where("id = 0").orderBy("rank").collect()
    assert [r["neighbour"] for r in got] == [1, 2, 3]


def test_density_of_computed_vectors(spark):
    from logspark.operators.similarity import density_scores

    computed = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda d: F.sin(F.col("id") * d) / 3 + F.lit(0.1))
    df = spark.range(40).select((F.col("id") % 3).alias("source_id"), "id", computed.alias("vector"))
    df = df.unionByName(spark.createDataFrame([(9, 1, [1.0] * 8)], "source_id long, id long, vector array<double>"))
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        lazy = {tuple(r) for r in density_scores(df, 3).select("source_id", "id", F.round("score", 9)).collect()}
        stored = {tuple(r) for r in density_scores(df.cache(), 3).select("source_id", "id", F.round("score", 9)).collect()}
        assert lazy == stored and len(lazy) == 41 and (9, 1, 0.0) in lazy
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_metric_specs_without_dimensions(spark):
    from logspark.operators.lookups import run_metric_specs

    kind = "map<string,string>"
    metrics = spark.sql(
        f"SELECT 'n' AS namespace, 'm' AS metric_name, CAST(map() AS {kind}) AS dimensions, timestamp'2024-01-01 10:30:00' AS ts, 1.0D AS value "
        f"UNION ALL SELECT 'n', 'm', CAST(NULL AS {kind}), timestamp'2024-01-01 10:31:00', 2.0D "
        "UNION ALL SELECT 'n', 'm', map('a', 'b'), timestamp'2024-01-01 10:32:00', 4.0D UNION ALL SELECT 'n', 'm', map('a', 'b'), timestamp'2020-01-01 10:32:00', 9.0D"
    )
    specs = spark.sql(
        "SELECT 1 AS incident_id, k AS query_key, 'n' AS namespace, 'm' AS metric_name, d AS dimensions, 'Sum' AS stat, 60L AS period_minutes, "
        f"timestamp'2024-01-01 11:00:00' AS end_ts FROM VALUES ('none', CAST(NULL AS {kind})), ('empty', CAST(map() AS {kind})), ('one', map('a', 'b')) AS v(k, d)"
    )
    sums = run_metric_specs(specs, metrics).groupBy("query_key").agg(F.sum("value").alias("v")).collect()
    assert {r["query_key"]: r["v"] for r in sums} == {"none": 7.0, "empty": 7.0, "one": 4.0}


def test_context_keeps_incidents_without_service(spark):
    from logspark.operators.bandit import bandit_context

    df = spark.createDataFrame([(1, "CPU", "HIGH", None), (2, "CPU", "HIGH", "s")], "incident_id long, alarm_type string, severity string, service string")
    assert bandit_context(df.withColumn("ts", F.timestamp_seconds(F.lit(0)))).count() == 2


def test_other_scripts_are_seen(spark):
    from logspark.functions.vectors import line_template

    df = spark.createDataFrame([("запрос отклонён", "x" * 1024 + " later")], "a string, b string")
    row = df.select(line_template(F.col("a")), line_template(F.col("b")), line_template(F.col("b"), None)).first()
    assert row[0] == "запрос отклонён" and "later" not in row[1] and row[2].endswith(" later")


def test_cluster_needs_a_shared_folder(spark):
    import pytest

    from logspark.session import shared_dir

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_streams_without_input(spark, tmp_path):
    from logspark.streaming import jobs

    path = str(tmp_path / "in")
    spark.sql("SELECT 1L AS incident_id, 'open' AS prefetch_status, '[]' AS cached_data, timestamp'2024-01-01' AS ts").limit(0).write.parquet(path)
    schema = "incident_id long, prefetch_status string, cached_data string, ts timestamp"
    assert jobs.run_upsert(jobs.read_stream(spark, path, schema, name="none*")).count() == 0
    feedback = jobs.read_stream(spark, path, "action_id int, x array<double>, reward double", name="none*")
    assert jobs.run_bandit(feedback).count() == 0


def test_twelve_actions(spark):
    from logspark.operators.bandit import DIM, score_actions

    eye = [1.0 if i == j else 0.0 for i in range(DIM) for j in range(DIM)]
    model = spark.createDataFrame([(k, eye, [float(k)] * DIM) for k in range(12)], "action_id int, a array<double>, b array<double>")
    contexts = spark.createDataFrame([(1, [0.5] * DIM)], "incident_id long, x array<double>")
    scores = {r["action_id"]: r["estimate"] for r in score_actions(contexts, model).collect()}
    assert len(scores) == 12 and scores[11] == pytest.approx(11 * 0.5 * DIM)


def test_equal_look_ups_are_run_once(spark, monkeypatch):
    stored = {}

    def keep(df, name, real=lookups.save_and_read):
        out = real(df, name)
        stored.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(lookups, "save_and_read", keep)
    specs = spark.range(500).selectExpr(
        "id AS incident_id", "'k' AS query_key", "'App' AS namespace", "'Latency' AS metric_name", "map('user', CAST(id % 2 AS STRING)) AS dimensions", "'Sum' AS stat",
        "60L AS period_minutes", "60L AS lookback_minutes", "'/app' AS log_group", "'ERROR' AS filter_pattern", "TIMESTAMP '2024-01-01 01:00:00' AS end_ts",
    )
    rows = spark.range(60).selectExpr("id AS event_id", "'App' AS namespace", "'Latency' AS metric_name", "map('user', '0', 'zone', 'a') AS dimensions",
        "TIMESTAMP '2024-01-01 00:00:30' + id * INTERVAL '1' MINUTE AS ts", "1.0D AS value", "'/app' AS log_group", "concat('ERROR ', id) AS message")
    points = lookups.run_metric_specs(specs, rows).groupBy("incident_id").agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n")).collect()
    assert {r["incident_id"] for r in points} == set(range(0, 500, 2)) and {(r["v"], r["n"]) for r in points} == {(60.0, 10)}
    assert stored["lookups"] == [2]
    logs = lookups.run_log_specs(specs, rows).collect()
    assert len(logs) == 500 and {(r["event_count"], r["sample_lines"][0]) for r in logs} == {(50, "2024-01-01T00:00:30 ERROR 0")}
    assert stored["lookups"] == [2, 1]
