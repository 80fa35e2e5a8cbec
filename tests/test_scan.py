"""The scan of many runs: what several runs ask for and windows with copies are handled once."""

from datetime import datetime, timedelta
from math import ceil

import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.functions.vectors import hash_vector, line_template
from logspark.operators import similarity
from logspark.plans import scan


def window_scores(vectors, size, k):
    """Mean cosine distance of each window's mean vector to its ``k`` nearest other windows, one by one."""
    means = [np.mean(vectors[i : i + size], axis=0) for i in range(len(vectors) - size + 1)]
    unit = [m / (np.linalg.norm(m) or 1.0) for m in means]
    for i, u in enumerate(unit):
        near = sorted(((u - v) ** 2).sum() / 2 for j, v in enumerate(unit) if j != i)[:k]
        yield i, float(np.mean(near)) if near else 0.0


@pytest.mark.parametrize("k", [1, 5])
def test_equal_windows_are_scored_once(spark, monkeypatch, k):
    rng = np.random.default_rng(3)
    words = ["disk slow", "disk full again", "user login", "cache hit", "12 34"]
    logs = {1: [words[w] for w in rng.choice(5, 300, p=[0.9, 0.04, 0.03, 0.02, 0.01])], 2: [words[0]] * 80, 3: words[:4], 4: words[:2], None: words}
    rows = [(s, i, line) for s, lines in logs.items() for i, line in enumerate(lines)]
    lines = spark.createDataFrame(rows, "source_id long, line_no long, line string").withColumn("wording", line_template(F.col("line")))
    searched = []
    original = similarity.density_scores

    def counted(df, *rest):
        searched.append(df.where("source_id = 1").count())
        return original(df, *rest)

    monkeypatch.setattr(similarity, "density_scores", counted)
    vectors = {r["line"]: r["v"] for r in lines.select("line", hash_vector(F.col("wording"), 16).alias("v")).distinct().collect()}
    encoded = lines.withColumn("embedding", hash_vector(F.col("wording"), 16))
    found = [similarity.density_windows(encoded, 4, 1, k), similarity.density_windows(lines, 4, 1, k, "wording", encode=lambda w: hash_vector(w, 16))]
    bags = {tuple(sorted(logs[1][i : i + 4])) for i in range(297)}
    assert max(searched) <= (k + 1) * len(bags) < 297
    for got in found:
        by = {(r["source_id"], r["start"]): r["score"] for r in got.collect()}
        assert len(by) == 297 + 77 + 1
        for source in (1, 2, 3):
            for start, score in window_scores([np.array(vectors[line]) for line in logs[source]], 4, k):
                assert np.isclose(by[source, start], score, atol=1e-9)


def test_runs_that_ask_alike_share_their_sources(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["INFO cache hit", "ERROR disk full", "WARN disk slow", "FATAL worker killed, out of memory"]
    at = datetime(2024, 1, 2, 9)
    logs = [("/app/error", at + timedelta(seconds=i // 2), i, texts[w]) for i, w in enumerate(rng.choice(4, 120, p=[0.9, 0.05, 0.03, 0.02]))]
    end = at + timedelta(minutes=10)
    # Three runs over the same times with two budgets, one with room for everything, one that ends before.
    runs = [(1, end, 900 + 256 + 50, "{}"), (2, end, 1300 + 256 + 50, "{}"), (3, end, 900 + 256 + 50, "{}"), (4, end, 100_000, "{}"), (5, at + timedelta(seconds=29), 900 + 256 + 50, "{}")]
    scored, original = [], scan.density_windows

    def counted(df, *rest):
        scored.append(df.count())
        return original(df, *rest)

    monkeypatch.setattr(scan, "density_windows", counted)
    monkeypatch.setattr(scan, "CUT_RUNS", 1, raising=False)
    events = spark.createDataFrame(runs, "run_id long, ts timestamp, context_window long, event string")
    patterns = spark.createDataFrame([("/app/error",)], "pattern string")
    table = spark.createDataFrame(logs, "log_group string, ts timestamp, seq long, message string")
    got = scan.scan_events(events, patterns, table, F.col("context_window"), F.lit(256), F.lit(50), 60, dim=16)
    by = {}
    for r in got.sections.collect():
        by.setdefault(r["run_id"], []).append((r["line_no"], r["line"], r["block"]))
    assert scored == [120 + 60]
    whole = [f"{ts:%Y-%m-%dT%H:%M:%S}+00:00 {text}" for _, ts, _, text in logs]
    context = len("Trigger type: schedule\nThis is a scheduled scan, not triggered by a specific alarm.") // 4
    vector = {r["line"]: np.array(r["v"]) for r in spark.createDataFrame([(x,) for x in whole], "line string").select("line", hash_vector(line_template(F.col("line")), 16).alias("v")).collect()}
    for run, _, window, _ in runs:
        lines = whole[:60] if run == 5 else whole
        wanted = set(range(len(lines)))
        if run != 4:
            tokens, available = (sum(map(len, lines)) + len(lines) - 1) // 4, window - 256 - 50 - 500 - context
            scores = sorted((-round(score, 9), start) for start, score in window_scores([vector[x] for x in lines], 4, 5))
            best = scores[: ceil(available / tokens * len(scores))]
            wanted = {start + i for _, start in best for i in range(4)}
            assert len(wanted) < len(lines)
        assert sorted((n, line) for n, line, _ in by[run]) == sorted((n, lines[n]) for n in wanted), run
        assert all((block is None) == (run == 4) for _, _, block in by[run])
    assert by[1] and sorted(by[1]) == sorted(by[3])
    assert {r["run_id"] for r in got.analyses.collect()} == {1, 2, 3, 4, 5}
