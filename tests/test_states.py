"""Streams with state: expiry and return, late turns, open sessions, several batches, empty input."""

import datetime as dt

from pyspark.sql import functions as F

from logspark.streaming import jobs, state

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def stream(spark, folder, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
    path = f"{folder}/*"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_records_expire_and_come_back(spark, tmp_path):
    batches = [[(1, at(0)), (1, at(50)), (2, at(10)), (None, at(5)), (3, None)], [(1, at(99)), (1, at(100)), (2, at(300))], [(1, at(150)), (1, at(210)), (2, at(310))], [(9, at(5000))]]
    records = stream(spark, str(tmp_path), batches, "id long, ts timestamp")
    got = state.run_sightings(records, 100, "1 hour").collect()
    shown = sorted(((r["id"], (r["ts"] - T0).total_seconds()) for r in got), key=repr)
    assert shown == sorted([(1, 0.0), (1, 100.0), (1, 210.0), (2, 10.0), (2, 300.0), (9, 5000.0), (None, 5.0)], key=repr)
    assert all(r["ttl"] == int(r["ts"].replace(tzinfo=dt.UTC).timestamp()) + 100 for r in got)


def test_no_records(spark, tmp_path):
    records = stream(spark, str(tmp_path), [[]], "id long, ts timestamp")
    assert state.run_sightings(records, 100).count() == 0


def test_sessions_open_joined_and_closed(spark, tmp_path):
    batches = [
        [(1, at(0)), (1, at(100)), (2, at(0)), (3, None)],  # 1: one session
        [(1, at(700)), (2, at(500))],  # 1: a second one; 2: a second one
        [(1, at(390)), (2, at(250))],  # late: 1 grows; 2 joins both
        [(4, at(100_000))],  # the watermark passes all others
        [(4, at(100_100))],
    ]
    turns = stream(spark, str(tmp_path), batches, "conv_id long, ts timestamp")
    got = state.run_sessions(turns, "300 seconds", "1 hour").collect()
    found = sorted((r["conv_id"], (r["session_start"] - T0).total_seconds(), (r["session_end"] - T0).total_seconds(), r["turns"], r["closed"]) for r in got)
    assert found == [(1, 0.0, 690.0, 3, True), (1, 700.0, 1000.0, 1, True), (2, 0.0, 800.0, 3, True), (4, 100000.0, 100400.0, 2, False)]


def test_batches_do_not_matter(spark, tmp_path):
    rows = [(k % 7, at(k * 97 % 5000)) for k in range(300)]
    several = stream(spark, str(tmp_path / "a"), [rows[k::4] for k in range(4)], "conv_id long, ts timestamp")
    one = stream(spark, str(tmp_path / "b"), [rows], "conv_id long, ts timestamp")
    a, b = (state.run_sessions(s, "60 seconds", "2 hours").drop("closed").orderBy("conv_id", "session_start").collect() for s in (several, one))
    assert a == b
    assert sum(r["turns"] for r in a) == 300


def test_closed_sessions_of_the_append_job_are_among_all(spark, tmp_path):
    rows = [(k % 5, at(k * 211 % 9000)) for k in range(120)]
    a = stream(spark, str(tmp_path / "a"), [rows], "conv_id long, ts timestamp")
    b = stream(spark, str(tmp_path / "b"), [rows], "conv_id long, ts timestamp")
    ended = jobs.run_to_table(jobs.session_stream(a)).select("conv_id", "session_start", "session_end", "turns")
    every = state.run_sessions(b).where(F.col("turns") > 0).select("conv_id", "session_start", "session_end", "turns")
    assert ended.subtract(every).count() == 0 and every.count() > ended.count()
