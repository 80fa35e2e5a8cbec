"""Growing tables: the calibration log and its choice of detector, and reports joined to logs without a shuffle."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from logspark.operators import anomaly
from logspark.sources.registry import CalibrationLog, ReportTables, join_reports

DAY = dt.datetime(2024, 5, 1)


def rows(spark, found):
    return spark.createDataFrame([(k, DAY + dt.timedelta(hours=h) if h is not None else None, t) for k, h, t in found], "kind string, ts timestamp, threshold double")


def test_calibrations_across_snapshots(spark, tmp_path):
    log = CalibrationLog(spark, str(tmp_path / "log"))
    log.append(rows(spark, [("a", 1, 0.1), ("a", 3, 0.3), ("b", 2, 0.2), (None, 9, 1.0), ("c", None, 1.0)]))
    active = lambda: {r["kind"]: r["threshold"] for r in log.active().collect()}
    assert active() == {"a": 0.3, "b": 0.2}
    log.compact()
    assert active() == {"a": 0.3, "b": 0.2}
    log.append(rows(spark, [("a", 2, 0.9), ("b", 5, 0.5), ("c", 0, 0.7)]))  # older for a, newer for b
    assert active() == {"a": 0.3, "b": 0.5, "c": 0.7}
    log.compact()
    log.append(rows(spark, [("c", 0, 0.8)]))  # one time: the greater threshold
    assert active() == {"a": 0.3, "b": 0.5, "c": 0.8} and log.history().count() == 7
    log.append_fit("d", spark.createDataFrame([(0.4, 12)], "threshold double, samples long"), F.lit(DAY))
    stats = {r["kind"]: r["stats"] for r in log.active().collect()}
    assert stats["d"] == '{"samples":12}' and stats["a"] is None
    # a snapshot whose list of versions was not written is not used
    spark.createDataFrame([("z", DAY, 9.0, None, "sbroken", dt.datetime(2999, 1, 1))], "kind string, ts timestamp, threshold double, stats string, snapshot string, made timestamp").write.mode("append").partitionBy("snapshot").parquet(f"{log.path}/snapshots")
    assert set(active()) == {"a", "b", "c", "d"}


def test_registry_chooses_each_kind(spark, tmp_path):
    lines = spark.createDataFrame([("s", k, "x" * k) for k in range(1, 9)], "source_id string, line_no long, line string")
    scorers = {kind: (lambda df, by=by: df.withColumn("score", F.length("line") / by)) for kind, by in (("sequence", 8.0), ("reconstruction", 4.0))}
    log = CalibrationLog(spark, str(tmp_path / "log"))
    log.append(rows(spark, [("other", 1, 0.1)]))

    def detected():
        got = anomaly.detect_cascade(lines, log.active(), scorers).collect()
        return {r["method"] for r in got}, {r["threshold"] for r in got}, {r["line_no"] for r in got if r["is_anomaly"]}

    assert detected()[0] == {"zscore"}
    log.append(rows(spark, [("reconstruction", 1, 0.5), ("reconstruction", 2, 1.0)]))
    assert detected() == ({"reconstruction"}, {1.0}, {5, 6, 7, 8})
    log.append(rows(spark, [("sequence", 1, 0.2)]))
    assert detected() == ({"sequence"}, {anomaly.SEQUENCE_LIMIT}, {k for k in range(1, 9) if k / 8 > anomaly.SEQUENCE_LIMIT})
    assert anomaly.detect_cascade(lines, log.active(), {"reconstruction": scorers["reconstruction"]}).first()["method"] == "reconstruction"
    assert anomaly.detect_cascade(lines, log.active()).first()["method"] == "zscore"


def test_reports_meet_logs_without_exchange(spark, tmp_path):
    store = ReportTables(spark, str(tmp_path / "t"), f"t_{uuid.uuid4().hex}", 4)
    logs = spark.range(100).select(F.col("id").alias("log_id"), F.concat(F.lit("line "), "id").alias("line"), F.lit("INFO").alias("severity"))
    store.append_logs(logs.where("log_id < 60"))
    store.append_logs(logs.where("log_id >= 60"))
    report = lambda ids, severity: spark.createDataFrame([((i or 0) * 7, i, severity, None, 0.5, "m", DAY) for i in ids], "report_id long, log_id long, severity string, root_cause string, confidence double, model_used string, ts timestamp")
    store.append_reports(report([3, 3, 61, 500], "HIGH"))
    store.append_reports(report([99, None], "CRITICAL"))
    joined = store.joined()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    got = sorted((r["log_id"], r["severity"], r["log_severity"], r["line"]) for r in joined.collect())
    assert got == [(3, "HIGH", "INFO", "line 3")] * 2 + [(61, "HIGH", "INFO", "line 61"), (99, "CRITICAL", "INFO", "line 99")]
    assert join_reports(store.reports().limit(0), store.logs()).count() == 0


def test_dataset_rows_are_made_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from logspark.sources import stores

    made = spark.sparkContext.accumulator(0)

    def label(x):
        made.add(1)
        return "HIGH" if x % 3 else "INFO"

    rows = spark.range(30).select(F.concat(F.lit("text "), "id").alias("text"), F.udf(label, "string")("id").alias("label"))
    stores.write_dataset(rows, str(tmp_path / "set"))
    counts = {r["label"]: r["count"] for r in spark.read.json(f"{tmp_path}/set/label_distribution").collect()}
    assert counts == {"INFO": 10, "WARNING": 0, "HIGH": 20, "CRITICAL": 0} and made.value == 30
