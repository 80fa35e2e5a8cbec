"""Tables that only grow: the calibration log of detectors, and triage reports kept beside their logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.sources.stores import latest_by_key

CALIBRATIONS = "kind string, ts timestamp, threshold double, stats string"


class CalibrationLog:
    """Calibrations of detectors (``kind, ts, threshold, stats``) as appended files; the newest row of a kind is its active one.

    Every append writes files of its own under a new version name, and the newest snapshot leads to the versions that are not in it, so that an append never
    touches what others read. ``stats`` is any JSON text. Of rows with one time the greater threshold is active. Rows without a kind or time are left out.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, rows: DataFrame) -> None:
        """Add calibrations; ``stats`` may be missing."""
        stats = F.col("stats").cast("string") if "stats" in rows.columns else F.lit(None).cast("string")
        ready = rows.where("kind is not null and ts is not null").select("kind", "ts", F.col("threshold").cast("double").alias("threshold"), stats.alias("stats"))
        ready.withColumn("version", F.lit(f"v{uuid.uuid4().hex}")).write.mode("append").partitionBy("version").parquet(f"{self.path}/log")

    def append_fit(self, kind: str, fitted: DataFrame, ts: Column) -> None:
        """Add the one row of a calibration (``threshold`` and any other columns, which become ``stats``)."""
        others = [c for c in fitted.columns if c != "threshold"]
        stats = F.to_json(F.struct(*others)) if others else F.lit(None).cast("string")
        self.append(fitted.select(F.lit(kind).alias("kind"), ts.alias("ts"), "threshold", stats.alias("stats")))

    def history(self) -> DataFrame:
        """All calibrations ever added."""
        return self.spark.read.schema(CALIBRATIONS + ", version string").parquet(f"{self.path}/log").drop("version")

    def compact(self) -> None:
        """Write a new snapshot: the active row of each kind, and which versions it covers."""
        log = self.spark.read.schema(CALIBRATIONS + ", version string").parquet(f"{self.path}/log")
        covered = [r["version"] for r in log.select("version").distinct().collect()]  # one name an append
        name = F.lit(f"s{uuid.uuid4().hex}")
        own = latest_by_key(log.where(F.col("version").isin(covered)).drop("version"), ["kind"], ["ts", "threshold"])
        own.coalesce(1).withColumns({"snapshot": name, "made": F.current_timestamp()}).write.mode("append").partitionBy("snapshot").parquet(f"{self.path}/snapshots")
        listed = self.spark.createDataFrame([(v,) for v in covered], "version string").withColumn("snapshot", name)
        listed.coalesce(1).write.mode("append").partitionBy("snapshot").parquet(f"{self.path}/covered")  # last: until then the snapshot is not used

    def active(self) -> DataFrame:
        """``kind, ts, threshold, stats``: the newest calibration of each kind, from the last snapshot and what came after it."""
        log = self.spark.read.schema(CALIBRATIONS + ", version string").parquet(f"{self.path}/log")
        snapshot = self._snapshot()
        if snapshot is None:
            return latest_by_key(log.drop("version"), ["kind"], ["ts", "threshold"])
        name, covered = snapshot
        before = self.spark.read.parquet(f"{self.path}/snapshots").where(F.col("snapshot") == name).select("kind", "ts", "threshold", "stats")
        after = log.where(~F.col("version").isin(covered)).drop("version")
        return latest_by_key(before.unionByName(after), ["kind"], ["ts", "threshold"])

    def _snapshot(self) -> tuple[str, list[str]] | None:
        if not _exists(self.spark, f"{self.path}/covered"):
            return None
        done = self.spark.read.parquet(f"{self.path}/covered")
        made = self.spark.read.parquet(f"{self.path}/snapshots").select("snapshot", "made").distinct().join(done.select("snapshot").distinct(), "snapshot")
        newest = made.orderBy(F.desc("made"), "snapshot").first()
        if newest is None:
            return None
        return newest["snapshot"], [r["version"] for r in done.where(F.col("snapshot") == newest["snapshot"]).collect()]


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


class ReportTables:
    """Logs (``log_id`` and further columns) and triage reports (``report_id, log_id, severity, root_cause, confidence, model_used, ts``), both in buckets of ``log_id``.

    A report and its log lie in buckets of the same number, so the join reads bucket by bucket and shuffles nothing. Files inside a bucket are sorted by
    ``log_id``, which lets their statistics rule most of them out for a look-up of few logs.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int = 64):
        self.spark, self.path, self.name, self.buckets = spark, path.rstrip("/"), name, buckets

    def _write(self, rows: DataFrame, kind: str) -> None:
        spread = rows.repartition(self.buckets, "log_id")  # one task a bucket, so that an append adds one file to each
        writer = spread.write.mode("append").format("parquet").bucketBy(self.buckets, "log_id").sortBy("log_id")
        writer.option("path", f"{self.path}/{kind}").saveAsTable(f"{self.name}_{kind}")

    def append_logs(self, logs: DataFrame) -> None:
        self._write(logs, "logs")

    def append_reports(self, reports: DataFrame) -> None:
        columns = ("report_id", "log_id", "severity", "root_cause", "confidence", "model_used", "ts")
        self._write(reports.select(*columns), "triage_reports")

    def logs(self) -> DataFrame:
        return self.spark.table(f"{self.name}_logs")

    def reports(self) -> DataFrame:
        return self.spark.table(f"{self.name}_triage_reports")

    def joined(self) -> DataFrame:
        """Reports with the columns of their log; a column of both is the report's, the log's is named ``log_...``."""
        return join_reports(self.reports(), self.logs())


def join_reports(reports: DataFrame, logs: DataFrame) -> DataFrame:
    """Every report beside its log (on ``log_id``); reports without a log are left out. Bucketed inputs meet without an exchange."""
    both = set(reports.columns) & set(logs.columns) - {"log_id"}
    renamed = logs.select(*(F.col(c).alias(f"log_{c}") if c in both else F.col(c) for c in logs.columns))
    return reports.hint("merge").join(renamed, "log_id")
