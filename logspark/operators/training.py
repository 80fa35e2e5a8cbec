"""Training sets and training measurements: pairs, splits, metrics, early stopping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.reports import concat_record_logs, infer_severity
from logspark.operators.ordering import first_rows, number_rows

# Negatives per anchor, shortest training text, patience, training share.
NEGATIVES = 3
MIN_TEXT = 10
PATIENCE = 5
TRAIN_SHARE = 0.8


def contrastive_pairs(logs: DataFrame, hard: DataFrame | None = None, n: int = NEGATIVES) -> DataFrame:
    """``id, anchor, positive, negatives``: each log with itself and the first ``n`` logs of other incidents.

    ``logs`` holds ``id, incident_id, text`` in the order of ``id``; ``hard`` holds ``id, pos, hard_id``,
    given negatives that go first. Anchors without negatives are dropped. The first logs of other
    incidents lie among the first ``2n`` rows of the table that keeps ``n`` rows per incident, so one
    short list serves every anchor.
    """
    heads = first_rows(logs, ["incident_id"], [F.asc("id")], n).drop("rank")
    short = heads.orderBy("id").limit(2 * n)
    pool = short.agg(F.array_sort(F.collect_list(F.struct("id", "incident_id", "text")))).scalar()
    anchors = logs.withColumn("_pool", pool)
    others = F.filter("_pool", lambda x: x["incident_id"] != F.col("incident_id"))
    found = F.transform(others, lambda x: x["text"])
    if hard is not None:
        named = hard.join(logs.select(F.col("id").alias("hard_id"), F.col("text").alias("_t")), "hard_id")
        few = first_rows(named, ["id"], [F.asc("pos")], n, "_r")
        given = few.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "_t"))).alias("_h"))
        anchors = anchors.join(given, "id", "left")
        found = F.concat(F.coalesce(F.col("_h._t"), F.array().cast("array<string>")), found)
    return (
        anchors.select("id", F.col("text").alias("anchor"), F.col("text").alias("positive"), F.slice(found, 1, n).alias("negatives"))
        .filter(F.size("negatives") > 0)
    )


def train_val_split(rows: DataFrame, order: str, share: float = TRAIN_SHARE, tie: str | None = None) -> DataFrame:
    """Add ``split``: ``train`` for the first ``int(share * n)`` rows in ``order``, else ``val``."""
    numbered = number_rows(rows.withColumn("_g", F.lit(0)), ["_g"], F.col(order), F.col(tie or order), out="_at")
    limit = rows.agg(F.floor(F.count(F.lit(1)) * share)).scalar()
    return numbered.withColumn("split", F.when(F.col("_at") < limit, "train").otherwise("val")).drop("_g", "_at")


def random_split(rows: DataFrame, keys: Sequence[str], share: float = TRAIN_SHARE, seed: int = 42) -> DataFrame:
    """Add ``split`` by a hash of the keys: the same row always falls on the same side."""
    part = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(10_000)) / 10_000
    return rows.withColumn("split", F.when(part < share, "train").otherwise("val"))


def usable_training_text(rows: DataFrame, text: str = "text", least: int = MIN_TEXT) -> DataFrame:
    return rows.filter(F.col(text).isNotNull() & (F.char_length(text) >= least))


def training_rows(records: DataFrame) -> DataFrame:
    """``record_id, text, label`` from triage records with ``anomalous_logs`` (array of JSON entries) and flags."""
    kept = records.filter(F.size("anomalous_logs") > 0)
    rows = kept.select(
        "record_id",
        concat_record_logs(F.col("anomalous_logs")).alias("text"),
        infer_severity(F.col("is_critical"), F.col("needs_escalation"), F.col("confidence")).alias("label"),
    )
    return usable_training_text(rows)


def classification_metrics(rows: DataFrame, score: str = "score", label: str = "label", limit: float = 0.5) -> DataFrame:
    """Accuracy, sensitivity and specificity at a limit; 0 for an absent class."""
    hit = ((F.col(score) >= limit).cast("int") == F.col(label)).cast("double")
    return rows.agg(
        F.avg(hit).alias("accuracy"),
        F.coalesce(F.avg(F.when(F.col(label) == 1, hit)), F.lit(0.0)).alias("sensitivity"),
        F.coalesce(F.avg(F.when(F.col(label) == 0, hit)), F.lit(0.0)).alias("specificity"),
    )


def class_accuracy(rows: DataFrame, predicted: Column, label: Column) -> DataFrame:
    """``label, rows, accuracy`` per class that occurs."""
    return rows.groupBy(label.alias("label")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg((predicted == label).cast("double")).alias("accuracy")
    )


def prediction_correlation(rows: DataFrame, predicted: str = "prediction", target: str = "target") -> DataFrame:
    return rows.agg(F.corr(predicted, target).alias("correlation"))


def operation_durations(runs: DataFrame) -> DataFrame:
    """Mean, lowest and highest duration per operation; missing and zero durations do not count."""
    timed = F.nullif(F.col("duration_ms").cast("double"), F.lit(0.0))
    return runs.groupBy("operation").agg(
        F.count(timed).alias("runs"), F.avg(timed).alias("mean_ms"), F.min(timed).alias("min_ms"), F.max(timed).alias("max_ms")
    )


def early_stopping(history: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """``run_id, best_epoch, best_loss, stop_epoch`` from ``run_id, epoch, val_loss``.

    A run stops at the first epoch with ``patience`` epochs in a row that did not improve the best loss;
    the best epoch is the last improvement up to there. ``stop_epoch`` is null if it never stops.
    """
    run = ["run_id"]
    numbered = number_rows(
        history, run, F.col("epoch"), F.col("epoch"), out="_pos", value="val_loss", running="_best", how="min"
    )
    improved = F.col("_best").isNull() | (F.col("val_loss") < F.col("_best"))
    marked = numbered.withColumn("_up", F.when(improved, F.col("_pos")))
    last = number_rows(marked.drop("_pos"), run, F.col("epoch"), F.col("epoch"), out="_pos", value="_up", running="_last", how="max")
    waited = F.col("_pos") - F.coalesce("_up", "_last")
    stops = last.groupBy("run_id").agg(F.min(F.when(waited >= patience, F.struct("_pos", "epoch"))).alias("_stop"))
    until = last.join(stops, "run_id").filter(F.col("_stop").isNull() | (F.col("_pos") <= F.col("_stop._pos")))
    return until.groupBy("run_id").agg(
        F.max_by("epoch", "_up").alias("best_epoch"), F.min("val_loss").alias("best_loss"), F.first("_stop.epoch").alias("stop_epoch")
    )
