"""Fitted models: line vectors, reconstruction error, window classifier, severity and reward text models."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, PCA, HashingTF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.rules import SEVERITIES, keyword_severity
from logspark.functions.vectors import ENCODED_CHARS, hash_vector, l2_normalize, line_template
from logspark.operators.anomaly import WINDOW_SIZE, WINDOW_STRIDE, calibrate_percentile
from logspark.operators.feedback import reward_target
from logspark.operators.training import random_split
from logspark.operators.windows import max_overlap_score, sliding_windows
from logspark.session import save_and_read

MIN_ROWS = 10
CODE_SIZE = 64


def embed_lines(
    lines: DataFrame, dim: int = 64, encoder=None, text: str = "line", out: str = "embedding", length: int | None = ENCODED_CHARS
) -> DataFrame:
    """Add unit vectors of the first ``length`` characters (null: of whole lines); lines that give no vector get zeros.

    ``encoder`` is a vectorised function from text to ``array<float>``; by default words are hashed.
    """
    if encoder is None:
        return lines.withColumn(out, hash_vector(line_template(F.col(text), length), dim))
    raw = encoder(F.col(text) if length is None else F.substring(text, 1, length))
    zero = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda _: F.lit(0.0))
    return lines.withColumn(out, l2_normalize(F.coalesce(raw.cast("array<double>"), zero)))


def _require_rows(rows: DataFrame) -> None:
    if rows.limit(MIN_ROWS).count() < MIN_ROWS:
        raise ValueError(f"at least {MIN_ROWS} rows are needed")


@dataclass
class Reconstruction:
    """A linear encoder and decoder: the mean vector and the main directions of normal rows."""

    mean: np.ndarray
    directions: np.ndarray
    threshold: float = 0.0
    val_loss: float = 0.0

    def score(self, rows: DataFrame, vector: str = "embedding", out: str = "score") -> DataFrame:
        """Add the mean squared reconstruction error of each row."""
        mean, directions = self.mean, self.directions

        @F.pandas_udf("double")
        def error(vectors: pd.Series) -> pd.Series:
            x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) - mean
            return pd.Series(((x - x @ directions @ directions.T) ** 2).mean(axis=1))

        return rows.withColumn(out, error(F.col(vector)))

    def detect(self, rows: DataFrame, vector: str = "embedding", profile: str = "library") -> DataFrame:
        """Add ``score`` and ``is_anomaly``; the service profile divides scores by the highest one."""
        scored = self.score(rows, vector)
        if profile == "library":
            return scored.withColumn("is_anomaly", F.col("score") > self.threshold)
        peak = scored.agg(F.max("score")).scalar()
        flagged = scored.withColumn("is_anomaly", F.col("score") >= self.threshold)
        return flagged.withColumn("score", F.col("score") / F.when(peak > 0, peak).otherwise(1.0))


def fit_reconstruction(rows: DataFrame, id_column: str, vector: str = "embedding", size: int | None = None) -> Reconstruction:
    """Fit a code of ``size`` numbers (by default up to 64, and a quarter of the vectors' length) on 80 % of the rows, measure on the rest, and set the threshold to the 95th percentile of all errors."""
    _require_rows(rows)
    split = random_split(rows.select(id_column, vector), [id_column])
    train = split.filter("split = 'train'").select(array_to_vector(vector).alias("features"))
    mean = train.agg(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
    # A code as wide as the vectors would reproduce every row.
    width = min(CODE_SIZE, max(len(mean) // 4, 1)) if size is None else size
    if width > len(mean):
        raise ValueError(f"a code of {width} numbers is longer than the vectors ({len(mean)})")
    directions = PCA(k=width, inputCol="features", outputCol="code").fit(train).pc.toArray()
    model = Reconstruction(mean, directions)
    scored = model.score(split, vector)
    limit = calibrate_percentile(scored, label=None).first()["threshold"]
    loss = scored.filter("split = 'val'").agg(F.avg("score").alias("v")).first()["v"]
    model.threshold, model.val_loss = float(limit), float(loss or 0.0)
    return model


def window_features(lines: DataFrame, size: int = WINDOW_SIZE, stride: int = WINDOW_STRIDE, vector: str = "embedding", label: str | None = None) -> DataFrame:
    """``source_id, start, features`` (mean, spread, last vector, change) and the majority ``label`` of windows."""
    v = array_to_vector(vector)
    parts = [
        Summarizer.mean(v).alias("_mean"), Summarizer.std(v).alias("_std"),
        F.max_by(vector, "line_no").alias("_last"), F.min_by(vector, "line_no").alias("_first"),
    ]
    if label:
        parts.append((F.avg(label) > 0.5).cast("double").alias("label"))
    found = sliding_windows(lines, size, stride, parts)
    change = F.zip_with("_last", "_first", lambda a, b: (a - b).cast("double"))
    found = found.withColumns(
        {"_change": array_to_vector(change), "_end": array_to_vector(F.col("_last").cast("array<double>"))}
    )
    joined = VectorAssembler(inputCols=["_mean", "_std", "_end", "_change"], outputCol="features").transform(found)
    return joined.drop("_mean", "_std", "_last", "_first", "_change", "_end")


def fit_sequence(lines: DataFrame, label: str = "label", size: int = WINDOW_SIZE, stride: int = WINDOW_STRIDE, vector: str = "embedding"):
    """A classifier of windows; a window is anomalous if more than half of its lines are."""
    windows = window_features(lines, size, stride, vector, label)
    return LogisticRegression(maxIter=30, regParam=0.01, tol=1e-4).fit(windows.select("features", "label"))


def score_windows(model, lines: DataFrame, size: int = WINDOW_SIZE, stride: int = WINDOW_STRIDE, vector: str = "embedding", label: str | None = None) -> DataFrame:
    """``source_id, start, score`` (and ``label``): the model's probability of an anomalous window."""
    scored = model.transform(window_features(lines, size, stride, vector, label))
    kept = ["source_id", "start", *(["label"] if label else [])]
    return scored.select(*kept, F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def sequence_anomaly(model, lines: DataFrame, size: int = WINDOW_SIZE, stride: int = WINDOW_STRIDE, vector: str = "embedding") -> DataFrame:
    """Add to each line the highest probability of its windows."""
    return max_overlap_score(lines, score_windows(model, lines, size, stride, vector), size)


def _text_stages(text: str, features: int) -> list:
    return [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}_]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="features"),
    ]


def _label_index(label: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), label) - 1).cast("double")


def fit_severity(rows: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 12) -> PipelineModel:
    """A four-class severity model of texts."""
    _require_rows(rows)
    indexed = rows.withColumn("_y", _label_index(F.col(label))).filter("_y is not null")
    learner = LogisticRegression(featuresCol="features", labelCol="_y", family="multinomial", maxIter=30, regParam=0.01)
    return Pipeline(stages=[*_text_stages(text, features), learner]).fit(indexed)


def predict_severity(rows: DataFrame, model: PipelineModel | None, text: str = "text") -> DataFrame:
    """Add ``severity, confidence, scores``; without a model the keyword rules decide."""
    if model is None:
        return rows.withColumn("_s", keyword_severity(F.col(text))).select(*rows.columns, "_s.*")
    chance = vector_to_array("probability")
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    scored = model.transform(rows).withColumn("_p", chance)
    full = F.concat("_p", F.array_repeat(F.lit(0.0), F.greatest(F.lit(len(SEVERITIES)) - F.size("_p"), F.lit(0))))
    return scored.select(
        *rows.columns, F.get(names, F.col("prediction").cast("int")).alias("severity"), F.array_max("_p").alias("confidence"),
        F.map_from_arrays(names, full).alias("scores"),
    )


def fit_reward(feedback: DataFrame, features: int = 1 << 12) -> tuple[PipelineModel, DataFrame]:
    """A model of the reward of a suggestion text, and the scored validation rows (20 %)."""
    rows = feedback.select("feedback_id", "suggestion", reward_target(F.col("suggestion_quality"), F.col("was_helpful")).alias("target"))
    split = random_split(rows, ["feedback_id"])
    learner = LinearRegression(featuresCol="features", labelCol="target", regParam=0.01, maxIter=30, solver="l-bfgs")
    model = Pipeline(stages=[*_text_stages("suggestion", features), learner]).fit(split.filter("split = 'train'"))
    return model, predict_reward(split.filter("split = 'val'"), model)


def predict_reward(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``prediction``, kept inside 0..1."""
    scored = model.transform(rows)
    inside = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
    return scored.select(*rows.columns, inside.alias("prediction"))


def train_detector(lines: DataFrame, dim: int = 64, model_id: str = "reconstruction") -> tuple[Reconstruction, DataFrame]:
    """Fit the reconstruction model on lines and return it with its registry row ``kind, ts, threshold, val_loss``."""
    rows = embed_lines(lines, dim).select(F.xxhash64("source_id", "line_no").alias("_id"), "embedding")
    # Vectors are read for the mean, the directions and the errors.
    rows = save_and_read(rows, "vectors")
    model = fit_reconstruction(rows, "_id")
    row = lines.sparkSession.range(1).select(
        F.lit(model_id).alias("kind"), F.current_timestamp().alias("ts"),
        F.lit(model.threshold).alias("threshold"), F.lit(model.val_loss).alias("val_loss"),
    )
    return model, row
