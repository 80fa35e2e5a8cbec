"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of every whole text go through variance-stabilising transforms and are standardised. Each class has a mean
and a covariance, shrunk towards a multiple of the identity; the Cholesky factor of each is computed once and cached in the
model. A document's evidence is the difference of the two Mahalanobis log densities, which a two-parameter logistic curve
(fitted to the same labelled rows) turns into a score between 0 and 1.

The fit uses sums over all labelled rows, added up by Spark: no row is sampled or collected.

Defined results: null and empty texts have the statistics of a text without words and are scored like any other. Rows with
repeated ids are scored one by one; a label given twice counts once, the least value. Labels other than 0 and 1 and null labels
are ignored. Without a row labelled 0 every score is 1, else without a row labelled 1 every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm import textvec
from logspark.llm.common import keep_rows, map_batches, save_and_read

#: Characters of the base alphabets that are counted; bytes above 127 count as letters.
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#*$%&|<>@^~=_{}[]\\/+`"
EXCLAIM = b"!?"
POINTS = b".,;:"
DIGITS = b"0123456789"
LINES = b"\n"
STATISTICS = (
    "log_words", "word_length", "length_spread", "upper", "symbols", "exclaim", "points", "digits", "lines", "distinct", "adjacent",
    "repeated_threes", "top_word",
)
#: Share of the identity in each class covariance.
SHRINKAGE = 0.1
#: Log-density differences are cut here before the logistic curve.
LIMIT = 60.0
THRESHOLD = 0.7


def statistics(column: pa.Array) -> np.ndarray:
    """One row of :data:`STATISTICS` for each text."""
    return np.concatenate([_piece(p) for p in textvec.pieces(column)] or [np.zeros((0, len(STATISTICS)))])


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


def _piece(piece: textvec.Piece) -> np.ndarray:
    piece.words()
    n = np.diff(piece.at).astype(float)

    def count(chars: bytes) -> np.ndarray:
        hits = np.flatnonzero(_table(chars).astype(bool)[piece.data])
        return np.diff(np.searchsorted(hits, piece.offsets)).astype(float)

    def per_row(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0.0], np.cumsum(values, dtype=float)])[piece.at])

    length = (piece.ends - piece.starts).astype(float)
    chars, squares = per_row(length), per_row(length**2)
    mean = chars / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(squares / np.maximum(n, 1) - mean**2, 0))
    same = np.zeros(len(piece.hashes))
    same[1:] = (piece.hashes[1:] == piece.hashes[:-1]) & (piece.row[1:] == piece.row[:-1])
    threes, first = piece.grams(3)
    at3 = np.searchsorted(first, piece.at)
    distinct, top, repeated = np.zeros(piece.rows), np.zeros(piece.rows), np.zeros(piece.rows)
    for row in range(piece.rows):
        own = np.sort(piece.hashes[piece.at[row] : piece.at[row + 1]])
        if len(own):
            cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            distinct[row], top[row] = len(cuts) - 1, np.diff(cuts).max()
            runs = np.sort(threes[at3[row] : at3[row + 1]])
            repeated[row] = (runs[1:] == runs[:-1]).sum()
    share = lambda k, of: np.sqrt(k / (of + 4.0))
    return np.column_stack(
        [
            np.log1p(n), np.log1p(mean), np.log1p(spread), share(count(UPPER), chars), share(count(SYMBOLS), n), share(count(EXCLAIM), n),
            share(count(POINTS), n), share(count(DIGITS), chars), share(count(LINES), n), np.log((distinct + 4) / (n + 4)), share(per_row(same), n),
            share(repeated, n), share(np.maximum(top - 1, 0), n),
        ]
    )


@dataclass
class Model:
    """Centre and scale of the statistics; per class the mean, the inverse Cholesky factor and half the log determinant; the curve."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_scale: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log density under class 1 less that under class 0."""
        z = (x - self.centre) / self.scale
        logs = [-0.5 * (((z - m) @ f.T) ** 2).sum(1) - s for m, f, s in zip(self.means, self.factors, self.log_scale, strict=True)]
        return np.clip(logs[1] - logs[0], -LIMIT, LIMIT)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-(self.slope * self.evidence(x) + self.offset)))


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` and, where ``docs`` has one, ``__row``: the statistics of every row of ``docs`` (``doc_id``, ``text``)."""
    key = [c for c in docs.columns if c == "__row"]

    def measure(batch: pa.RecordBatch):
        yield {"doc_id": batch.column(0), "x": list(statistics(batch.column(1)))} | {c: batch.column(c) for c in key}

    schema = "doc_id long, x array<double>" + "".join(f", {c} long" for c in key)
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", *key), schema, measure)


def sums(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products of ``x`` per ``label``; batches are added up before Spark adds their sums."""
    d = len(STATISTICS)

    def add(batch: pa.RecordBatch):
        label = batch.column(0).to_numpy()
        x = batch.column(1).flatten().to_numpy().reshape(len(label), d)
        for k in (0, 1):
            own = x[label == k]
            yield {"label": [k], "v": [np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])]}

    parts = map_batches(rows.select("label", "x"), "label int, v array<double>", add).select("label", F.posexplode("v").alias("i", "v"))
    out = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    for r in parts.groupBy("label", "i").agg(F.sum("v").alias("v")).collect():  # two classes, fixed width
        out[r["label"]][r["i"]] = r["v"]
    return {k: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in out.items()}


def fit(rows: DataFrame, shrinkage: float = SHRINKAGE) -> Model:
    """A model of ``rows`` (``label`` 0 or 1, ``x``)."""
    d, total = len(STATISTICS), sums(rows)
    n = np.array([total[k][0] for k in (0, 1)])
    blank = Model(np.zeros(d), np.ones(d), np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2))
    if not n.all():
        blank.constant = 0.0 if n[0] else 1.0
        return blank
    centre = sum(total[k][1] for k in (0, 1)) / n.sum()
    second = sum(np.diag(total[k][2]) for k in (0, 1)) / n.sum()
    scale = np.sqrt(np.maximum(second - centre**2, 1e-6))
    model = blank
    model.centre, model.scale = centre, scale
    for k in (0, 1):
        count, first, outer = total[k]
        mean = first / count
        covariance = (outer / count - np.outer(mean, mean)) / np.outer(scale, scale)
        covariance = (1 - shrinkage) * covariance + shrinkage * max(np.trace(covariance) / d, 1e-3) * np.eye(d)
        factor = np.linalg.cholesky(covariance)
        model.means[k], model.factors[k] = (mean - centre) / scale, np.linalg.inv(factor)
        model.log_scale[k] = np.log(np.diag(factor)).sum()
    model.slope, model.offset = curve(rows, model)
    return model


def curve(rows: DataFrame, model: Model) -> tuple[float, float]:
    """Slope and offset of the logistic curve, from counts of evidence rounded to whole numbers."""

    def evidence(batch: pa.RecordBatch):
        x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(STATISTICS))
        yield {"label": batch.column(0), "e": np.rint(model.evidence(x)).astype(np.int32)}

    counted = map_batches(rows.select("label", "x"), "label int, e int", evidence).groupBy("label", "e").count().collect()
    y, e, c = (np.array([r[k] for r in counted], float) for k in ("label", "e", "count"))
    weights = c / np.where(y == 1, c[y == 1].sum(), c[y == 0].sum())  # both classes weigh the same
    slope, offset = 0.5, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(slope * e + offset)))
        gradient = np.array([(weights * (p - y) * e).sum() + 1e-4 * slope, (weights * (p - y)).sum()])
        h = weights * p * (1 - p)
        hessian = np.array([[(h * e * e).sum() + 1e-3, (h * e).sum()], [(h * e).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hessian, gradient)
        slope, offset = float(np.clip(slope - np.clip(step[0], -0.1, 0.1), 0.02, 2)), float(np.clip(offset - np.clip(step[1], -0.5, 0.5), -5, 5))
    return slope, offset


def learn(rows: DataFrame, labels: DataFrame, held_out, shrinkage: float = SHRINKAGE) -> Model:
    """A model of the measured ``rows`` (``doc_id, x``) that are labelled and not held out."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    learned = rows.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).join(known, "doc_id").select("label", "x")
    return fit(save_and_read(learned, "quality-labelled"), shrinkage)


def quality_scores(docs: DataFrame, labels: DataFrame, held_out, threshold: float = THRESHOLD, shrinkage: float = SHRINKAGE) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` for every row of ``docs``, and its ``__row`` if it has one.

    ``labels`` holds ``doc_id, quality``; rows for which ``held_out`` (a function of the id column) is true are not learned from.
    """
    rows = save_and_read(measured(docs), "quality-statistics")
    model = learn(rows, labels, held_out, shrinkage)

    def score(batch: pa.RecordBatch):
        x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(STATISTICS))
        yield {"doc_id": batch.column(0), "score": model.score(x), "evidence": model.evidence(x)} | {c: batch.column(c) for c in key}

    key = [c for c in rows.columns if c == "__row"]
    out = map_batches(rows, "doc_id long, score double, evidence double" + "".join(f", {c} long" for c in key), score)
    return out.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", *key,
    )


def keep_good(docs: DataFrame, labels: DataFrame, held_out, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns: each is judged where its text is read."""
    model = learn(measured(docs.select("doc_id", "text")), labels, held_out)
    return keep_rows(docs, lambda batch: model.score(statistics(batch.column("text"))) >= threshold)
