"""Quality classifier: support vectors over n-gram indicators scaled by naive Bayes log-count ratios.

A text becomes a set of hashed indicators: its character 1- to 3-grams, case kept, one indicator for how far the
text repeats itself (its deflate ratio, by length) and one for the share of word pairs that are the same word twice.  Documents per indicator and class are counted over all
labelled rows.  Indicators scaled by their log-count ratio and brought to unit length are the inputs of a linear
hinge-loss model, fitted by dual coordinate descent on a bounded sample of each class; margins become
probabilities by a logistic curve fitted on a part of that sample that the margins were not fitted on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.bounds import broadcast_if_small
from .common import bounded_sample, ending, keep_rows, map_batches, record

BUCKETS = 1 << 16
#: Rows of each class in the sample for the hinge-loss fit, at most.
FIT_ROWS = 2_000
PASSES = 30
COST = 1.0
SMOOTHING = 1.0
#: Scores from here on predict label 1.
THRESHOLD = 0.7
#: Every fourth row of the sample is kept for the logistic curve.
CALIBRATION_SHARE = 4

_MIX = np.uint32(2654435761)
_STEP = np.uint32(0x01000193)


def indicators(text: str | None) -> np.ndarray:
    """Sorted distinct bucket numbers of a text; an empty or null text has only the indicator of its length."""
    raw = (text or "").encode("utf-8", "replace")
    flags = np.zeros(BUCKETS, dtype=bool)
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), dtype=np.uint32)
    hashed = points.copy()
    for order in range(1, 4):
        if order > 1:
            if len(points) < order:
                break
            hashed = hashed[:-1] * _STEP + points[order - 1 :]
        flags[((hashed + np.uint32(order)) * _MIX) >> np.uint32(16)] = True
    ratio = int(20 * len(zlib.compress(raw, 1)) / len(raw)) if raw else 0
    words = (text or "").split()
    twins = sum(map(eq, words, words[1:]))
    share = -(-10 * twins // len(words)) if twins else 0
    for own in (64 * min(len(raw).bit_length(), 24) + min(ratio, 40), 2048 + share):
        flags[((0x9E3779B1 + own) * int(_MIX) & 0xFFFFFFFF) >> 16] = True
    return np.flatnonzero(flags).astype(np.int32)


def log_count_ratios(counts: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log of the ratio of indicator shares, class 1 over class 0; counts has a row per class."""
    shares = counts + smoothing
    shares = shares / shares.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, size: int, cost: float = COST, passes: int = PASSES, seed: int = 0) -> np.ndarray:
    """Weights (last: bias) minimising |w|^2 / 2 + cost * sum of hinge losses; each class weighs the same in all."""
    rng = np.random.default_rng(seed)
    weights = np.zeros(size + 1)
    alpha = np.zeros(len(rows))
    share = {s: len(signs) / (2 * max(1, int((signs == s).sum()))) for s in (-1, 1)}
    limit = np.array([cost * share[int(s)] for s in signs])
    norms = np.array([float(v @ v) + 1.0 for _, v in rows])
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            index, values = rows[i]
            slope = signs[i] * (values @ weights[index] + weights[-1]) - 1.0
            new = min(max(alpha[i] - slope / norms[i], 0.0), limit[i])
            if step := (new - alpha[i]) * signs[i]:
                weights[index] += step * values
                weights[-1] += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return weights


def logistic_curve(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope (not negative) and offset of P(label 1 | margin), with softened targets."""
    ones, zeros = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    slope, offset = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        gradient = np.array([(weights * (p - target) * margins).sum(), (weights * (p - target)).sum()])
        spread = weights * p * (1 - p)
        curve = np.array([[(spread * margins**2).sum(), (spread * margins).sum()], [(spread * margins).sum(), spread.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        slope, offset = max(0.0, slope - step[0]), offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(slope), float(offset)


@dataclass
class QualityModel:
    ratios: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def scaled(self, index: np.ndarray) -> np.ndarray:
        values = self.ratios[index]
        length = np.sqrt(values @ values)
        return values / length if length else values

    def margin(self, index: np.ndarray) -> float:
        return float(self.scaled(index) @ self.weights[index] + self.weights[-1])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(indicators(text)) + self.offset, -30, 30))))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts with their 0/1 label; documents without one are left out.  Texts move only if the labels are too many to broadcast."""
    narrow = broadcast_if_small(labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label")).where(F.col(label).isin(0, 1)))
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(narrow, "_key").select(F.col("_key").alias("key"), "text", "label")


def fit_quality_model(labelled: DataFrame, *, fit_rows: int = FIT_ROWS, cost: float = COST, passes: int = PASSES) -> QualityModel:
    """Fit on rows (key, text, label 0/1).  Without both classes every score is the smoothed share of label 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, BUCKETS), dtype=np.int64)
        seen = np.zeros(2, dtype=np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[label, indicators(text)] += 1
                seen[label] += 1
        used = np.flatnonzero(held.any(axis=0))
        columns = [np.append(used, BUCKETS), np.append(held[0, used], seen[0]), np.append(held[1, used], seen[1])]
        yield record(bucket=(columns[0], pa.int32()), zeros=(columns[1], pa.int64()), ones=(columns[2], pa.int64()))

    counted = labelled.select("text", "label").mapInArrow(ending(count), "bucket int, zeros bigint, ones bigint")
    sums = counted.groupBy("bucket").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toPandas()
    counts = np.zeros((2, BUCKETS + 1))
    counts[0, sums["bucket"]], counts[1, sums["bucket"]] = sums["zeros"], sums["ones"]
    seen, counts = counts[:, -1], counts[:, :-1]
    ratios = log_count_ratios(counts)
    if not seen.all():
        return QualityModel(ratios, np.zeros(BUCKETS + 1), 0.0, float(np.log((seen[1] + 1) / (seen[0] + 1))))

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        return record(label=batch.column(0), index=([indicators(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32())))

    samples = [bounded_sample(labelled.where(F.col("label") == label), fit_rows, "key", "text") for label in (0, 1)]
    drawn = [map_batches(s.select("label", "text"), features, "label int, index array<int>").toArrow() for s in samples]
    index = sorted(((label, np.asarray(held, dtype=np.int32)) for t in drawn for label, held in zip(t.column(0).to_pylist(), t.column(1).to_pylist())), key=lambda r: (r[0], r[1].tobytes()))
    labels = np.array([r[0] for r in index])
    model = QualityModel(ratios, np.zeros(BUCKETS + 1), 1.0, 0.0)
    rows = [(held, model.scaled(held)) for _, held in index]
    aside = np.arange(len(rows)) % CALIBRATION_SHARE == 0
    if min(np.bincount(labels[aside], minlength=2)) < 10:
        aside = np.ones(len(rows), dtype=bool)  # too few to set apart: the curve is fitted on the rows themselves
    fitted = np.ones(len(rows), dtype=bool) if aside.all() else ~aside
    model.weights = dual_coordinate_descent([r for r, used in zip(rows, fitted) if used], np.where(labels[fitted] == 1, 1, -1), BUCKETS, cost, passes)
    margins = np.array([v @ model.weights[i] + model.weights[-1] for (i, v), used in zip(rows, aside) if used])
    # The sample holds both classes about equally; each of its rows stands for the rows of its class.
    weights = np.where(labels[aside] == 1, seen[1] / max(1, (labels == 1).sum()), seen[0] / max(1, (labels == 0).sum()))
    model.slope, model.offset = logistic_curve(margins, labels[aside], weights / weights.mean())
    return model


def score_quality(docs: DataFrame, model: QualityModel, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the key, the columns in ``keep``, score (0 to 1) and predicted (1 from ``threshold`` on).

    Null and empty texts are scored by the indicator of their length.  Repeated rows and null keys give a row
    each; an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        held = {name: batch.column(i) for i, name in enumerate(batch.schema.names[:-1])}
        return record(**held, score=(found, pa.float64()), predicted=([int(s >= threshold) for s in found], pa.int32()))

    read = docs.select(F.col(key).alias("doc_id"), *keep, F.col(text).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:-1])
    return map_batches(read, kernel, f"{kept}, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, *, text: str = "text", threshold: float) -> DataFrame:
    """The documents, with all their columns, that score at least ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text, lambda held: shared.value.score(held) >= threshold)
