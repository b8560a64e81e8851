"""Toxicity: class-conditional Kneser-Ney models of word pairs with shared backoff counts.

Words and word pairs are counted per class over all labelled rows, once per text, so that one text that repeats
itself proves little; the counts grow with the rows, and so does what is kept for scoring: a word or pair is an
expression of its own when ``MIN_COUNT`` texts of a class hold it, whatever its share; every rarer one gives its whole
count to the backoff, as the discount does for the others.  The driver gathers the expressions and broadcasts them, so
its memory bounds the vocabulary.  A pair backs off to the class's words, these to the continuation counts (before how many different words a word's pairs stand) that both classes share, so a rare
expression is as likely in one class as in the other.

A text is read in passages of ``PASSAGE_WORDS`` words.  The difference of the two log-likelihoods of a passage is
divided by its length; the text has the value of its most toxic passage, which a logistic curve turns into a
score.  The curve is fitted on a bounded sample of the tenth of the labelled rows that is kept out of the counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage
from .common import bounded_sample, map_batches, record
from .quality_classifier import logistic_curve

MIN_COUNT = 5
DISCOUNT = 0.75
PASSAGE_WORDS = 2
#: A text has the mean value of so many of its passages, the most toxic ones.
PASSAGES = 3
#: One row in so many is kept for the curve.
CURVE_SHARE = 8
#: Rows of each class that the logistic curve is fitted on, at most.
FIT_ROWS = 5_000
THRESHOLD = 0.5
#: Floor of any probability, relative to an even share of the words.
FLOOR = 0.01

WORDS = re.compile(r"[^\W\d_]+")
RARE = 0


@dataclass
class ToxicityModel:
    """Word numbers (0: rare words) and log-likelihood differences, toxic less ordinary."""

    index: dict[str, int]
    #: Difference for a pair that is no expression of its own: by_history[v] is added to the mixture below.
    unigram: np.ndarray  # (2, words) class probabilities
    backoff: np.ndarray  # (2, words) mass that a history leaves to the class's words
    keys: np.ndarray  # sorted pairs v * words + w
    pairs: np.ndarray  # (2, pairs) discounted pair probabilities
    slope: float = 0.0
    offset: float = 0.0
    uid: str = field(default_factory=lambda: uuid4().hex)

    def differences(self, words: list[str]) -> np.ndarray:
        """Log-likelihood difference of every word after its predecessor."""
        find = self.index.get
        ids = np.fromiter((find(w, RARE) for w in words), dtype=np.int64, count=len(words))
        before = np.concatenate([[RARE], ids[:-1]])
        share = self.backoff[:, before] * self.unigram[:, ids]
        if len(self.keys):
            key = before * len(self.unigram[0]) + ids
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            share = share + np.where(self.keys[at] == key, self.pairs[:, at], 0.0)
        return np.log(share[1]) - np.log(share[0])

    def value(self, text: str | None, passage: int = PASSAGE_WORDS, most: int = PASSAGES) -> float:
        """Mean over the most toxic passages of the length-normalised difference; 0 for a text without words."""
        words = WORDS.findall((text or "").lower())
        if not words:
            return 0.0
        difference = self.differences(words)
        starts = np.arange(0, len(difference), passage)
        each = np.add.reduceat(difference, starts) / np.minimum(passage, len(difference) - starts)
        return float(each.mean() if len(each) <= most else np.partition(each, len(each) - most)[-most:].mean())

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.value(text) + self.offset, -30, 30))))


def _word_counts(labelled: DataFrame) -> DataFrame:
    """word, zeros, ones: ordinary and toxic texts that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[label].update(set(WORDS.findall((text or "").lower())))
        words = list(held[0] | held[1])
        yield record(word=(words, pa.string()), zeros=([held[0][w] for w in words], pa.int64()), ones=([held[1][w] for w in words], pa.int64()))

    counted = labelled.select("text", "label").mapInArrow(count, "word string, zeros bigint, ones bigint")
    return counted.groupBy("word").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))


def _pair_counts(labelled: DataFrame, shared) -> DataFrame:
    """pair, zeros, ones: ordinary and toxic texts that hold the neighbouring words, given by their numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        size = len(index) + 1
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORDS.findall((text or "").lower())
                ids = np.fromiter((index.get(w, RARE) for w in words), dtype=np.int64, count=len(words))
                if len(ids):
                    found[label].append(np.unique(np.concatenate([[RARE], ids[:-1]]) * size + ids))
            keys, labels = [], []
            for label in (0, 1):
                if found[label]:
                    keys.append(np.concatenate(found[label]))
                    labels.append(np.full(len(keys[-1]), label))
            if keys:
                unique, where = np.unique(np.concatenate(keys), return_inverse=True)
                toxic = np.concatenate(labels)
                ones = np.bincount(where, weights=toxic, minlength=len(unique)).astype(np.int64)
                both = np.bincount(where, minlength=len(unique))
                yield record(pair=(unique, pa.int64()), zeros=(both - ones, pa.int64()), ones=(ones, pa.int64()))

    counted = labelled.select("text", "label").mapInArrow(count, "pair bigint, zeros bigint, ones bigint")
    return counted.groupBy("pair").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))


def fit_toxicity_model(labelled: DataFrame, *, min_count: int = MIN_COUNT, discount: float = DISCOUNT, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Fit on rows (key, text, label 0/1).  Without both classes every score is the smoothed share of label 1."""
    spark = labelled.sparkSession
    aside = F.pmod(F.xxhash64("key", "text", F.lit("curve")), F.lit(CURVE_SHARE)) == 0
    held = {r["label"]: r["count"] for r in labelled.where(aside).groupBy("label").count().collect()}
    labelled, curve = (labelled.where(~aside), labelled.where(aside)) if min(held.get(0, 0), held.get(1, 0)) >= 10 else (labelled, labelled)
    words = cut_lineage(_word_counts(labelled))
    totals = words.agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).first()
    totals = [float(totals["zeros"] or 0), float(totals["ones"] or 0)]

    def frequent(zeros: str, ones: str):
        return (F.col(zeros) >= min_count) | (F.col(ones) >= min_count)

    kept = words.where(frequent("zeros", "ones")).orderBy("word").toArrow()  # grows with the vocabulary
    index = {word: i + 1 for i, word in enumerate(kept["word"].to_pylist())}
    size = len(index) + 1
    pairs = cut_lineage(_pair_counts(labelled, spark.sparkContext.broadcast(index)))
    history, word = F.floor(F.col("pair") / size), F.col("pair") % size
    is_kept = frequent("zeros", "ones")
    discounted = [F.when(is_kept, F.least(F.col(c), F.lit(discount))).otherwise(F.col(c)) for c in ("zeros", "ones")]
    histories = pairs.groupBy(history.alias("word")).agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum(discounted[0]).alias("free0"), F.sum(discounted[1]).alias("free1")
    ).toArrow()  # a row per word of the model
    followers = pairs.groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("types")).toArrow()
    expressions = pairs.where(is_kept).orderBy("pair").toArrow()  # grows with the pairs

    types = np.zeros(size)
    types[followers["word"].to_numpy()] = followers["types"].to_numpy()
    continuation = (types + 1.0) / (types.sum() + size)
    counts = np.zeros((2, size))
    for c, name in enumerate(("zeros", "ones")):
        counts[c, 1:] = kept[name].to_numpy()
        counts[c, RARE] = max(0.0, totals[c] - counts[c].sum())
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1.0)
    cut = np.where(counts < min_count, counts, np.minimum(counts, discount))
    cut[:, RARE] = counts[:, RARE]  # rare words are as likely in one class as in the other
    cut_mass = np.maximum(cut.sum(axis=1, keepdims=True) / total, 1e-3)
    unigram = (counts - cut) / total + cut_mass * continuation
    unigram = np.maximum(unigram, FLOOR * continuation)
    unigram[:, RARE] = unigram[:, RARE].max()
    seen, free = np.zeros((2, size)), np.zeros((2, size))
    at = histories["word"].to_numpy()
    for c, name in enumerate(("zeros", "ones")):
        seen[c, at], free[c, at] = histories[name].to_numpy(), histories[f"free{c}"].to_numpy()
    backoff = np.where(seen > 0, np.maximum(free, discount) / np.maximum(seen, 1), 1.0)
    keys = expressions["pair"].to_numpy()
    found = np.array([expressions[c].to_numpy() for c in ("zeros", "ones")], dtype=float)
    mass = np.maximum(found - discount, 0) / np.maximum(seen[:, keys // size], 1) if len(keys) else np.zeros((2, 0))
    model = ToxicityModel(index, unigram, backoff, keys, mass)

    shared = spark.sparkContext.broadcast(model)

    def values(batch: pa.RecordBatch) -> pa.RecordBatch:
        return record(label=batch.column(0), value=([shared.value.value(t) for t in batch.column(1).to_pylist()], pa.float64()))

    rows = curve.groupBy().agg(F.count_if(F.col("label") == 0).alias("zeros"), F.count_if(F.col("label") == 1).alias("ones")).first()
    if not rows["zeros"] or not rows["ones"]:
        model.offset = float(np.log((rows["ones"] + 1) / (rows["zeros"] + 1)))
        return model
    drawn = []
    for label in (0, 1):
        sample = bounded_sample(curve.where(F.col("label") == label), fit_rows, "key", "text")
        drawn.append(np.sort(map_batches(sample.select("label", "text"), values, "label int, value double").toPandas()["value"].to_numpy()))
    margins = np.concatenate(drawn)
    labels = np.repeat([0, 1], [len(d) for d in drawn])
    weights = np.where(labels == 1, rows["ones"] / max(1, len(drawn[1])), rows["zeros"] / max(1, len(drawn[0])))
    spread = max(margins.std(), 1e-9)
    slope, offset = logistic_curve(margins / spread, labels, weights / weights.mean())
    model.slope, model.offset = slope / spread, offset
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the key, the columns in ``keep``, score (0 to 1) and predicted (1 from ``threshold`` on).

    A null text, or one without letters, has the score of the difference 0.  Repeated rows and null keys give a
    row each; an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        held = {name: batch.column(i) for i, name in enumerate(batch.schema.names[:-1])}
        return record(**held, score=(found, pa.float64()), predicted=([int(s >= threshold) for s in found], pa.int32()))

    read = docs.select(F.col(key).alias("doc_id"), *keep, F.col(text).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:-1])
    return map_batches(read, kernel, f"{kept}, score double, predicted int")
