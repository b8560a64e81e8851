"""Language identification: known words by their per-language log frequency, unseen words by shorter n-grams.

The model is fitted on a bounded sample of labelled texts, so its size does not grow with the table: words and
character n-grams seen at least twice in the sample, with one log frequency per language.  A word that is not
among them falls back to the longest order of character n-grams (with word edges) of which it holds a known one.
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

from ..plans.bounds import broadcast_if_small
from .common import HASH_RANGE, ending, keep_rows, kept_by_worker, map_batches, record

#: Texts per language that the model is fitted on, at most (a hash of the text chooses them).
FIT_TEXTS = 2_000
#: Longest character n-gram for unseen words.
ORDERS = 4
MIN_COUNT = 2
#: Evidence of a longer text counts as that of so many words, which keeps scores apart from 1.
EVIDENCE_WORDS = 32
#: Unseen words that a worker remembers between texts.
MEMO_WORDS = 50_000
#: A stage that filters keeps texts with at least this score.
MIN_SCORE = 0.4

UNDETERMINED = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> list[str]:
    """Runs of letters, lower-cased; signs for numbers such as one half or a circled two are none."""
    found = LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return "".join(c if c.isalpha() else " " for c in " ".join(found)).split()


def grams(word: str, order: int) -> list[str]:
    """Character n-grams of a word; from order 2 on with its edges marked."""
    if order == 1:
        return list(word)
    edged = f"^{word}$"
    return [edged[i : i + order] for i in range(len(edged) - order + 1)]


@dataclass
class LanguageModel:
    languages: list[str]
    #: Per order (0: words): gram -> row of the order's matrix of log frequencies, one column per language.
    index: list[dict[str, int]]
    weights: list[np.ndarray]
    uid: str = field(default_factory=lambda: uuid4().hex)

    def backed_off(self, word: str) -> np.ndarray:
        """Log frequencies of an unseen word from the longest order with a known n-gram; zeros if none is known."""
        for order in range(len(self.index) - 1, 0, -1):
            index = self.index[order]
            rows = [r for g in grams(word, order) if (r := index.get(g)) is not None]
            if rows:
                return self.weights[order][rows].mean(axis=0)
        return np.zeros(len(self.languages))


def fit_language_model(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", texts_per_language: int = FIT_TEXTS, orders: int = ORDERS, min_count: int = MIN_COUNT
) -> LanguageModel:
    """Fit on rows with a language and a text; others are not learned from.  No such row gives a model of no language."""
    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    held = broadcast_if_small(labelled.groupBy("lang").count())
    chance = F.pmod(F.xxhash64("text"), F.lit(HASH_RANGE)) / F.lit(float(HASH_RANGE))
    chosen = labelled.join(held, "lang").where(F.col("count") * chance < texts_per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for language, held_text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(language, Counter()).update(letter_words(held_text))
        for language, found in words.items():
            for order in range(orders + 1):
                if order:
                    counts: Counter = Counter()
                    for word, n in found.items():
                        for gram in grams(word, order):
                            counts[gram] += n
                else:
                    counts = found
                yield record(
                    order=([order] * len(counts), pa.int32()), lang=([language] * len(counts), pa.string()),
                    gram=(list(counts), pa.string()), n=(list(counts.values()), pa.int64()),
                )

    counted = chosen.select("lang", "text").mapInArrow(ending(count), "order int, lang string, gram string, n bigint")
    totals = counted.groupBy("order", "lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    languages = sorted(set(totals["lang"]))
    place = {language: i for i, language in enumerate(languages)}
    index: list[dict[str, int]] = [{} for _ in range(orders + 1)]
    cells: list[list[tuple[int, int, int]]] = [[] for _ in range(orders + 1)]
    for order, language, gram, n in zip(totals["order"], totals["lang"], totals["gram"], totals["n"]):
        cells[order].append((index[order].setdefault(gram, len(index[order])), place[language], n))
    weights = []
    for order in range(orders + 1):
        counts = np.zeros((len(index[order]), len(languages)))
        if cells[order]:
            rows, columns, n = np.array(cells[order]).T
            counts[rows, columns] = n
        share = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * max(1, len(counts))))
        known = counts.sum(axis=1) >= min_count
        weights.append(share[known])
        new = np.cumsum(known) - 1
        index[order] = {gram: int(new[row]) for gram, row in index[order].items() if known[row]}
    return LanguageModel(languages, index, weights)


class WordRows(dict):
    """Row of each word in a matrix that gains a row for every unseen word."""

    def __init__(self, model: LanguageModel):
        super().__init__(model.index[0])
        self.model = model
        self.known = len(model.index[0])
        self.matrix = np.vstack([model.weights[0], np.zeros((MEMO_WORDS, len(model.languages)))])
        self.used = self.known

    def __missing__(self, word: str) -> int:
        if self.used == len(self.matrix):
            self.matrix = np.vstack([self.matrix, np.zeros_like(self.matrix)])  # only within one text
        self.matrix[self.used] = self.model.backed_off(word)
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def rows(self, words: list[str]) -> np.ndarray:
        if self.used - self.known > MEMO_WORDS // 2:
            self.clear()
            self.__init__(self.model)
        found = list(map(self.__getitem__, words))
        return self.matrix[found]


def word_rows(model: LanguageModel) -> WordRows:
    return kept_by_worker(("language", model.uid), lambda: WordRows(model))


def predict(model: LanguageModel, text: str | None) -> tuple[str, float]:
    """Language and share of the evidence (0 to 1) of one text."""
    words = letter_words(text or "")
    if not words or not model.languages:
        return UNDETERMINED, 0.0
    total = word_rows(model).rows(words).sum(axis=0) * min(1.0, EVIDENCE_WORDS / len(words))
    share = np.exp(total - total.max())
    share /= share.sum()
    best = int(share.argmax())
    return model.languages[best], float(share[best])


def identify_languages(docs: DataFrame, model: LanguageModel, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the key, the columns in ``keep``, lang_pred and score.

    A text that is null or holds no letter is ``und`` with score 0, and so is every text when nothing was learned.
    Ties go to the language that sorts first.  Repeated rows and null keys give a row each; an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [predict(shared.value, t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        held = {name: batch.column(i) for i, name in enumerate(batch.schema.names[:-1])}
        return record(**held, lang_pred=([f[0] for f in found], pa.string()), score=([f[1] for f in found], pa.float64()))

    read = docs.select(F.col(key).alias("doc_id"), *keep, F.col(text).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:-1])
    return map_batches(read, kernel, f"{kept}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, *, text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The documents, with all their columns, whose language is found with at least ``min_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def wanted(held: str | None) -> bool:
        found, score = predict(shared.value, held)
        return found != UNDETERMINED and score >= min_score

    return keep_rows(docs, text, wanted)
