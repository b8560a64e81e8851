"""A training-data pipeline over documents: identify, judge, deduplicate, mix, tokenise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proofloom.llm import language, mixing, ngram_join, quality_classifier, sentencepieces
from proofloom.plans.lineage import written_table

#: Documents that score less are more likely bad than good and go.
LEAST_QUALITY = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model is learned from the given languages."""
    return language.keep_identified(docs, language.fit_language_model(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, learned from all labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.fit_quality_model(quality_classifier.labelled_texts(docs, labels, "quality"))
    return quality_classifier.keep_good(docs, model, threshold=LEAST_QUALITY)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return ngram_join.keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of its source ask."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token ids of every copy."""
    return sentencepieces.encode_documents(docs)


STAGES = [("language_id", identified), ("quality_classifier", good), ("ngram_join", distinct), ("mixing", mixed), ("sentencepiece", encoded)]

#: Language models, classifiers and tokenizers are no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs, _ = written_table(stage(spark, docs, sf_dir))
    return docs
