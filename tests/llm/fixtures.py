"""Rows that every operator must live with, and the given tables in DuckDB."""

import duckdb

FOLDER = "/root/testdata/sf0.001"
LABELLED = "/root/testdata/sf0.1"

SENTENCE = "The quick brown fox jumps over the lazy dog while seven wizards quietly box near the old river bank."
LONG = " ".join(f"word{i % 977} and more text number {i}." for i in range(30_000))

#: doc_id, text, lang, source, and columns whose names operators use themselves.
ODD = [
    (1, SENTENCE, "en", "a", 0.5, "x"),
    (1, SENTENCE, "en", "a", 0.5, "x"),  # a repeated row
    (1, "Another text under an id that is taken, with enough words to make shingles of.", "en", None, None, None),
    (2, None, None, None, None, None),
    (3, "", "en", "a", 0.1, "y"),
    (4, " \n\t ", "fr", "b", 0.1, "y"),
    (None, SENTENCE, "en", "b", 0.2, "z"),
    (None, None, None, None, None, None),
    (5, LONG, "en", "c", 0.3, "z"),
    (6, "12345 ### !!! 😀", "de", "c", 0.3, "z"),
    (7, "日本語のテキスト ▁ \x00 é", None, "ö", 0.3, "z"),
    (8, SENTENCE + " Fin.", "en", "a", 0.9, "w"),
    (9, "x" * 20_000, "en", "a", 0.9, "w"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, score double, node string"


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def duck(folder=FOLDER):
    connection = duckdb.connect()
    for name in ("documents", "labels", "pages", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection
