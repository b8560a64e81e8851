"""Strict TSV, evidence JSON and the activity log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import blank_to_null

ACTIVITY_SCHEMA = "schema INT, pid BIGINT, gate STRING, step STRING, look_id STRING, at TIMESTAMP"
_BAD = "_damaged"


def read_strict_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated UTF-8 whose header must equal ``columns`` exactly; values trimmed, blank is null.

    Quoted values may hold tabs and line breaks.
    """
    header = StructType([StructField(f"_{i}", StringType()) for i in range(len(columns) + 1)])
    lines = spark.read.csv(path, schema=header, sep="\t", header=False, encoding="UTF-8", multiLine=True, mode="PERMISSIVE")
    heads = lines.withColumn("_file", F.input_file_name()).withColumn("_at", F.monotonically_increasing_id())
    first = heads.groupBy("_file").agg(F.min_by(F.array(*header.names), "_at").alias("names"))
    own = F.transform("names", lambda name: F.regexp_replace(F.coalesce(name, F.lit("")), "^\ufeff", ""))
    wrong = first.where(own != F.array(*map(F.lit, [*columns, ""]))).limit(1).collect()
    if wrong:
        raise ValueError(f"header {wrong[0]['names']} of {wrong[0]['_file']} is not {columns}")
    schema = StructType([StructField(name, StringType()) for name in columns])
    raw = spark.read.csv(
        path, schema=schema, sep="\t", header=True, enforceSchema=False, mode="FAILFAST", encoding="UTF-8",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, multiLine=True,
    )
    return raw.select(*[blank_to_null(F.col(name)).alias(name) for name in columns])


def write_tsv(df: DataFrame, path: str) -> None:
    """Replace the whole table; readers see the old or the new files, never a part."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, lineSep="\n", emptyValue="", nullValue="", escape='"')


def read_evidence_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per file; files that do not parse count as absent."""
    raw = spark.read.json(
        path, schema=f"{schema}, {_BAD} STRING", multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord=_BAD
    )
    return raw.where(F.col(_BAD).isNull()).drop(_BAD)


def parse_evidence(df: DataFrame, text: str, schema: str, out: str) -> DataFrame:
    """JSON objects held in a column; damaged ones are dropped."""
    parsed = F.from_json(F.col(text), f"{schema}, {_BAD} STRING", {"columnNameOfCorruptRecord": _BAD})
    return (
        df.withColumn("_parsed", parsed)
        .where(F.col("_parsed").isNotNull() & F.col(f"_parsed.{_BAD}").isNull())
        .withColumn(out, F.col("_parsed").dropFields(_BAD))
        .drop("_parsed")
    )


def read_activity_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=ACTIVITY_SCHEMA)


def stream_activity_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.json(path, schema=ACTIVITY_SCHEMA)
