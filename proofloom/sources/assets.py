"""Assets as (name, length, sha256) rows, exact copies, and frozen snapshots of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.bounds import BROADCAST_ROWS

# File-name endings that mark an operator's copy.
COPY_SUFFIX = r"(?iu)(?:[ _-]copy(?:\s*\(\d+\)|\s+\d+)?|[ _-]копия(?:\s*\(\d+\)|\s+\d+)?)$"


def list_assets(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under ``path`` without reading their content."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return files.select("path", name.alias("name"), "length", "modificationTime", "content")


def scan_assets(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, name, length, modification time and SHA-256 of every file."""
    files = list_assets(spark, path, glob)
    return files.select("path", "name", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def scan_collisions(spark: SparkSession, path: str, glob: str = "*", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """As :func:`scan_assets`, with a hash only for files whose length another file shares.

    A unique length proves unique bytes, so those files keep a null hash.  When the shared lengths are
    few they are broadcast and only their files are read; otherwise every file is hashed where it is
    read, and the hashes of unique lengths are dropped.  The rows are the same either way.
    """
    files = list_assets(spark, path, glob)
    shared = files.groupBy("length").count().where("count > 1").select("length")
    if shared.limit(broadcast_rows + 1).count() > broadcast_rows:
        hashed = scan_assets(spark, path, glob).join(shared.withColumn("_shared", F.lit(True)), "length", "left")
        return hashed.select("path", "name", "length", "modificationTime", F.when(F.col("_shared"), F.col("sha256")).alias("sha256"))
    alone = files.drop("content").join(F.broadcast(shared), "length", "left_anti").withColumn(
        "sha256", F.lit(None).cast("string")
    )
    hashed = (
        files.join(F.broadcast(shared), "length", "left_semi").withColumn("sha256", F.sha2("content", 256)).drop("content")
    )
    columns = ["path", "name", "length", "modificationTime", "sha256"]
    return alone.select(columns).unionByName(hashed.select(columns))


def content_identity(df: DataFrame, name: Column, content: Column) -> DataFrame:
    """Rows with content held in a column as assets."""
    return df.select(name.alias("name"), F.octet_length(content).cast("bigint").alias("length"), F.sha2(content, 256).alias("sha256"))


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def dedupe_exact(assets: DataFrame, preferred: Column | None = None) -> DataFrame:
    """One representative per distinct content: length, sha256, selected, members.

    Preferred names win, then names without a copy ending, then case-blind and exact name order.
    """
    last_resort = F.lit(False) if preferred is None else ~preferred
    order = F.struct(last_resort, _stem(F.col("name")).rlike(COPY_SUFFIX), F.lower("name"), F.col("name"))
    return assets.groupBy("length", "sha256").agg(
        F.min_by("name", order).alias("selected"), F.count("*").alias("members")
    )


def exact_copies(assets: DataFrame, representatives: DataFrame) -> DataFrame:
    """Every asset that is not the representative of its content, one row each."""
    groups = representatives.where("members > 1").select("length", "sha256", "selected")
    return assets.join(groups, ["length", "sha256"]).where(F.col("name") != F.col("selected"))


def manifest_totals(assets: DataFrame, used_names: DataFrame, preferred: Column | None = None) -> DataFrame:
    """One row: available, unique, duplicate, used and unused representatives."""
    unique = dedupe_exact(assets, preferred)
    used = used_names.select(F.col(used_names.columns[0]).alias("selected")).distinct().withColumn("_used", F.lit(1))
    return (
        unique.join(used, "selected", "left")
        .agg(
            F.coalesce(F.sum("members"), F.lit(0)).alias("available"),
            F.count("*").alias("unique_files"),
            F.coalesce(F.sum(F.col("members") - 1), F.lit(0)).alias("duplicate_files"),
            F.count("_used").alias("used_files"),
            (F.count("*") - F.count("_used")).alias("unused_files"),
        )
    )


def snapshot_manifest(assets: DataFrame, path: str = "name") -> DataFrame:
    return assets.select(F.col(path).alias("path"), "sha256", F.col("length").alias("bytes"))


def verify_snapshot(
    manifest: DataFrame, current: DataFrame, excluded_prefixes: list[str], required: DataFrame | None = None
) -> DataFrame:
    """Problems of a frozen manifest (path, sha256, bytes) against the current files.

    ``missing`` and ``changed`` for frozen paths outside the excluded prefixes, ``required absent``
    for required paths the manifest does not carry.
    """
    frozen = manifest
    for prefix in excluded_prefixes:
        frozen = frozen.where(~F.col("path").startswith(prefix))
    now = current.select("path", F.col("sha256").alias("now_sha256"), F.col("bytes").alias("now_bytes"))
    problem = F.when(F.col("now_sha256").isNull(), "missing").when(
        (F.col("now_sha256") != F.col("sha256")) | (F.col("now_bytes") != F.col("bytes")), "changed"
    )
    problems = (
        frozen.join(now, "path", "left").select("path", problem.alias("problem")).where(F.col("problem").isNotNull())
    )
    if required is None:
        return problems
    absent = required.select("path").distinct().join(frozen, "path", "left_anti").select(
        "path", F.lit("required absent").alias("problem")
    )
    return problems.unionByName(absent)
