"""Cutting long lineage in loops with tables in the checkpoint folder every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the session names; one of our own only for a local test session."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            named = tempfile.mkdtemp(prefix="proofloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return context.getCheckpointDir().get()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that every executor can reach."""
    return f"{checkpoint_folder(spark)}/proofloom-{uuid.uuid4().hex}"


def written_table(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows written to a new scratch table and read back, with the table's path for ``delete_table``."""
    spark, path = df.sparkSession, scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows and read them back: the result survives the loss of any executor.

    A checkpointed DataFrame would keep the constraints inferred for it, which in a loop of joins
    grow until planning stalls; a table read back carries none.
    """
    return written_table(df)[0]
