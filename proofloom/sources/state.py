"""Tables of projects, stages, looks, credits, runs and request usage with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "projects": "id STRING, name STRING, source_dir STRING, output_root STRING, project_dir STRING, show_date DATE, provider STRING, "
    "model STRING, build_mode STRING, reasoning_effort STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "stages": "project_id STRING, stage_key STRING, status STRING, started_at TIMESTAMP, completed_at TIMESTAMP, error STRING, details_json STRING",
    "looks": "project_id STRING, look_id STRING, spread_order INT, pdf_spread INT, left_filename STRING, right_filename STRING, "
    "indd_left_page INT, indd_right_page INT, status STRING, note STRING",
    "credits": "project_id STRING, look_id STRING, excel_sheet STRING, excel_look_number STRING, excel_image STRING, evidence_file STRING, "
    "visual_status STRING, note STRING, manual_override INT, manual_confirmed_at TIMESTAMP, needs_rematch INT, rematch_requested_at TIMESTAMP",
    "runs": "id BIGINT, project_id STRING, stage_key STRING, started_at TIMESTAMP, finished_at TIMESTAMP, status STRING, command STRING, output STRING",
    "settings": "key STRING, value STRING",
    "usage": "id BIGINT, created_at_epoch BIGINT, pacific_day DATE, input_tokens INT, output_tokens INT",
}


def write_state(df: DataFrame, folder: str, name: str, mode: str = "overwrite") -> None:
    """Write a state table; columns it does not have yet are added as nulls."""
    schema = df.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    columns = [
        (F.col(field.name) if field.name in df.columns else F.lit(None)).cast(field.dataType).alias(field.name) for field in schema
    ]
    df.select(*columns).write.mode(mode).parquet(f"{folder}/{name}")


def read_state(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")
