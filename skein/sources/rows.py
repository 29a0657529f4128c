"""Chunk rows and assets as JSON files, one row a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ASSET = "asset_id string, document_id string, asset_type string, caption string, image_path string, image_paths array<string>, row_count int, md_lines array<int>, chunk_ids array<string>"


def write_rows(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replaces what is at ``path`` by the rows, one JSON object a line, nulls included; in a folder per value of ``by``."""
    writer = rows.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(*by) if by else writer).json(path)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines in the given schema; fields that a row lacks are null, broken lines are rows of nulls."""
    return spark.read.schema(schema).json(path)


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    return read_rows(spark, path, ASSET)
