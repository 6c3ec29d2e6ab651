"""Writing results: appends, attendee CSV files, chart JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def append_rows(frame: DataFrame, path: str, *, partition_by: list[str] | None = None) -> None:
    """Bulk append to a Parquet table."""
    writer = frame.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def interaction_log(frame: DataFrame, path: str) -> None:
    """Append prompt/reply interactions (user_id, prompt, response, model_used, created_at)."""
    append_rows(frame.select("user_id", "prompt", "response", "model_used", "created_at"), path)


def write_attendee_csv(export: DataFrame, path: str, *, rows_per_file: int = 1_000_000) -> None:
    """One CSV folder per listing. Range partitioning keeps a listing's rows together without
    sending a hot listing to a single task: it spans as many partitions as its size asks for."""
    (
        export.repartitionByRange("listing_id", "Ticket Code").sortWithinPartitions("listing_id", "Ticket Code")
        .write.mode("errorifexists").partitionBy("listing_id").option("header", True)
        .option("maxRecordsPerFile", rows_per_file).csv(path)
    )


def write_charts(charts: DataFrame, path: str) -> None:
    """Each chart's payload as one JSON text line, in a folder of its own."""
    charts.select("chart", F.col("payload").alias("value")).write.mode("errorifexists").partitionBy("chart").text(path)
