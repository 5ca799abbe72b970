"""Vectors of many tables and columns stored in batches, with metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "table_name string, column_name string, row_id long, vector array<float>, metadata map<string,string>"


def store_batch(rows: DataFrame, path: str) -> DataFrame:
    """Appends rows of SCHEMA, partitioned by table and column; returns (table_name, column_name, n, dims) of the batch.
    Vectors of one column must have one length."""
    groups = rows.groupBy("table_name", "column_name").agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("dims"), F.max(F.size("vector")).alias("most"))
    bad = groups.where("dims <> most").first()
    if bad is not None:
        raise ValueError(f"dim mismatch in {bad['table_name']}.{bad['column_name']}: {bad['dims']} and {bad['most']}")
    rows.write.mode("append").partitionBy("table_name", "column_name").parquet(path)
    return groups.drop("most")


def read_vectors(spark: SparkSession, path: str, table: str, column: str) -> DataFrame:
    """(row_id, vector, metadata); only the partition's files are read."""
    df = spark.read.schema(SCHEMA).parquet(path)
    return df.where((F.col("table_name") == table) & (F.col("column_name") == column)).select("row_id", "vector", "metadata")
