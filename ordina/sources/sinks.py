"""Writers. Spark's commit protocol makes a table appear whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_rows(df: DataFrame, path: str) -> None:
    """JSON lines, one row each; refuses a folder that exists."""
    df.write.mode("errorifexists").json(path)


def write_replaced(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Parquet in which only the partitions that df has are replaced, so a run can be repeated."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def summary(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows by status, failures last, for the report of a run."""
    return df.groupBy(F.coalesce(F.col(status), F.lit("unknown")).alias("status")).agg(F.count("*").alias("n")).orderBy(F.col("status").isin("failed", "error"), "status")
