"""Global ranks without a global window.

A window over no partition sends every row to one task. Here values are cut into ranges at approximate
quantiles, ranked inside each range, and shifted by the number of rows in the ranges before it. What is
broadcast is one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def _with_range(df: DataFrame, value: Column) -> DataFrame:
    """Adds __k (the value itself, which orders), __v (as double, which only tells the range) and __r, the number of its range.
    Values that are one double are in one range, so ids of any size are told apart."""
    df = df.withColumns({"__k": value, "__v": value.cast("double")})
    cuts = df.agg(F.percentile_approx("__v", [i / RANGES for i in range(1, RANGES)], 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    below = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    return df.withColumn("__r", F.size(F.filter(below, lambda c: c < F.col("__v"))))


def _offsets(df: DataFrame, rows: Column) -> DataFrame:
    sizes = df.groupBy("__r").agg(rows.alias("__n"))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # over RANGES rows
    return sizes.select("__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the rank of a value among all rows, ties sharing the mean of their ranks."""
    counts = _with_range(df.groupBy(value).agg(F.count("*").alias("__ties")).persist(), F.col(value))
    inside = F.sum("__ties").over(Window.partitionBy("__r").orderBy("__k"))
    ranked = counts.join(F.broadcast(_offsets(counts, F.sum("__ties"))), "__r")
    ranked = ranked.select(value, (F.col("__before") + inside - F.col("__ties") + (F.col("__ties") + 1) / 2).alias(name))
    return df.join(ranked, value)


def ordinals(df: DataFrame, key: str, name: str, start: int = 1) -> DataFrame:
    """Adds dense ordinals in the order of a numeric key without ties."""
    ranged = _with_range(df, F.col(key))
    inside = F.row_number().over(Window.partitionBy("__r").orderBy("__k"))
    out = ranged.withColumn("__i", inside).join(F.broadcast(_offsets(ranged, F.count("*"))), "__r")
    return out.withColumn(name, (F.col("__before") + F.col("__i") + (start - 1)).cast("bigint")).drop("__k", "__v", "__r", "__i", "__before")
