"""Readers that lose nothing: what cannot be read comes out as a row that says why, beside the rows that can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


def parsed(text: Column, schema: str) -> Column:
    """JSON text as a struct of the schema with _corrupt_record: the text where it, or a field's type, does not fit."""
    return F.from_json(text, f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"})


def fault(record: Column, text: Column, required: list[str]) -> Column:
    """Why a parsed record is refused, null if it is not: no JSON, no object, a field of another type, a missing field."""
    # parsers stop at the end of the first value: as the first of a list of two, it must be all there is
    listed = F.concat(F.lit("["), text, F.lit(", 0]"))
    whole = F.coalesce(F.json_array_length(listed) == 2, F.lit(False)) & F.try_parse_json(listed).isNotNull()
    kind = F.schema_of_variant(F.try_parse_json(text))
    out = F.when(~whole | kind.isNull(), "no JSON").when(~kind.startswith("OBJECT"), "no object")
    for name in required:
        out = out.when(record[name].isNull() & ~F.coalesce(F.array_contains(F.json_object_keys(text), name), F.lit(False)), f"no {name}")
    out = out.when(record.isNull() | record[CORRUPT].isNotNull(), "unexpected type")
    for name in required:
        out = out.when(record[name].isNull(), f"no {name}")
    return out


def json_files(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """One JSON object a file: file, record (a struct) and violation (null: none)."""
    whole = spark.read.text(path, wholetext=True).select(F.url_decode(F.input_file_name()).alias("file"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return whole.withColumn("record", parsed(F.col("value"), schema)).select("file", "record", fault(F.col("record"), F.col("value"), required).alias("violation"))


def refused(rows: DataFrame, what: str, key: str, limit: int = 5) -> None:
    """Raises with the number of refused rows and the first of them; one aggregate."""
    bad = rows.where("violation is not null")
    first = F.slice(F.array_sort(F.collect_list(F.struct(key, "violation"))), 1, limit)
    n = bad.count()
    if n:
        shown = bad.orderBy(key).limit(limit).agg(first.alias("f")).first()["f"]
        raise ValueError(f"{n} {what} refused: " + ", ".join(f"{r[0]}: {r[1]}" for r in shown))
