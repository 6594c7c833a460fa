"""Detections that another program wrote: pages from 0, boxes as objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
#: One record a figure; unknown fields are not read.
FIGURE = f"struct<name:string,figType:string,page:int,caption:string,regionBoundary:{_BOX},captionBoundary:{_BOX}>"


def corners(box: Column) -> Column:
    """x0, y0, x1, y1, to four places; null for no box."""
    return F.when(box.isNotNull(), F.array(*[F.bround(box[c], 4) for c in ("x1", "y1", "x2", "y2")]))


def one_based(figure: Column) -> list[Column]:
    kind = F.when(F.lower(figure["figType"]) == "table", "table").otherwise("figure")
    return [(figure["page"] + 1).cast("bigint").alias("page"), kind.alias("kind"), F.coalesce(figure["name"], F.lit("unnumbered")).alias("name"), figure["caption"].alias("caption"), corners(figure["regionBoundary"]).alias("bbox"), corners(figure["captionBoundary"]).alias("caption_bbox")]


def detections(spark: SparkSession, path: str, keys: DataFrame | None = None, key: str = "key") -> DataFrame:
    """Figures of one JSON list a file, named by the file (without `.json`). With `keys`, units without a file come out once
    with nulls and the warning `output_missing`, so that none is lost."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1)
    lists = spark.read.text(path, wholetext=True).select(F.url_decode(name).alias(key), F.from_json("value", f"array<{FIGURE}>").alias("figures"))
    rows = lists.select(key, F.explode_outer("figures").alias("f")).select(key, *one_based(F.col("f")))
    if keys is None:
        return rows.where("bbox is not null")
    made = lists.select(key).distinct().withColumn("__made", F.lit(True))
    out = keys.select(key).distinct().join(rows, key, "left").join(made, key, "left")
    return out.withColumn("warning", F.when(F.col("__made").isNull(), "output_missing")).drop("__made")
