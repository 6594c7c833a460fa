"""Tables of the engine, and how the generic tables in a folder map onto them.

`panel` holds one row for each unit and round of a repeated measurement; `lines` text lines of documents;
`sequence` ordered items of a package; `boxes` rectangles on pages from two sources; `event_log` events of
sessions in order. Each mapping has its SQL beside it, for the oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATUS = {"F": "accepted", "O": "rejected", "P": "withdrawn"}

PANEL_SQL = """
ranked AS (
  SELECT l_orderkey, l_quantity, count(*) OVER (PARTITION BY l_orderkey) AS n,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS round
  FROM lineitem),
panel AS (
  SELECT o_orderkey AS paper_id, CAST(round AS BIGINT) AS round, CAST(1 + floor((l_quantity - 1) / 5) AS BIGINT) AS score,
         CAST(3 + l_orderkey % 4 + CASE WHEN l_quantity <= 10 THEN 1 WHEN l_quantity = 50 THEN 2 ELSE 0 END AS BIGINT) AS narrow,
         CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'rejected' ELSE 'withdrawn' END AS status,
         o_orderpriority AS area, o_totalprice / 50000 AS human_mean, CAST(year(o_orderdate) AS BIGINT) AS year
  FROM ranked JOIN orders ON o_orderkey = l_orderkey WHERE n >= 5 AND round <= 5),
units AS (
  SELECT paper_id, status, area, year, human_mean, avg(score) AS ai_mean, stddev_samp(score) AS ai_stdev
  FROM panel GROUP BY paper_id, status, area, year, human_mean)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "/tmp/checkpoints"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: they are made once, and a lost executor costs its own tasks."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Like `stored`, bucketed by keys: what is joined by just these keys, or grouped by them and more, is not shuffled again."""
    spark, named = df.sparkSession, f"ordina_{name}_{uuid.uuid4().hex}"
    buckets = buckets_of(spark)
    df.write.format("parquet").option("path", shared_path(spark, name)).bucketBy(buckets, *keys).saveAsTable(named)
    out = spark.table(named)
    spark.sql(f"DROP TABLE {named}")  # the name only; the files stay
    return out


def buckets_of(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units are orders with five lines or more, rounds their first five lines. Both windows and the join share
    the partitioning by order key."""
    by_order = Window.partitionBy("l_orderkey")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    ranked = (
        table(spark, sf_dir, "lineitem").select("l_orderkey", *order)
        .withColumn("n", F.count("*").over(by_order)).withColumn("round", F.row_number().over(by_order.orderBy(*order)))
        .where("n >= 5 and round <= 5")
    )
    narrow = 3 + F.col("l_orderkey") % 4 + F.when(F.col("l_quantity") <= 10, 1).when(F.col("l_quantity") == 50, 2).otherwise(0)
    status = F.col("o_orderstatus")
    return ranked.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("paper_id"), F.col("round").cast("bigint").alias("round"),
        (1 + F.floor((F.col("l_quantity") - 1) / 5)).cast("bigint").alias("score"), narrow.cast("bigint").alias("narrow"),
        F.when(status == "F", "accepted").when(status == "O", "rejected").otherwise("withdrawn").alias("status"),
        F.col("o_orderpriority").alias("area"), (F.col("o_totalprice") / 50000).alias("human_mean"), F.year("o_orderdate").cast("bigint").alias("year"),
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a unit: means and the sample standard deviation of its rounds."""
    keys = ["paper_id", "status", "area", "year", "human_mean"]
    return panel(spark, sf_dir).groupBy(*keys).agg(F.avg("score").alias("ai_mean"), F.stddev_samp("score").alias("ai_stdev"))


BOXES_SQL = """
boxes AS (
  SELECT DISTINCT l_orderkey AS page, CASE WHEN l_returnflag = 'A' THEN 'A' ELSE 'B' END AS source,
         CAST((l_partkey % 40) * 10 AS DOUBLE) AS x0, CAST((l_suppkey % 20) * 20 AS DOUBLE) AS y0,
         (l_partkey % 40) * 10 + l_quantity * 8 AS x1, (l_suppkey % 20) * 20 + l_quantity * 6 AS y1, l_linestatus AS name, l_discount AS confidence
  FROM lineitem),
a AS (SELECT page, x0 AS ax0, y0 AS ay0, x1 AS ax1, y1 AS ay1, name AS aname, confidence AS aconf FROM boxes WHERE source = 'A'),
b AS (SELECT page, x0 AS bx0, y0 AS by0, x1 AS bx1, y1 AS by1, name AS bname, confidence AS bconf FROM boxes WHERE source = 'B')
"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("l_partkey") % 40) * 10, (F.col("l_suppkey") % 20) * 20
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.when(F.col("l_returnflag") == "A", "A").otherwise("B").alias("source"),
        x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + F.col("l_quantity") * 8).alias("x1"), (y + F.col("l_quantity") * 6).alias("y1"),
        F.col("l_linestatus").alias("name"), F.col("l_discount").alias("confidence"),
    ).distinct()


def box_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The boxes of both sources with prefixed columns."""
    every = boxes(spark, sf_dir)
    side = lambda s, p: every.where(F.col("source") == s).select("page", *[F.col(c).alias(f"{p}{c}") for c in ("x0", "y0", "x1", "y1", "name")], F.col("confidence").alias(f"{p}conf"))
    return side("A", "a"), side("B", "b")


LINES_SQL = """
lines AS (
  SELECT doc_id, CAST(ord AS BIGINT) AS line_id, line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents))
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of documents with their position."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_id", "line")).withColumn("line_id", F.col("line_id").cast("bigint"))


SEQUENCE_SQL = """
items AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'out' ELSE 'in' END AS type, role, text FROM conversations)
"""


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", "out").otherwise("in").alias("type"), "role", "text")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of sessions (users) in order of time; ids break ties."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "event_id", "ts", F.col("event_type").alias("method"), "value", "props")


# A page holds the boxes of three orders: old regions, new detections and captions (which also stand for text).
PAGE_WIDTH, PAGE_HEIGHT = 320.0, 270.0
REGIONS_SQL = """
regions AS (
  SELECT DISTINCT CAST(floor(l_orderkey / 3) AS BIGINT) AS page, CASE l_returnflag WHEN 'A' THEN 'old' WHEN 'N' THEN 'det' ELSE 'cap' END AS role,
         CASE l_linenumber % 3 WHEN 0 THEN 'Table' WHEN 1 THEN 'figure' ELSE 'FIGURE' END AS label,
         CASE WHEN l_suppkey % 3 = 0 THEN 'unnumbered' ELSE CAST(l_suppkey % 3 AS VARCHAR) END AS name,
         CAST(l_partkey % 12 * 10 AS DOUBLE) AS x0, CAST(l_suppkey % 12 * 15 AS DOUBLE) AS y0, l_partkey % 12 * 10 + l_quantity * 6 AS x1, l_suppkey % 12 * 15 + l_quantity * 5 AS y1,
         round(l_discount * 8, 2) AS confidence, l_linestatus = 'F' AND l_linenumber = 1 AS forced, 6 + round(l_tax * 60, 1) AS size, CAST(l_quantity * 5 AS BIGINT) AS len, CAST(l_orderkey % 4 * 90 AS BIGINT) AS rotation
  FROM lineitem),
kinds AS (SELECT *, CASE WHEN lower(label) = 'table' THEN 'table' ELSE 'figure' END AS kind FROM regions),
old AS (SELECT DISTINCT page, kind, name AS aname, x0 AS ax0, y0 AS ay0, x1 AS ax1, y1 AS ay1 FROM kinds WHERE role = 'old'),
det AS (SELECT DISTINCT page, kind, x0 AS bx0, y0 AS by0, x1 AS bx1, y1 AS by1, confidence, forced, size FROM kinds WHERE role = 'det'),
cap AS (SELECT DISTINCT page, kind, name AS cname, x0 AS cx0, y0 AS cy0, x1 AS cx1, y1 AS cy1, confidence AS cconf FROM kinds WHERE role = 'cap')
"""


def kind_of(label: Column) -> Column:
    """table or figure, whatever the case of the label."""
    return F.when(F.lower(label) == "table", "table").otherwise("figure")


def region_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as the line items give them: a few are repeated."""
    x, y = F.col("l_partkey") % 12 * 10, F.col("l_suppkey") % 12 * 15
    label = F.when(F.col("l_linenumber") % 3 == 0, "Table").when(F.col("l_linenumber") % 3 == 1, "figure").otherwise("FIGURE")
    flag = F.col("l_returnflag")
    out = table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 3).cast("bigint").alias("page"), F.when(flag == "A", "old").when(flag == "N", "det").otherwise("cap").alias("role"), label.alias("label"),
        F.when(F.col("l_suppkey") % 3 == 0, "unnumbered").otherwise((F.col("l_suppkey") % 3).cast("string")).alias("name"),
        x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + F.col("l_quantity") * 6).alias("x1"), (y + F.col("l_quantity") * 5).alias("y1"),
        F.round(F.col("l_discount") * 8, 2).alias("confidence"), ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1)).alias("forced"),
        (6 + F.round(F.col("l_tax") * 60, 1)).alias("size"), (F.col("l_quantity") * 5).cast("bigint").alias("len"), (F.col("l_orderkey") % 4 * 90).cast("bigint").alias("rotation"),
    )
    return out.withColumn("kind", kind_of(F.col("label")))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hardly a row is repeated, so rows go to their pages at once: what follows works by page, without another shuffle."""
    return region_rows(spark, sf_dir).repartition("page").distinct()


def region_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Old regions (a), detections (b) and captions (c), with prefixed columns."""
    every = regions(spark, sf_dir)
    side = lambda role, p, *more: every.where(F.col("role") == role).select("page", "kind", *[F.col(c).alias(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")], *more).distinct()
    return side("old", "a", F.col("name").alias("aname")), side("det", "b", "confidence", "forced", "size"), side("cap", "c", F.col("name").alias("cname"), F.col("confidence").alias("cconf"))
