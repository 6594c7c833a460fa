"""Readers for paper records, manifests and whole-file JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .checked import fault, json_files, parsed, refused
from .tables import stored

_VALUE = "struct<value:int>"
#: One record a file. Reviews may carry optional text fields in other years, which this schema leaves out.
PAPER = f"""year int, package_id string, paper_id string, number int, title string, authors array<string>, primary_area string, keywords array<string>,
 forum_url string, venue string, status string, decision string, human_ratings array<int>, human_mean_rating double, human_reviews_scope string,
 human_reviews array<struct<review_id:string,forum:string,invitations:array<string>,tcdate:bigint,tmdate:bigint,
 content:struct<rating:{_VALUE},confidence:{_VALUE},soundness:{_VALUE},presentation:{_VALUE},contribution:{_VALUE}>>>,
 ai_reviews array<struct<round:int,response:struct<score:int,confidence:int,summary:string,strengths:array<string>,weaknesses:array<string>,score_rationale:string>>>"""


#: What a record must have to be of use.
REQUIRED = ["paper_id", "status", "ai_reviews"]


def checked_papers(spark: SparkSession, path: str) -> DataFrame:
    """file, record and violation of every file: broken ones, other types and missing fields are told, none is lost."""
    return json_files(spark, path, " ".join(PAPER.split()), REQUIRED)


def papers(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The records of all files. Raises if a file is refused; without strict, refused files are left to `checked_papers`."""
    rows = checked_papers(spark, path)
    if strict:
        refused(rows, "files", "file")
    return rows.where("violation is null").select("record.*").drop("_corrupt_record")


def ai_scores(df: DataFrame) -> DataFrame:
    """A row for each unit and round."""
    r = df.select("paper_id", "status", F.col("primary_area").alias("area"), F.col("human_mean_rating").alias("human_mean"), "year", F.explode("ai_reviews").alias("r"))
    return r.select("paper_id", "status", "area", "human_mean", "year", F.col("r.round").alias("round"), F.col("r.response.score").alias("score"), F.col("r.response.confidence").alias("confidence"))


def human_reviews(df: DataFrame) -> DataFrame:
    """A row for each review; ratings come from the reviews, never from the unaligned list beside them."""
    r = df.select("paper_id", F.explode("human_reviews").alias("r"))
    values = [F.col(f"r.content.{c}.value").alias(c) for c in ("rating", "confidence", "soundness", "presentation", "contribution")]
    return r.select("paper_id", F.col("r.review_id").alias("review_id"), F.timestamp_millis("r.tcdate").alias("created"), *values)


def author_list(c: Column) -> Column:
    """Authors from a JSON list or from text with semicolons; empty names go."""
    text = F.trim(c)
    parts = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.split(text, ";", -1))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda a: a != "")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text file that are not blank, with their number in file order (from 1). Lines are numbered within
    the blocks that tasks read, and shifted by the lines of the blocks before: one row a block is broadcast."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.regexp_replace("value", "^\ufeff", "").alias("line"), F.monotonically_increasing_id().alias("__i"))
    lines = lines.where(F.btrim("line", F.lit(" \t\r")) != "")
    inside = F.row_number().over(Window.partitionBy("__f", "__b").orderBy("__i"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(1)).orderBy("__f", "__b").rowsBetween(Window.unboundedPreceding, -1))
    blocks = lines.groupBy("__f", "__b").agg(F.count("*").alias("__n")).select("__f", "__b", F.coalesce(before, F.lit(0)).alias("__before"))
    return lines.withColumn("__in", inside).join(F.broadcast(blocks), ["__f", "__b"]).select((F.col("__before") + F.col("__in")).alias("number"), "line")


MANIFEST = "paper_id string, pdf_path string, authors string, package_id string"


def checked_manifest(spark: SparkSession, path: str, require_authors: bool = False) -> DataFrame:
    """number, package_id, paper_id, pdf_path, authors and violation of every line that is not blank: no JSON, no object, no
    path, a path that is no .pdf, a package id that is not that of its place, authors that are no list of names (or no
    `authors` at all, if they are required: an empty list says that there are none), an id that another line has too."""
    lines = numbered_lines(spark, path)
    record = parsed(F.col("line"), MANIFEST)
    package = F.format_string("paper_%03d", "number")
    rows = lines.withColumn("r", record).select("number", package.alias("package_id"), F.col("r.package_id").alias("given"), F.coalesce("r.paper_id", package).alias("paper_id"), "r.pdf_path", author_list(F.col("r.authors")).alias("authors"), F.col("r.authors").alias("__authors"), fault(F.col("r"), F.col("line"), ["pdf_path"]).alias("__fault"), F.array_contains(F.json_object_keys("line"), "authors").alias("__has"), F.try_parse_json("line").alias("__v"))
    kind = F.schema_of_variant(F.try_variant_get("__v", "$.authors", "variant"))
    named = kind.isNull() | (kind == "STRING") | (kind == "ARRAY<STRING>") | (kind == "ARRAY<VOID>")
    blank = (kind == "ARRAY<STRING>") & F.exists(F.from_json("__authors", "array<string>"), lambda a: F.coalesce(F.trim(a), F.lit("")) == "")
    fault_of = (
        F.when(F.col("__fault").isNotNull(), F.col("__fault")).when(~F.lower("pdf_path").endswith(".pdf"), "no .pdf").when(F.col("given") != F.col("package_id"), "package id is not that of its place")
        .when(~named | F.coalesce(blank, F.lit(False)), "authors are no names").when(F.lit(require_authors) & ~F.coalesce("__has", F.lit(False)), "no authors")
    )
    rows = rows.withColumn("violation", fault_of).select("number", "package_id", "paper_id", "pdf_path", F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), "violation")
    again = rows.where("violation is null").groupBy("paper_id").agg(F.count("*").alias("__n")).where("__n > 1")
    rows = rows.join(again, "paper_id", "left").withColumn("violation", F.coalesce("violation", F.when(F.col("__n") > 1, "paper id repeats")))
    return rows.select("number", "package_id", F.when(F.col("violation").isNull() | (F.col("violation") != "no JSON"), F.col("paper_id")).alias("paper_id"), "pdf_path", "authors", "violation")


def manifest(spark: SparkSession, path: str, require_authors: bool = False) -> DataFrame:
    """Manifest rows in file order with only the allowed columns; blank lines and a byte order mark are skipped. Raises if it
    is empty or a line is refused (see `checked_manifest`)."""
    rows = stored(checked_manifest(spark, path, require_authors), "manifest_rows")  # checked, tested and returned: one pass over the lines
    refused(rows, "lines", "number")
    if not rows.take(1):
        raise ValueError("the manifest is empty")
    return rows.select("package_id", "paper_id", "pdf_path", "authors")


def missing_files(rows: DataFrame, root: str, column: str = "pdf_path") -> DataFrame:
    """Rows whose file is not under root, by a listing and an anti join."""
    spark = rows.sparkSession
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.substring_index("path", root.rstrip("/") + "/", -1).alias("__there"))
    return rows.join(there, F.col(column) == F.col("__there"), "left_anti")
