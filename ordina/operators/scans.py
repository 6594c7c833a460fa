"""Readers and writers end to end: tables are written as the files that a source expects, and read back through it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources import papers, sinks
from ..sources.tables import shared_path, table
from .review import _FORMS, NOT_JSON, event_lines, session_log


@query(
    "manifest_scan",
    """SELECT printf('paper_%03d', row_number() OVER (ORDER BY o_orderkey)) AS package_id, 'p' || o_orderkey AS paper_id, o_orderkey || '.pdf' AS pdf_path,
 CASE WHEN o_orderkey % 2 = 0 THEN 'A ' || o_custkey || '|B' ELSE 'C|D ' || o_custkey END AS authors FROM orders""",
)
def manifest_scan(spark, d):
    """A manifest of JSON lines in order: authors as a list or as text with semicolons, labels dropped, places numbered."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    names = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('"A '), c, F.lit('; B;"'))).otherwise(F.concat(F.lit('["C","D '), c, F.lit('"]')))
    line = F.concat(F.lit('{"paper_id":"p'), k, F.lit('","pdf_path":"'), k, F.lit('.pdf","rating":3,"authors":'), names, F.lit("}"))
    path = shared_path(spark, "manifest")
    table(spark, d, "orders").orderBy("o_orderkey").select(line.alias("value")).write.text(path)
    return papers.manifest(spark, path, require_authors=True).withColumn("authors", F.array_join("authors", "|"))


@query(
    "paper_scan",
    """WITH r AS (SELECT n_nationkey AS k, n_name, unnest(range(1, 6)) AS round FROM nation)
 SELECT 'n' || k AS paper_id, n_name AS area, CAST(round AS BIGINT) AS round, CAST(1 + (k + round) % 10 AS BIGINT) AS score, CAST(1 + k % 5 AS BIGINT) AS confidence, CASE WHEN k % 3 = 0 THEN 'withdrawn' ELSE 'accepted' END AS status FROM r""",
)
def paper_scan(spark, d):
    """One record a file, over several lines; its rounds as rows."""
    k = F.col("n_nationkey")
    rounds = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct(i.alias("round"), F.struct((1 + (k + i) % 10).alias("score"), (1 + k % 5).alias("confidence"), F.array(F.lit("s")).alias("strengths")).alias("response")))
    record = F.struct(F.lit(2026).alias("year"), F.concat(F.lit("n"), k.cast("string")).alias("paper_id"), F.col("n_name").alias("primary_area"), F.when(k % 3 == 0, "withdrawn").otherwise("accepted").alias("status"), rounds.alias("ai_reviews"))
    path = shared_path(spark, "papers")
    table(spark, d, "nation").select(k.alias("k"), F.to_json(record, {"pretty": "true"}).alias("value")).write.partitionBy("k").text(path)
    scores = papers.ai_scores(papers.papers(spark, f"{path}/*/*.txt"))
    return scores.select("paper_id", "area", *[F.col(c).cast("bigint").alias(c) for c in ("round", "score", "confidence")], "status")


@query("event_file_scan", f"SELECT CASE WHEN event_id % 60 = 7 THEN '{NOT_JSON}' ELSE CASE event_type {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{m}{chr(39)}' for k, (m, _) in _FORMS.items())} END END AS method, count(*) AS n FROM events GROUP BY 1")
def event_file_scan(spark, d):
    """Events as files of JSON lines, broken lines among them; nothing is lost and nothing fails."""
    path = shared_path(spark, "lines")
    session_log(spark, d).select(F.col("line").alias("value")).write.text(path)
    return event_lines(spark, path).groupBy("method").agg(F.count("*").alias("n"))


@query("rows_written", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT c_custkey, 'again', c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def rows_written(spark, d):
    """Partitions that are written again replace themselves and nothing else."""
    path, customers = shared_path(spark, "rows"), table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    sinks.write_replaced(customers, path, ["c_mktsegment"])
    sinks.write_replaced(customers.where("c_mktsegment = 'BUILDING'").withColumn("c_name", F.lit("again")), path, ["c_mktsegment"])
    return spark.read.parquet(path).select("c_custkey", "c_name", "c_acctbal")


@query("status_summary", "SELECT coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'failed' WHEN c_custkey % 5 = 1 THEN NULL ELSE 'ok' END, 'unknown') AS status, count(*) AS n FROM customer GROUP BY 1")
def status_summary(spark, d):
    """What a run reports: rows by status, unknown for none."""
    k = F.col("c_custkey")
    return sinks.summary(table(spark, d, "customer").withColumn("status", F.when(k % 5 == 0, "failed").when(k % 5 != 1, "ok")))


@query(
    "manifest_faults",
    """SELECT CASE o_orderkey % 10 WHEN 1 THEN 'no JSON' WHEN 2 THEN 'no pdf_path' WHEN 3 THEN 'no .pdf' WHEN 4 THEN 'no authors' WHEN 5 THEN 'authors are no names' WHEN 6 THEN 'package id is not that of its place' WHEN 7 THEN 'no object' WHEN 9 THEN 'paper id repeats' ELSE 'none' END AS violation, count(*) AS n
 FROM orders WHERE o_orderkey % 10 <> 9 OR (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 9) > 1 GROUP BY 1""",
)
def manifest_faults(spark, d):
    """A manifest whose lines have a fault of every kind: each comes out with its violation, none is lost."""
    k = F.col("o_orderkey")
    last = k % 10
    record = lambda *parts: F.concat(F.lit("{"), F.concat_ws(",", *[p if not isinstance(p, str) else F.lit(p) for p in parts]), F.lit("}"))
    own = F.concat(F.lit('"paper_id":"p'), k.cast("string"), F.lit('"'))
    path = F.concat(F.lit('"pdf_path":"'), k.cast("string"), F.lit('.pdf"'))
    line = (
        F.when(last == 1, F.concat(F.lit("{oops "), own)).when(last == 2, record(own, '"authors":[]')).when(last == 3, record(own, '"pdf_path":"a.doc","authors":[]')).when(last == 4, record(own, path))
        .when(last == 5, record(own, path, '"authors":["A",3]')).when(last == 6, record(own, path, '"authors":"A;B","package_id":"paper_x"')).when(last == 7, F.lit("[1]")).when(last == 9, record('"paper_id":"same"', path, '"authors":["A"]'))
        .otherwise(record(own, path, '"authors":[],"rating":9'))
    )
    place = shared_path(spark, "manifest")
    table(spark, d, "orders").select(line.alias("value")).write.text(place)
    return papers.checked_manifest(spark, place, require_authors=True).groupBy(F.coalesce("violation", F.lit("none")).alias("violation")).agg(F.count("*").alias("n"))


@query(
    "paper_faults",
    """SELECT CASE n_nationkey % 6 WHEN 1 THEN 'no JSON' WHEN 2 THEN 'no status' WHEN 3 THEN 'unexpected type' WHEN 4 THEN 'no object' ELSE 'none' END AS violation, count(*) AS n, CAST(sum(CASE WHEN n_nationkey % 6 IN (0, 5) THEN n_nationkey ELSE 0 END) AS BIGINT) AS keys FROM nation GROUP BY 1""",
)
def paper_faults(spark, d):
    """Record files of which some are broken, have fields of other types, or lack what is needed."""
    k = F.col("n_nationkey")
    good = F.concat(F.lit('{"paper_id":"'), k.cast("string"), F.lit('",\n "status":"accepted", "ai_reviews":[{"round":1}]}'))
    text = F.when(k % 6 == 1, F.concat(good, F.lit("}{"))).when(k % 6 == 2, F.replace(good, F.lit("status"), F.lit("state"))).when(k % 6 == 3, F.replace(good, F.lit('"round":1'), F.lit('"round":"one"'))).when(k % 6 == 4, F.lit("[]")).otherwise(good)
    place = shared_path(spark, "papers")
    table(spark, d, "nation").select(k.alias("k"), text.alias("value")).write.partitionBy("k").text(place)
    rows = papers.checked_papers(spark, f"{place}/*/*.txt")
    key = F.when(F.col("violation").isNull(), F.col("record.paper_id").cast("bigint"))
    return rows.groupBy(F.coalesce("violation", F.lit("none")).alias("violation")).agg(F.count("*").alias("n"), F.coalesce(F.sum(key), F.lit(0)).alias("keys"))
