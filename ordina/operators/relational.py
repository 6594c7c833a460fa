"""Manifests, projections, lookups, set operations and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranking import ordinals
from ..registry import query
from ..sources.tables import event_log, sequence, table

#: Lookup sides up to this many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000


def lookup(df: DataFrame, side: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins with a lookup side, which is broadcast only if its counted size allows it."""
    small = side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(side) if small else side, on, how)


@query("dense_manifest_ids", "SELECT o_orderkey, printf('paper_%03d', row_number() OVER (ORDER BY o_orderkey)) AS package_id FROM orders")
def dense_manifest_ids(spark, d):
    out = ordinals(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "i")
    return out.select("o_orderkey", F.format_string("paper_%03d", "i").alias("package_id"))


@query("allow_list_projection", "SELECT doc_id, lang, source FROM documents")
def allow_list_projection(spark, d):
    """Only allowed columns leave the reader: labels and texts are never read from the files."""
    return table(spark, d, "documents").select("doc_id", "lang", "source")


@query("prefix_limit", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25")
def prefix_limit(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(25)


@query("required_inner_join", "SELECT count(*) AS joined, CAST(count_if(c_custkey IS NULL) AS BIGINT) AS missing, count(DISTINCT c_mktsegment) AS segments FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def required_inner_join(spark, d):
    """Both sides are required: what is missing is counted, so that a caller can refuse it."""
    both = table(spark, d, "orders").select("o_custkey").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return both.agg(F.count("*").alias("joined"), F.count_if(F.col("c_custkey").isNull()).alias("missing"), F.count_distinct("c_mktsegment").alias("segments"))


@query("left_join_default", "SELECT d.doc_id, coalesce(l.q, -1) AS quality FROM documents d LEFT JOIN (SELECT doc_id, CAST(max(quality) AS BIGINT) AS q FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id")
def left_join_default(spark, d):
    known = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("bigint").alias("q"))
    return table(spark, d, "documents").select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("q", F.lit(-1)).alias("quality"))


@query("unmatched_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def unmatched_anti(spark, d):
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query(
    "id_set_equality",
    """SELECT count(*) AS ids, CAST(count_if(a.k IS NULL) AS BIGINT) AS only_right, CAST(count_if(b.k IS NULL) AS BIGINT) AS only_left
 FROM (SELECT DISTINCT o_orderkey AS k FROM orders) a FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) b ON a.k = b.k""",
)
def id_set_equality(spark, d):
    return set_difference(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sizes of the union and of both differences of two id sets: one shuffle, partial sums, no join."""
    both = left.select("k", F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select("k", F.lit(0), F.lit(1)))
    sides = both.groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.agg(F.count("*").alias("ids"), F.count_if(F.col("l") == 0).alias("only_right"), F.count_if(F.col("r") == 0).alias("only_left"))


@query("key_subset_semi", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
def key_subset_semi(spark, d):
    wanted = table(spark, d, "region").where(F.col("r_name").startswith("A")).select(F.col("r_regionkey").alias("n_regionkey"))
    return lookup(table(spark, d, "nation"), wanted, ["n_regionkey"], "left_semi").select("n_nationkey", "n_name")


@query(
    "override_merge",
    """WITH base AS (SELECT p_partkey AS k, p_brand AS v FROM part), removed AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'),
 added AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F')
 SELECT k, v FROM base WHERE k NOT IN (SELECT k FROM removed) UNION ALL SELECT k, 'corrected' FROM added""",
)
def override_merge(spark, d):
    base = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("v"))
    gone = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k"), "l_linestatus")
    return base.join(gone.select("k"), "k", "left_anti").unionByName(gone.where("l_linestatus = 'F'").select("k").distinct().withColumn("v", F.lit("corrected")))


@query(
    "composite_decisions",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_size > 40 THEN 'drop' WHEN p_size < 5 THEN 'keep' ELSE 'undecided' END AS decision, count(*) AS n
 FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
)
def composite_decisions(spark, d):
    decision = F.when(F.col("p_size") > 40, "drop").when(F.col("p_size") < 5, "keep").otherwise("undecided")
    both = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey", "left")
    return both.groupBy("l_orderkey", "l_linenumber", "l_partkey", decision.alias("decision")).agg(F.count("*").alias("n"))


@query("reclassify_override", "SELECT p_partkey, CASE WHEN p_size > 45 THEN NULL WHEN p_type LIKE '%BRASS%' THEN 'table' ELSE 'figure' END AS kind FROM part WHERE p_size <= 45 OR p_type LIKE '%BRASS%'")
def reclassify_override(spark, d):
    brass, large = F.col("p_type").contains("BRASS"), F.col("p_size") > 45
    kind = F.when(large, None).when(brass, "table").otherwise("figure")
    return table(spark, d, "part").where(~large | brass).select("p_partkey", kind.alias("kind"))


_LINK = r"""href="([^"]*)\""""


@query(
    "own_link_semi",
    """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS uri FROM pages), own AS (SELECT uri FROM l GROUP BY uri HAVING count(DISTINCT page_id) >= 5)
 SELECT page_id, uri, count(*) AS n FROM l WHERE uri IN (SELECT uri FROM own) OR uri LIKE 'mailto:%' GROUP BY page_id, uri""",
)
def own_link_semi(spark, d):
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("uri")).groupBy("page_id", "uri").agg(F.count("*").alias("n"))
    own = links.groupBy("uri").agg(F.count("*").alias("pages")).where("pages >= 5").select("uri", F.lit(True).alias("own"))
    return links.join(own, "uri", "left").where(F.col("own") | F.col("uri").startswith("mailto:")).select("page_id", "uri", "n")


@query(
    "replacement_integrity",
    """SELECT a.doc_id AS dropped, CASE WHEN b.doc_id IS NULL THEN 'missing' ELSE 'not kept' END AS violation
 FROM labels a LEFT JOIN labels b ON b.doc_id = a.doc_id + 1 WHERE a.quality = 0 AND (b.doc_id IS NULL OR b.quality = 0)""",
)
def replacement_integrity(spark, d):
    """A dropped row names its replacement (here the next id), which must exist and be kept."""
    labels = table(spark, d, "labels")
    other = labels.select((F.col("doc_id") - 1).alias("doc_id"), F.col("quality").alias("other"), F.lit(True).alias("there"))
    both = labels.where("quality = 0").join(other, "doc_id", "left").where("there is null or other = 0")
    return both.select(F.col("doc_id").alias("dropped"), F.when(F.col("there").isNull(), "missing").otherwise("not kept").alias("violation"))


@query(
    "counter_map_sum",
    """WITH c AS (SELECT user_id, event_type, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END * count(*) AS n FROM events GROUP BY user_id, event_type)
 SELECT event_type AS kind, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY event_type HAVING sum(n) > 0""",
)
def counter_map_sum(spark, d):
    """Maps of counts, one a session, are added up; counts that end at zero or below are not in the sum."""
    kind = F.col("method")
    counts = event_log(spark, d).groupBy("session", "method").agg(F.count("*").alias("n")).withColumn("n", F.when(kind == "error", -F.col("n")).otherwise(F.col("n")))
    maps = counts.groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("method", "n"))).alias("counts"))  # one entry a method
    return map_sum(maps, "counts")


def map_sum(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(column).alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("n")).where("n > 0")


@query("nested_class_counts", "SELECT source, lang, count(*) AS n, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents GROUP BY source, lang")
def nested_class_counts(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", "\n", -1))).alias("lines"))


@query("status_counts_default", "SELECT coalesce(CASE WHEN toxic = 1 THEN 'toxic' END, 'unknown') AS status, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def status_counts_default(spark, d):
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return both.groupBy(F.coalesce(F.when(F.col("toxic") == 1, "toxic"), F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


@query("first_occurrence_dedup", "SELECT min(doc_id) AS doc_id, md5(text) AS digest, count(*) AS copies FROM documents GROUP BY text")
def first_occurrence_dedup(spark, d):
    """The first of equal texts. Grouping is by digest, so only digests are shuffled, and partial minima come first."""
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("uniqueness_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def uniqueness_violations(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("monotonic_violations", "SELECT session, event_id FROM (SELECT user_id AS session, event_id, value < lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bad FROM events) WHERE bad")
def monotonic_violations(spark, d):
    before = F.lag("value").over(Window.partitionBy("session").orderBy("ts", "event_id"))
    return event_log(spark, d).withColumn("bad", F.col("value") < before).where("bad").select("session", "event_id")


@query("contiguity_violations", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE NOT (conv_id % 10 = 4 AND turn = 1)) WHERE i <> turn")
def contiguity_violations(spark, d):
    """Parts whose number is not their place (in some conversations the second part is missing)."""
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return sequence(spark, d).where("not (conv_id % 10 = 4 and turn = 1)").withColumn("i", i).where("i != turn").select("conv_id", "turn")


@query(
    "run_totals",
    "SELECT count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(count_if(n_chars = 0) AS BIGINT) AS empty, CAST(max(n_chars) AS BIGINT) AS longest, count(DISTINCT source) AS sources FROM documents",
)
def run_totals(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") == 0).alias("empty"), F.max("n_chars").alias("longest"), F.count_distinct("source").alias("sources"))


@query("global_pass_flag", "SELECT bool_and(l_quantity > 0 AND l_discount BETWEEN 0 AND 1) AS passed, CAST(count_if(l_discount > 0.1) AS BIGINT) AS failures FROM lineitem")
def global_pass_flag(spark, d):
    return table(spark, d, "lineitem").agg(F.bool_and((F.col("l_quantity") > 0) & F.col("l_discount").between(0, 1)).alias("passed"), F.count_if(F.col("l_discount") > 0.1).alias("failures"))


@query("warnings_by_unit", "SELECT l_orderkey AS unit, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS warnings FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def warnings_by_unit(spark, d):
    """Only units with a warning appear; a unit's warnings are few kinds, so the list is bounded."""
    bad = table(spark, d, "lineitem").where("l_returnflag != 'N'")
    return bad.groupBy(F.col("l_orderkey").alias("unit")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("warnings"))


@query("set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)")
def set_operations(spark, d):
    c, s, o = (table(spark, d, t) for t in ("customer", "supplier", "orders"))
    count = lambda op, df: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    ids = c.select("c_custkey"), o.select(F.col("o_custkey").alias("c_custkey"))
    return count("union", c.select("c_nationkey").union(s.select("s_nationkey")).distinct()).union(count("except", ids[0].subtract(ids[1]))).union(count("intersect", ids[0].intersect(ids[1])))


@query("orphans", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def orphans(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("map_right_wins", "SELECT l_orderkey AS k, max_by(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS v FROM lineitem GROUP BY 1")
def map_right_wins(spark, d):
    """Entries of one key in order: the last wins."""
    last = F.max_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(last.alias("v"))
