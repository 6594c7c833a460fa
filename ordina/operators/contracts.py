"""Contracts on responses, inputs and packages; quota gates; incremental work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import base64, upper
from ..functions.json_schema import schema_violations
from ..registry import query
from ..sources.tables import SEQUENCE_SQL, sequence, table


#: What an answer must be (fixed values of the contract): nothing may be missing or added.
_NOTES = {"type": "array", "items": {"type": "string"}, "maxItems": 3}
RESPONSE = {
    "type": "object", "additionalProperties": False, "required": ["score", "confidence", "summary", "strengths", "weaknesses", "score_rationale"],
    "properties": {"score": {"type": "integer", "minimum": 1, "maximum": 10}, "confidence": {"type": "integer", "minimum": 1, "maximum": 5}, "summary": {"type": "string"}, "strengths": _NOTES, "weaknesses": _NOTES, "score_rationale": {"type": "string"}},
}


@query(
    "response_contract",
    """SELECT event_id, concat_ws(',', CASE WHEN event_id % 4 = 2 THEN '$.confidence: type' END, CASE WHEN event_id % 11 = 3 THEN '$.rating: false' END, CASE WHEN event_id % 12 < 1 THEN '$.score: minimum' WHEN event_id % 12 > 10 THEN '$.score: maximum' END,
 CASE WHEN event_id % 7 > 3 THEN '$.strengths: maxItems' END, CASE WHEN event_id % 5 = 4 THEN '$.summary: required' END, CASE WHEN event_id % 9 = 1 THEN '$.weaknesses[1]: type' END) AS violations FROM events""",
)
def response_contract(spark, d):
    """Answers as JSON against the whole contract; the check is built-in expressions over a variant."""
    i = F.col("event_id")
    text = lambda c: c.cast("string")
    fields = [
        F.concat(F.lit('"score":'), text(i % 12)), F.concat(F.lit('"confidence":'), F.when(i % 4 == 2, "3.0").otherwise(text(i % 4 + 1))), F.when(i % 5 != 4, '"summary":"s"'),
        F.concat(F.lit('"strengths":['), F.array_join(F.array_repeat(F.lit('"a"'), (i % 7).cast("int")), ","), F.lit("]")), F.concat(F.lit('"weaknesses":["b"'), F.when(i % 9 == 1, ",7").otherwise(""), F.lit("]")),
        F.lit('"score_rationale":"r"'), F.when(i % 11 == 3, '"rating":1'),
    ]
    answer = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    return table(spark, d, "events").select("event_id", F.array_join(F.array_sort(schema_violations(answer, RESPONSE)), ",").alias("violations"))


#: Schema that event properties must meet.
PROPS = {"type": "object", "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 50}}, "required": ["k"], "additionalProperties": False}


@query(
    "json_schema_check",
    """SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 50 THEN '$.k: maximum' WHEN CAST(json_extract(props, '$.k') AS BIGINT) < 0 THEN '$.k: minimum' ELSE '' END AS violations FROM events""",
)
def json_schema_check(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(schema_violations(F.col("props"), PROPS), ",").alias("violations"))


@query(
    "forbidden_keys",
    """WITH j AS (SELECT doc_id, CASE WHEN toxic = 1 THEN '{"doc": 1, "rating": 2}' ELSE '{"doc": 1, "path": "x"}' END AS j FROM labels)
 SELECT doc_id, array_to_string(list_sort(json_keys(j)), ',') AS keys, list_has_any(json_keys(j), ['rating', 'reviews', 'decision']) AS forbidden FROM j""",
)
def forbidden_keys(spark, d):
    j = F.when(F.col("toxic") == 1, '{"doc": 1, "rating": 2}').otherwise('{"doc": 1, "path": "x"}')
    keys = F.json_object_keys(j)
    return table(spark, d, "labels").select("doc_id", F.array_join(F.array_sort(keys), ",").alias("keys"), F.arrays_overlap(keys, F.array(F.lit("rating"), F.lit("reviews"), F.lit("decision"))).alias("forbidden"))


def quota_decision(allowed: Column, used: Column) -> Column:
    """An explicit no stops; any use of 100 or more stops; nothing observed and not explicitly allowed stops. Null is not 0."""
    return F.when(allowed.eqNullSafe(F.lit(False)), "stop").when(used >= 100, "stop").when(used.isNull() & ~allowed.eqNullSafe(F.lit(True)), "stop").otherwise("pass")


@query(
    "quota_gate",
    """WITH q AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 2 THEN FALSE ELSE TRUE END AS allowed, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE abs(c_acctbal) / 80 END AS used FROM customer)
 SELECT c_custkey, CASE WHEN allowed IS NOT DISTINCT FROM FALSE THEN 'stop' WHEN used >= 100 THEN 'stop' WHEN used IS NULL AND allowed IS DISTINCT FROM TRUE THEN 'stop' ELSE 'pass' END AS decision FROM q""",
)
def quota_gate(spark, d):
    k = F.col("c_custkey")
    allowed = F.when(k % 4 == 0, None).when(k % 4 == 2, False).otherwise(True)
    used = F.when(k % 5 == 0, None).otherwise(F.abs("c_acctbal") / 80)
    return table(spark, d, "customer").select("c_custkey", quota_decision(allowed, used).alias("decision"))


def signature(df: DataFrame, key: str, position: str, parts: list[Column]) -> DataFrame:
    """A digest of the ordered parts of each key."""
    item = F.struct(F.col(position), F.concat_ws("\t", *parts).alias("p"))
    return df.groupBy(key).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["p"]), "\n"), 256).alias("signature"))


@query(
    "input_freeze",
    f"""WITH {SEQUENCE_SQL}, a AS (SELECT conv_id, sha256(string_agg(type || chr(9) || text, chr(10) ORDER BY turn)) AS s FROM items GROUP BY 1),
 b AS (SELECT conv_id, sha256(string_agg(type || chr(9) || CASE WHEN conv_id % 10 = 0 AND turn = 1 THEN upper(text) ELSE text END, chr(10) ORDER BY turn)) AS s FROM items GROUP BY 1)
 SELECT a.conv_id, a.s = b.s AS frozen FROM a JOIN b ON a.conv_id = b.conv_id""",
)
def input_freeze(spark, d):
    """The signature of a later round must equal that of the first."""
    items = sequence(spark, d)
    later = F.when((F.col("conv_id") % 10 == 0) & (F.col("turn") == 1), upper(F.col("text"))).otherwise(F.col("text"))
    a = signature(items, "conv_id", "turn", [F.col("type"), F.col("text")])
    b = signature(items, "conv_id", "turn", [F.col("type"), later]).withColumnRenamed("signature", "later")
    return a.join(b, "conv_id").select("conv_id", (F.col("signature") == F.col("later")).alias("frozen"))


@query(
    "echo_equality",
    f"""WITH {SEQUENCE_SQL}, s AS (SELECT conv_id, string_agg(type || ':' || length(text), ',' ORDER BY turn) AS sent, string_agg(type || ':' || length(text), ',' ORDER BY CASE WHEN conv_id % 7 = 0 THEN -turn ELSE turn END) AS seen FROM items GROUP BY 1)
 SELECT conv_id, sent = seen AS verified FROM s""",
)
def echo_equality(spark, d):
    """What came back must have the same types and lengths in the same order."""
    item = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.concat_ws(":", "type", F.length("text").cast("string")).alias("p")))), lambda i: i["p"]), ",")
    turned = F.when(F.col("conv_id") % 7 == 0, -F.col("turn")).otherwise(F.col("turn"))
    return sequence(spark, d).groupBy("conv_id").agg((item(F.col("turn")) == item(turned)).alias("verified"))


@query(
    "package_audit",
    f"""WITH {SEQUENCE_SQL}, w AS (SELECT conv_id, turn, type, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, lag(type) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM items)
 SELECT 'id_order' AS rule, conv_id AS key FROM w WHERE i <> turn UNION ALL SELECT 'empty_text', conv_id FROM items WHERE trim(text) = ''
 UNION ALL SELECT 'repeated_type', conv_id FROM w WHERE type = before UNION ALL SELECT 'ends_open', conv_id FROM (SELECT conv_id, max_by(type, turn) AS t FROM items GROUP BY 1) WHERE t = 'in'
 UNION ALL SELECT 'forbidden_word', conv_id FROM items WHERE regexp_matches(lower(text), '(^|[^a-z])(rating|decision|password)([^a-z]|$)')""",
)
def package_audit(spark, d):
    """Item by item, all rules in one pass: an array of those that an item violates."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rules = {
        "id_order": F.row_number().over(w) - 1 != F.col("turn"), "empty_text": F.trim("text") == "", "repeated_type": F.lag("type").over(w) == F.col("type"),
        "ends_open": F.lead("turn").over(w).isNull() & (F.col("type") == "in"), "forbidden_word": F.lower("text").rlike("(^|[^a-z])(rating|decision|password)([^a-z]|$)"),
    }
    flagged = sequence(spark, d).withColumn("rules", F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()])))
    return flagged.select(F.explode("rules").alias("rule"), F.col("conv_id").alias("key"))


@query(
    "incremental_skip",
    """WITH w AS (SELECT o_orderkey AS k, md5(o_orderpriority) AS config FROM orders), done AS (SELECT o_orderkey AS k, md5(CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE o_orderpriority END) AS config FROM orders WHERE o_orderstatus = 'F')
 SELECT k FROM w WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.k = w.k AND done.config = w.config)""",
)
def incremental_skip(spark, d):
    """Work that is done under the same configuration is skipped."""
    orders = table(spark, d, "orders")
    work = orders.select(F.col("o_orderkey").alias("k"), F.md5("o_orderpriority").alias("config"))
    done = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.md5(F.when(F.col("o_orderkey") % 3 == 0, "old").otherwise(F.col("o_orderpriority"))).alias("config"))
    return work.join(done, ["k", "config"], "left_anti").select("k")


@query("detection_status", "SELECT page_id, CASE WHEN n = 0 THEN 'failed' WHEN n < 6 THEN 'partial' ELSE 'ok' END AS status FROM (SELECT page_id, len(regexp_extract_all(html, '<a href')) AS n FROM pages)")
def detection_status(spark, d):
    n = F.size(F.regexp_extract_all("html", F.lit("<a href"), 0))
    return table(spark, d, "pages").select("page_id", F.when(n == 0, "failed").when(n < 6, "partial").otherwise("ok").alias("status"))


@query("failure_isolation", "SELECT c_custkey, try_cast(regexp_extract(c_name, '[0-9]+') AS BIGINT) AS number, try_cast(c_mktsegment AS BIGINT) IS NULL AS failed FROM customer")
def failure_isolation(spark, d):
    """A row that fails gives a null and a flag; the others go on."""
    number = F.regexp_extract("c_name", "[0-9]+", 0).try_cast("bigint")
    return table(spark, d, "customer").select("c_custkey", number.alias("number"), F.col("c_mktsegment").try_cast("bigint").isNull().alias("failed"))


@query(
    "job_export",
    f"""WITH {SEQUENCE_SQL} SELECT conv_id, count(*) + 1 AS items, sha256('Review this.') AS prompt_sha256,
 sha256('prompt:Review this.' || chr(10) || string_agg(type || ':' || text, chr(10) ORDER BY turn)) AS job_sha256 FROM items GROUP BY conv_id""",
)
def job_export(spark, d):
    """The prompt is an item of its own in front, never joined with the first text."""
    item = F.struct("turn", F.concat_ws(":", "type", "text").alias("p"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["p"]), "\n")
    job = F.concat(F.lit("prompt:Review this.\n"), body)
    return sequence(spark, d).groupBy("conv_id").agg((F.count("*") + 1).alias("items"), F.sha2(F.lit("Review this."), 256).alias("prompt_sha256"), F.sha2(job, 256).alias("job_sha256"))


@query("encoded_payload", "SELECT page_id, 'data:text/html;base64,' || base64(encode(url)) AS payload FROM pages")
def encoded_payload(spark, d):
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("data:text/html;base64,"), base64(F.encode("url", "utf-8"))).alias("payload"))


def safe_path(c: Column) -> Column:
    """A relative path that stays under its root: no leading slash and no step upwards."""
    return (c != "") & ~c.startswith("/") & ~F.regexp_like(c, F.lit(r"(^|/)\.\.(/|$)"))


@query(
    "safe_paths",
    r"""WITH p AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '/etc/x' WHEN 1 THEN 'a/../../b' WHEN 2 THEN '' WHEN 3 THEN 'a..b/c' ELSE 'figures/' || p_size END AS path FROM part)
 SELECT p_partkey, path <> '' AND NOT starts_with(path, '/') AND NOT regexp_matches(path, '(^|/)\.\.(/|$)') AS safe FROM p""",
)
def safe_paths(spark, d):
    n = F.col("p_size") % 5
    path = F.when(n == 0, "/etc/x").when(n == 1, "a/../../b").when(n == 2, "").when(n == 3, "a..b/c").otherwise(F.concat(F.lit("figures/"), F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", safe_path(path).alias("safe"))


@query("missing_output_fallback", "SELECT o_orderkey, count(l_orderkey) AS regions, CASE WHEN count(l_orderkey) = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN count(l_orderkey) = 0 THEN 'output_missing' ELSE '' END AS warning FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def missing_output_fallback(spark, d):
    """A unit without output is an empty result with a warning."""
    made = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    regions = F.coalesce("n", F.lit(0))
    return table(spark, d, "orders").select("o_orderkey").join(made, "o_orderkey", "left").select("o_orderkey", regions.alias("regions"), F.when(regions == 0, "failed").otherwise("ok").alias("status"), F.when(regions == 0, "output_missing").otherwise("").alias("warning"))


@query("frozen_protocol", f"WITH {SEQUENCE_SQL} SELECT conv_id, role = 'system' AND type = 'in' AS conforms FROM items WHERE turn = 0")
def frozen_protocol(spark, d):
    """The first item of a job must be the frozen one."""
    frozen = F.struct(F.lit("system").alias("role"), F.lit("in").alias("type"))
    return sequence(spark, d).where("turn = 0").select("conv_id", (F.struct("role", "type") == frozen).alias("conforms"))


@query("independent_sessions", "SELECT o_custkey, count(*) AS rounds, count(DISTINCT o_orderdate) AS threads, count(*) = count(DISTINCT o_orderdate) AS independent FROM orders GROUP BY 1")
def independent_sessions(spark, d):
    """Rounds are independent if no two share a thread."""
    threads = F.count_distinct("o_orderdate")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("rounds"), threads.alias("threads"), (F.count("*") == threads).alias("independent"))


@query(
    "job_shape",
    """SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') THEN 'unknown type' WHEN length(text) = 0 THEN 'empty' WHEN length(text) > 400 THEN 'too long' ELSE '' END AS violation FROM conversations""",
)
def job_shape(spark, d):
    violation = F.when(~F.col("role").isin("user", "assistant"), "unknown type").when(F.length("text") == 0, "empty").when(F.length("text") > 400, "too long").otherwise("")
    return sequence(spark, d).select("conv_id", "turn", violation.alias("violation"))
