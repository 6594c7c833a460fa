"""Packages of ordered parts: pointers, assets, audits, jobs, protocols, paths and canonical JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import base64
from ..registry import query
from ..sources.checked import fault, parsed
from ..sources.tables import table
from .sequences import escaped, escaped_sql, ordered_text

# Conversations as packages: turns are parts; some packages have one fault each, told by their number.
PARTS_SQL = """
parts AS (
  SELECT conv_id AS package, turn AS place, CASE role WHEN 'assistant' THEN 'text' WHEN 'system' THEN 'page_marker' ELSE 'image' END AS type, text,
         turn + CASE WHEN conv_id % 13 = 5 AND turn = 1 THEN 7 ELSE 0 END AS record, CAST(floor(turn / 2) AS BIGINT) + CASE WHEN conv_id % 17 = 3 AND turn = 0 THEN 5 ELSE 0 END AS page,
         CASE WHEN conv_id % 9 = 4 AND turn = 0 THEN 'changed' ELSE text END AS stored,
         CASE conv_id % 19 WHEN 1 THEN '../' WHEN 2 THEN 'figures/x/../' ELSE 'figures/' END || 'page_' || turn || '.png' AS path,
         CASE WHEN conv_id % 23 = 2 THEN 'rating' WHEN conv_id % 23 = 7 THEN 'decision' ELSE 'title' END AS key,
         length(text) + CASE WHEN conv_id % 29 = 6 THEN 3 ELSE 0 END AS represented, CASE WHEN conv_id % 31 = 8 THEN 2 ELSE 1 END AS version
  FROM conversations)
"""


def parts(spark: SparkSession, d: str) -> DataFrame:
    c, t, role = F.col("conv_id"), F.col("turn"), F.col("role")
    fault = lambda cond, value, other: F.when(cond, value).otherwise(other)
    folder = F.when(c % 19 == 1, "../").when(c % 19 == 2, "figures/x/../").otherwise("figures/")
    return table(spark, d, "conversations").select(
        c.alias("package"), t.alias("place"), F.when(role == "assistant", "text").when(role == "system", "page_marker").otherwise("image").alias("type"), "text",
        (t + fault((c % 13 == 5) & (t == 1), 7, 0)).alias("record"), (F.floor(t / 2).cast("bigint") + fault((c % 17 == 3) & (t == 0), 5, 0)).alias("page"),
        fault((c % 9 == 4) & (t == 0), F.lit("changed"), F.col("text")).alias("stored"), F.concat(folder, F.lit("page_"), t.cast("string"), F.lit(".png")).alias("path"),
        F.when(c % 23 == 2, "rating").when(c % 23 == 7, "decision").otherwise("title").alias("key"), (F.length("text") + fault(c % 29 == 6, 3, 0)).alias("represented"), fault(c % 31 == 8, 2, 1).alias("version"),
    )


def followed(pointers: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Pointers with the record that each names; `missing` where there is none."""
    return pointers.join(records.withColumn("__there", F.lit(True)), keys, "left").withColumn("missing", F.col("__there").isNull()).drop("__there")


@query(
    "pointer_join",
    f"""WITH {PARTS_SQL}, f AS (SELECT a.package, a.place, a.type, b.text, b.text IS NULL AS missing FROM parts a LEFT JOIN (SELECT package, place, text FROM parts) b ON a.package = b.package AND a.record = b.place),
 n AS (SELECT *, CASE WHEN type = lag(type) OVER (PARTITION BY package ORDER BY place) THEN 0 ELSE 1 END AS new FROM f), i AS (SELECT *, sum(new) OVER (PARTITION BY package ORDER BY place) AS island FROM n)
 SELECT package, CAST(island AS BIGINT) AS island, type, count(*) AS parts, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY place), '')) AS digest, CAST(count_if(missing) AS BIGINT) AS missing FROM i GROUP BY package, island, type""",
)
def pointer_join(spark, d):
    """Parts name records by number; neighbours of one type are joined, and pointers to nothing are counted."""
    every = parts(spark, d)
    found = followed(every.select("package", "place", "type", "record"), every.select("package", F.col("place").alias("record"), "text"), ["package", "record"])
    w = Window.partitionBy("package").orderBy("place")
    new = F.when(F.lag("type").over(w).eqNullSafe(F.col("type")) & F.lag("type").over(w).isNotNull(), 0).otherwise(1)
    islands = found.withColumn("new", new).withColumn("island", F.sum("new").over(w)).groupBy("package", "island", "type")
    text = ordered_text(F.filter(F.collect_list(F.struct(F.col("place").alias("at"), "text")), lambda i: i["text"].isNotNull()), "\n\n")
    return islands.agg(F.count("*").alias("parts"), F.md5(text).alias("digest"), F.count_if("missing").alias("missing"))


@query("asset_checks", f"WITH {PARTS_SQL} SELECT package, place, sha256(text) AS expected, sha256(stored) AS found FROM parts WHERE type = 'image' AND sha256(text) <> sha256(stored)")
def asset_checks(spark, d):
    """Assets whose content is not what the package's index says."""
    return mismatched(parts(spark, d).where("type = 'image'").withColumn("expected", F.sha2("text", 256)), "expected", F.sha2("stored", 256)).select("package", "place", "expected", "found")


def mismatched(df: DataFrame, expected: str, found: Column) -> DataFrame:
    """Rows whose found value is not the expected one; one that is missing on either side is none."""
    return df.withColumn("found", found).where(~F.col(expected).eqNullSafe(F.col("found")) | F.col(expected).isNull())


def resolved(path: Column) -> Column:
    """A relative POSIX path without `.` and `..` steps, null if it leads above its root or is absolute."""
    start = F.array().cast("array<string>")
    step = lambda acc, s: F.when((s == "") | (s == "."), acc).when((s != "..") | (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) == ".."), F.concat(acc, F.array(s))).otherwise(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
    steps = F.aggregate(F.split(path, "/", -1), start, step)
    return F.when(path.startswith("/") | F.array_contains(steps, "..") | (F.size(steps) == 0), F.lit(None)).otherwise(F.array_join(steps, "/"))


@query(
    "resolved_paths",
    """WITH p AS (SELECT p_partkey, p_size % 7 AS k, p_size FROM part)
 SELECT p_partkey, CASE k WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'a..b/c' WHEN 4 THEN 'b' WHEN 5 THEN NULL ELSE 'figures/' || p_size END AS path FROM p""",
)
def resolved_paths(spark, d):
    """Paths that stay under their root, as they resolve; `a/../b` does."""
    k = F.col("p_size") % 7
    own = F.when(k == 0, "/etc/x").when(k == 1, "a/../../b").when(k == 2, "").when(k == 3, "./a..b//c").when(k == 4, "a/../b").when(k == 5, "x/..").otherwise(F.concat(F.lit("figures/"), F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", resolved(own).alias("path"))


def relative(path: Column, base: Column) -> Column:
    """The POSIX path from folder `base` to `path` (both resolved, from one root)."""
    a, b = (F.filter(F.split(c, "/", -1), lambda s: s != "") for c in (path, base))
    same = F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(b))), F.slice(b, 1, F.least(F.size(a), F.size(b))), lambda x, y: x == y)
    n = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same))
    up = F.array_repeat(F.lit(".."), (F.size(b) - n).cast("int"))
    return F.coalesce(F.nullif(F.array_join(F.concat(up, F.slice(a, (n + 1).cast("int"), F.size(a))), "/"), F.lit("")), F.lit("."))


@query("relative_paths", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '../figures/' || p_size || '.png' WHEN 1 THEN 'x.png' WHEN 2 THEN '.' ELSE '../../other/' || p_size END AS path FROM part")
def relative_paths(spark, d):
    k, size = F.col("p_size") % 4, F.col("p_size").cast("string")
    own = F.when(k == 0, F.concat(F.lit("run/figures/"), size, F.lit(".png"))).when(k == 1, "run/jobs/x.png").when(k == 2, "run/jobs").otherwise(F.concat(F.lit("other/"), size))
    return table(spark, d, "part").select("p_partkey", relative(own, F.lit("run/jobs")).alias("path"))


#: Index keys that would tell a reviewer the outcome (fixed values).
FORBIDDEN = ("ratings", "rating", "reviews", "decision", "authors_original", "pdf_path", "paper_id")
_RULE_SQL = {
    "record_order": "bool_or(record <> place)", "page_order": "bool_or(coalesce(page < before, FALSE))", "asset_hash": "bool_or(type = 'image' AND text <> stored)", "asset_path": "bool_or(type = 'image' AND starts_with(path, '..'))",
    "asset_name": "bool_or(type = 'image' AND NOT contains(path, 'page_'))", "forbidden_key": f"bool_or(key IN ({', '.join(f'{chr(39)}{k}{chr(39)}' for k in FORBIDDEN)}))",
    "coverage": "sum(represented) <> sum(length(text))", "schema": "max(version) <> 1", "empty_text": "bool_or(trim(text) = '')", "no_text": "count_if(type = 'text') = 0",
    "page_markers": "count_if(type = 'page_marker') <> 1", "first_part": "bool_or(place = 0 AND type = 'text')", "duplicate_path": "count(DISTINCT path) <> count(*)",
}


@query(
    "package_rules",
    f"""WITH {PARTS_SQL}, w AS (SELECT *, lag(page) OVER (PARTITION BY package ORDER BY place) AS before FROM parts),
 r AS (SELECT package, [{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _RULE_SQL.items())}] AS rules FROM w GROUP BY package)
 SELECT package, rule FROM (SELECT package, unnest(rules) AS rule FROM r) WHERE rule IS NOT NULL""",
)
def package_rules(spark, d):
    """All rules of an audit in one pass: flags by package, and a row for each that is violated."""
    rows = parts(spark, d).withColumn("before", F.lag("page").over(Window.partitionBy("package").orderBy("place")))
    image, c = F.col("type") == "image", F.col
    rules = {
        "record_order": F.bool_or(c("record") != c("place")), "page_order": F.bool_or(F.coalesce(c("page") < c("before"), F.lit(False))), "asset_hash": F.bool_or(image & (c("text") != c("stored"))),
        "asset_path": F.bool_or(image & resolved(c("path")).isNull()), "asset_name": F.bool_or(image & ~c("path").contains("page_")), "forbidden_key": F.bool_or(c("key").isin(*FORBIDDEN)),
        "coverage": F.sum("represented") != F.sum(F.length("text")), "schema": F.max("version") != 1, "empty_text": F.bool_or(F.trim("text") == ""), "no_text": F.count_if(c("type") == "text") == 0,
        "page_markers": F.count_if(c("type") == "page_marker") != 1, "first_part": F.bool_or((c("place") == 0) & (c("type") == "text")), "duplicate_path": F.count_distinct("path") != F.count("*"),
    }
    return violated(rows, ["package"], rules)


def violated(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, rule) for each rule, an aggregate condition, that holds for a group: one aggregation for all of them."""
    flags = rows.groupBy(*keys).agg(*[F.coalesce(r, F.lit(False)).alias(f"__{n}") for n, r in rules.items()])
    return flags.select(*keys, F.explode(F.array_compact(F.array(*[F.when(F.col(f"__{n}"), n) for n in rules]))).alias("rule"))


@query(
    "preview_with_images",
    f"""WITH {PARTS_SQL} SELECT package, md5(string_agg(CASE WHEN type = 'image' THEN '<img src="' || {escaped_sql('path')} || '">' ELSE '<pre>' || {escaped_sql('text')} || '</pre>' END, chr(10) ORDER BY place)) AS digest FROM parts GROUP BY package""",
)
def preview_with_images(spark, d):
    """The ordered parts as markup: texts in <pre>, images by their path."""
    item = F.when(F.col("type") == "image", F.concat(F.lit('<img src="'), escaped(F.col("path")), F.lit('">'))).otherwise(F.concat(F.lit("<pre>"), escaped(F.col("text")), F.lit("</pre>")))
    html = ordered_text(F.collect_list(F.struct(F.col("place").alias("at"), item.alias("text"))), "\n")
    return parts(spark, d).groupBy("package").agg(F.md5(html).alias("digest"))


PROMPT = "Review this."


def job(items: Column, prompt: str = PROMPT) -> Column:
    """A job as canonical JSON (keys in order): the prompt is an item of its own in front, its digest beside the items."""
    first = F.struct(F.lit(None).cast("string").alias("path"), F.lit(prompt).alias("text"), F.lit("text").alias("type"))
    return F.to_json(F.struct(F.concat(F.array(first), items).alias("input"), F.sha2(F.lit(prompt), 256).alias("prompt_sha256")))


@query(
    "job_json",
    f"""WITH {PARTS_SQL}, j AS (SELECT package, string_agg(CASE WHEN type = 'image' THEN '{{"path":' || to_json('../' || path) || ',"type":"localImage"}}' ELSE '{{"text":' || to_json(text) || ',"type":"text"}}' END, ',' ORDER BY place) AS items, count(*) AS n FROM parts GROUP BY package)
 SELECT package, n + 1 AS items, md5('{{"input":[{{"text":"{PROMPT}","type":"text"}},' || items || '],"prompt_sha256":"' || sha256('{PROMPT}') || '"}}') AS digest FROM j""",
)
def job_json(spark, d):
    """A package as the JSON job that a reviewer gets, images by their path from the job's folder."""
    image = F.col("type") == "image"
    item = F.struct("place", F.struct(F.when(image, F.concat(F.lit("../"), "path")).alias("path"), F.when(~image, F.col("text")).alias("text"), F.when(image, "localImage").otherwise("text").alias("type")).alias("item"))
    items = F.transform(F.array_sort(F.collect_list(item)), lambda i: i["item"])
    return parts(spark, d).groupBy("package").agg((F.count("*") + 1).alias("items"), F.md5(job(items)).alias("digest"))


@F.pandas_udf(T.StringType())
def canonical(texts: pd.Series) -> pd.Series:
    """Any JSON value with the keys of all its objects in order and no spaces: numbers, text and booleans stay what they are;
    of a key that repeats the last value counts. Null for what is no JSON (NaN and infinities are none)."""

    def of(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t, parse_constant=_no_number), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    return pd.Series([of(t) for t in texts], dtype=object)


def _no_number(name: str):
    raise ValueError(name)


@query(
    "canonical_nested",
    """SELECT o_orderkey, sha256('{"a":[{"x":' || CASE WHEN o_orderkey % 3 = 0 THEN '"' || o_custkey || '"' ELSE CAST(o_custkey AS VARCHAR) || CASE WHEN o_orderkey % 3 = 1 THEN '.0' ELSE '' END END || ',"y":null},true],"b":{"z":{},"é":"' || o_orderstatus || '"}}') AS digest FROM orders""",
)
def canonical_nested(spark, d):
    """Nested objects in any order have one form; a number, a number with a point and a text of the same digits have three."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    x = F.when(k % 3 == 0, F.concat(F.lit('"x": "'), c, F.lit('"'))).when(k % 3 == 1, F.concat(F.lit('"x":'), c, F.lit(".0"))).otherwise(F.concat(F.lit('"x":'), c))
    y, e, z = F.lit('"y" : null'), F.concat(F.lit('"é":"'), "o_orderstatus", F.lit('"')), F.lit('"z":{}')
    even = k % 2 == 0
    pair = lambda a, b: F.when(even, F.concat_ws(",", a, b)).otherwise(F.concat_ws(" , ", b, a))
    a, b = F.concat(F.lit('"a":[{'), pair(x, y), F.lit("},\ttrue]")), F.concat(F.lit('"b":{'), pair(z, e), F.lit("}"))
    return table(spark, d, "orders").select("o_orderkey", F.sha2(canonical(F.concat(F.lit("{"), pair(b, a), F.lit("}"))), 256).alias("digest"))


@query("canonical_json", """SELECT event_id, sha256('{"a":"' || event_type || '","k":"' || CAST(json_extract(props, '$.k') AS VARCHAR) || '","z":"' || user_id || '"}') AS digest FROM events""")
def canonical_json(spark, d):
    """Objects that differ in the order of their keys have one digest."""
    k = F.get_json_object("props", "$.k")
    field = lambda n, v: F.concat(F.lit(f'"{n}":"'), v, F.lit('"'))
    a, b, z = field("a", F.col("event_type")), field("k", k), field("z", F.col("user_id").cast("string"))
    text = F.concat(F.lit("{"), F.when(F.col("event_id") % 2 == 0, F.concat_ws(",", z, a, b)).otherwise(F.concat_ws(", ", b, z, a)), F.lit("}"))
    return table(spark, d, "events").select("event_id", F.sha2(canonical(text), 256).alias("digest"))


_ITEM_FIELDS = {"text": ("type", "text", "text_elements"), "localImage": ("type", "path", "detail")}


def item_violation(item: Column) -> Column:
    """What is wrong with a job's item (JSON text), null if nothing: its type, a field that its type does not have, or the
    type of its main field."""
    kind = F.get_json_object(item, "$.type")
    parsed = F.try_parse_json(item)
    is_string = lambda path: F.schema_of_variant(F.try_variant_get(parsed, path, "variant")) == "STRING"
    extra = lambda t: F.size(F.array_except(F.json_object_keys(item), F.array(*[F.lit(f) for f in _ITEM_FIELDS[t]]))) > 0
    by_type = F.when(~kind.isin(*_ITEM_FIELDS) | kind.isNull(), "unsupported type")
    for t, main in (("text", "$.text"), ("localImage", "$.path")):
        by_type = by_type.when((kind == t) & ~F.coalesce(is_string(main), F.lit(False)), f"no {main[2:]}").when((kind == t) & extra(t), f"unsupported {t} fields")
    return F.when(parsed.isNull(), "no object").otherwise(by_type)


@query(
    "job_items",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'unsupported text fields' WHEN 2 THEN NULL WHEN 3 THEN 'unsupported localImage fields' WHEN 4 THEN 'unsupported type' WHEN 5 THEN 'no text' WHEN 6 THEN 'no object' ELSE 'unsupported type' END AS violation FROM events""",
)
def job_items(spark, d):
    forms = ['{"type":"text","text":"a"}', '{"type":"text","text":"a","role":"x"}', '{"type":"localImage","path":"p.png","detail":"high"}', '{"type":"localImage","path":"p.png","url":"u"}', '{"type":"audio"}', '{"type":"text","text":7}', "{oops", '{"text":"a"}']
    item = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", item_violation(item).alias("violation"))


#: What a job's settings must be.
FROZEN = {"model": "m-1", "reasoning": "high", "system_prompt": "Read.", "developer_prompt": "Read.", "first": PROMPT}


def departures(columns: dict[str, Column], frozen: dict[str, str] = FROZEN) -> Column:
    """Names of the settings that are not the frozen ones, in order; null is a departure."""
    return F.array_join(F.array_compact(F.array(*[F.when(~columns[n].eqNullSafe(F.lit(v)), n) for n, v in frozen.items()])), ",")


@query("protocol_departures", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 11 = 0 THEN 'model' END, CASE WHEN o_orderkey % 7 = 0 THEN 'reasoning' END, CASE WHEN o_orderkey % 5 = 1 THEN 'system_prompt' END, CASE WHEN o_orderstatus = 'P' THEN 'first' END) AS departures FROM orders")
def protocol_departures(spark, d):
    k = F.col("o_orderkey")
    own = {"model": F.when(k % 11 == 0, "m-2").otherwise("m-1"), "reasoning": F.when(k % 7 != 0, "high"), "system_prompt": F.when(k % 5 == 1, "Skim.").otherwise("Read."), "developer_prompt": F.lit("Read."), "first": F.when(F.col("o_orderstatus") == "P", "Hi").otherwise(PROMPT)}
    return table(spark, d, "orders").select("o_orderkey", departures(own).alias("departures"))


_WINDOW = "struct<usedPercent:double>"
LIMITS = f"ordinaryUsageAllowed boolean, rateLimits struct<primary:{_WINDOW},secondary:{_WINDOW}>, rateLimitsByLimitId map<string,struct<primary:{_WINDOW},secondary:{_WINDOW}>>"


def quota_of(limits: Column, bucket: str = "codex") -> Column:
    """stop or pass for a struct of limits: an explicit no stops; of the named bucket, or of the general one if that is
    missing or empty, a window used up stops; so does nothing observed without an explicit yes."""
    named = limits["rateLimitsByLimitId"][bucket]
    empty = named["primary"].isNull() & named["secondary"].isNull()
    used = [F.when(empty, limits["rateLimits"][w]["usedPercent"]).otherwise(named[w]["usedPercent"]) for w in ("primary", "secondary")]
    most = F.greatest(*used)  # nulls are passed over
    allowed = limits["ordinaryUsageAllowed"]
    return F.when(allowed.eqNullSafe(F.lit(False)) | (most >= 100) | (most.isNull() & ~allowed.eqNullSafe(F.lit(True))), "stop").otherwise("pass")


@query(
    "quota_buckets",
    """WITH q AS (SELECT c_custkey AS k, c_custkey % 3 AS a, floor(abs(c_acctbal) / 80) AS used, c_custkey % 4 AS b FROM customer), u AS (SELECT *, CASE b WHEN 0 THEN used WHEN 1 THEN 5 WHEN 2 THEN used END AS seen FROM q)
 SELECT k AS c_custkey, CASE WHEN a = 0 THEN 'stop' WHEN seen >= 100 THEN 'stop' WHEN seen IS NULL AND a = 2 THEN 'stop' ELSE 'pass' END AS decision FROM u""",
)
def quota_buckets(spark, d):
    """Limits as JSON: the named bucket counts if it is there and not empty, else the general one."""
    k, used = F.col("c_custkey"), F.floor(F.abs("c_acctbal") / 80).cast("string")
    window = lambda name, v: F.concat(F.lit(f'"{name}":{{"usedPercent":'), v, F.lit("}"))
    general = lambda v: F.concat(F.lit('"rateLimits":{'), window("primary", v), F.lit("}"))
    other = F.lit('"rateLimitsByLimitId":{"codex":{},"other":{"primary":{"usedPercent":100}}}')
    body = F.when(k % 4 == 0, F.concat_ws(",", general(used), other)).when(k % 4 == 1, F.concat_ws(",", general(F.lit("100")), F.concat(F.lit('"rateLimitsByLimitId":{"codex":{'), window("secondary", F.lit("5")), F.lit("}}")))).when(k % 4 == 2, general(used)).otherwise(other)
    allowed = F.when(k % 3 == 0, '"ordinaryUsageAllowed":false').when(k % 3 == 1, '"ordinaryUsageAllowed":true')
    text = F.concat(F.lit("{"), F.concat_ws(",", allowed, body), F.lit("}"))
    return table(spark, d, "customer").select("c_custkey", quota_of(F.from_json(text, LIMITS)).alias("decision"))


@query(
    "independence_rules",
    """WITH s AS (SELECT o_custkey AS job, o_orderkey AS round, o_orderdate AS thread, o_orderkey % 10 <> 0 AS ephemeral, CASE WHEN o_orderkey % 15 = 0 THEN 'p' END AS parent, o_orderkey % 20 = 0 AS turned FROM orders)
 SELECT job, rule FROM (SELECT job, unnest([CASE WHEN bool_or(NOT ephemeral) THEN 'persistent' END, CASE WHEN count(parent) > 0 THEN 'parent' END, CASE WHEN bool_or(turned) THEN 'turns' END, CASE WHEN count(DISTINCT thread) <> count(*) THEN 'shared_thread' END]) AS rule FROM s GROUP BY job) WHERE rule IS NOT NULL""",
)
def independence_rules(spark, d):
    """Sessions of a job must be ephemeral, without a parent or turns at their start, and on threads of their own."""
    k = F.col("o_orderkey")
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderdate").alias("thread"), (k % 10 != 0).alias("ephemeral"), F.when(k % 15 == 0, "p").alias("parent"), (k % 20 == 0).alias("turned"))
    return violated(s, ["job"], {"persistent": F.bool_or(~F.col("ephemeral")), "parent": F.count("parent") > 0, "turns": F.bool_or("turned"), "shared_thread": F.count_distinct("thread") != F.count("*")})


@query(
    "manifest_ordinals",
    """WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i, printf('paper_%03d', o_orderkey + CASE WHEN o_orderkey % 50 = 0 THEN 2 ELSE 1 END) AS named FROM orders) SELECT o_orderkey, i, named FROM n WHERE named <> printf('paper_%03d', i)""",
)
def manifest_ordinals(spark, d):
    """Rows whose package id is not that of their place."""
    from ..plans.ranking import ordinals

    rows = ordinals(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "i")
    named = F.format_string("paper_%03d", F.col("o_orderkey") + F.when(F.col("o_orderkey") % 50 == 0, 2).otherwise(1))
    return rows.withColumn("named", named).where(F.col("named") != F.format_string("paper_%03d", "i")).select("o_orderkey", "i", "named")


@query("echo_digests", "SELECT conv_id, string_agg(role || ':' || length(text) || ':' || sha256(text), ',' ORDER BY turn) = string_agg(role || ':' || length(text) || ':' || sha256(CASE WHEN conv_id % 7 = 0 AND turn = 1 THEN reverse(text) ELSE text END), ',' ORDER BY turn) AS verified FROM conversations GROUP BY conv_id")
def echo_digests(spark, d):
    """An echo must have the types, lengths and digests of what was sent, in order. Digests are made before rows meet."""
    seen = F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 1), F.reverse("text")).otherwise(F.col("text"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", *[F.struct("role", F.length(c), F.sha2(c, 256)).alias(n) for n, c in (("sent", F.col("text")), ("seen", seen))])
    listed = lambda n: F.transform(F.array_sort(F.collect_list(F.struct("turn", n))), lambda i: i[n])
    return rows.groupBy("conv_id").agg((listed("sent") == listed("seen")).alias("verified"))


@query("byte_totals", "SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS n FROM documents GROUP BY source")
def byte_totals(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"))


def file_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Sizes of files by folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@query("override_decisions", """WITH a AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, CASE WHEN l_quantity > 40 THEN 'drop' WHEN l_quantity < 5 THEN 'keep' END AS first, CASE WHEN l_tax > 0.06 THEN 'reclassify' END AS later FROM lineitem)
 SELECT o, n, p, coalesce(later, first, 'undecided') AS decision, count(*) AS rows FROM a GROUP BY ALL""")
def override_decisions(spark, d):
    """Decisions by three keys from two maps: where both have one, the later wins."""
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    first, later = F.when(F.col("l_quantity") > 40, "drop").when(F.col("l_quantity") < 5, "keep"), F.when(F.col("l_tax") > 0.06, "reclassify")
    decided = F.coalesce(later, first, F.lit("undecided"))
    return table(spark, d, "lineitem").groupBy(*[F.col(k).alias(n) for k, n in zip(key, "onp", strict=True)], decided.alias("decision")).agg(F.count("*").alias("rows"))


def merged_decisions(items: DataFrame, first: DataFrame, later: DataFrame, keys: list[str]) -> DataFrame:
    """items with `decision`: from `later` if it has the key, else from `first`, else null."""
    joined = items.join(later.withColumnRenamed("decision", "__later"), keys, "left").join(first.withColumnRenamed("decision", "__first"), keys, "left")
    return joined.withColumn("decision", F.coalesce("__later", "__first")).drop("__later", "__first")


@query("nested_detections", "SELECT l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY 1")
def nested_detections(spark, d):
    """Counts of classes in detections nested in pages nested in documents."""
    det = table(spark, d, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 10).alias("doc"), F.col("l_orderkey").alias("page")).agg(F.collect_list("l_returnflag").alias("detections"))
    nested = det.groupBy("doc").agg(F.collect_list(F.struct("page", "detections")).alias("pages"))
    return nested_counts(nested, "pages", "detections", "class")


def nested_counts(df: DataFrame, outer: str, inner: str, name: str) -> DataFrame:
    return df.select(F.explode(outer).alias("__o")).select(F.explode(f"__o.{inner}").alias(name)).groupBy(name).agg(F.count("*").alias("n"))


@query("wrapped_match_labels", """WITH r AS (SELECT l_orderkey AS match, l_linenumber AS line, l_partkey AS x, l_suppkey AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem)
 SELECT match, line, x, y, CASE WHEN i = 1 THEN 'Anonymous' ELSE '' END AS replacement, count(*) AS n FROM r GROUP BY ALL""")
def wrapped_match_labels(spark, d):
    """A match that wraps over lines is labelled once, at its first rectangle."""
    key, order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity", "l_extendedprice"]
    # one sort serves all three windows; nothing is held but the rows of one rectangle
    same = Window.partitionBy(*key)
    rows = table(spark, d, "lineitem").select(*key, *order).withColumns({"i": F.row_number().over(Window.partitionBy(key[0]).orderBy(*key[1:], *order)), "j": F.row_number().over(same.orderBy(*order)), "c": F.count("*").over(same)})
    n = F.when(F.col("i") == 1, 1).when(F.col("j") == 2, F.col("c") - 1).otherwise(F.col("c"))
    names = [F.col(k).alias(a) for k, a in zip(key, ("match", "line", "x", "y"), strict=True)]
    return rows.where("j = 1 or (j = 2 and i = 2)").select(*names, F.when(F.col("i") == 1, "Anonymous").otherwise("").alias("replacement"), n.cast("bigint").alias("n"))


# Packages as files


INDEX = "schema string, package_id string, pages int, text_records_path string, sequence array<struct<type:string,path:string,record:int,page:int,sha256:string>>"
# The format that a package names (fixed value).
SCHEMA_NAME = "paper-text-figures/v2"


FORMATS = {"app-server": ("text", "localImage"), "responses": ("input_text", "input_image")}


def load_input(spark: SparkSession, root: str, format: str = "app-server", base: str = "") -> DataFrame:
    """`package_items` of all packages under root: one folder each with index.json, the records it names, and images."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format}")
    own = re.sub(r"^[a-z]+:(//[^/]*)?", "", root).rstrip("/") + "/"

    def parts(path: Column) -> list[Column]:
        """The package's folder, and the path below it."""
        two = F.split(F.substring(path, F.locate(own, path) + len(own), F.length(path)), "/", 2)
        return [two[0].alias("folder"), F.get(two, 1).alias("at")]

    files = spark.read.format("binaryFile").load(f"{root}/*/*").select(parts(F.url_decode("path"))[0]).distinct()
    lists = spark.read.text(f"{root}/*/*.json", wholetext=True).select(*parts(F.url_decode(F.input_file_name())), "value").withColumnRenamed("at", "name")
    images = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(root)
    images = images.select(*parts(F.url_decode("path")), F.sha2("content", 256).alias("sha"), *([base64(F.col("content")).alias("data")] if format == "responses" else []))
    return package_items(files, lists.where("name = 'index.json'").select("folder", "value"), lists.where("name <> 'index.json'"), images, format, base)


def package_items(folders: DataFrame, indexes: DataFrame, lists: DataFrame, images: DataFrame, format: str = "app-server", base: str = "") -> DataFrame:
    """The items of packages in order: folder, package_id, item, type, text (neighbouring texts joined), path from `base` or
    image_url, detail, and violation ('' : none). Every folder gives a row: one without an index, with a broken one or without a
    sequence is told, and so are an unsupported (or no) schema or type, pointers to no record, unsafe paths, images that are not
    there, have no checksum, or another. Records and images are found by joins.
    Tables: folders (folder), indexes (folder, value: JSON), lists (folder, name, value), images (folder, at, sha, data)."""
    parsed_index = indexes.withColumn("r", parsed(F.col("value"), INDEX)).withColumn("broken", fault(F.col("r"), F.col("value"), []))
    index = folders.select("folder").distinct().join(parsed_index, "folder", "left").select("folder", "r.*", F.when(F.col("value").isNull(), "no index").when(F.col("broken").isNotNull(), "broken index").when(~F.col("r.schema").eqNullSafe(SCHEMA_NAME), "unsupported schema").when(F.col("r.sequence").isNull(), "no sequence").alias("refusal"))
    seq = index.select("folder", "package_id", "refusal", "text_records_path", F.posexplode_outer("sequence").alias("place", "p")).select("folder", "package_id", "refusal", "text_records_path", "place", F.col("p").isNotNull().alias("is_item"), "p.*")
    texts = lists.select("folder", F.col("name").alias("text_records_path"), F.posexplode(F.from_json("value", "array<struct<text:string>>")).alias("record", "r")).select("folder", "text_records_path", "record", F.col("r.text").alias("text"))
    found = images.select("folder", F.col("at").alias("__at"), F.col("sha").alias("__sha"), *([F.col("data").alias("__data")] if format == "responses" else []))
    every = seq.join(texts, ["folder", "text_records_path", "record"], "left").withColumn("__at", resolved(F.col("path"))).join(found, ["folder", "__at"], "left")
    kind = F.col("type")
    image = kind == "image"
    violation = (
        F.when(F.col("refusal").isNotNull(), F.col("refusal")).when(~F.col("is_item"), F.lit(None)).when(F.coalesce(~kind.isin("text", "image"), F.lit(True)), "unknown item").when((kind == "text") & F.col("text").isNull(), "no record")
        .when(image & F.col("__at").isNull(), "unsafe path").when(image & F.col("__sha").isNull(), "no image").when(image & F.col("sha256").isNull(), "no checksum").when(image & (F.col("__sha") != F.col("sha256")), "checksum")
    )
    text_name, image_name = FORMATS[format]
    every = every.withColumn("violation", violation).withColumn("type", F.when(kind == "text", text_name).when(image, image_name).otherwise(kind))
    w = Window.partitionBy("folder").orderBy("place")
    new = F.when(F.lag("type").over(w).eqNullSafe(F.col("type")) & (F.col("type") == text_name), 0).otherwise(1)
    islands = every.withColumn("__new", new).withColumn("item", F.sum("__new").over(w))
    text = ordered_text(F.filter(F.collect_list(F.struct(F.col("place").alias("at"), "text")), lambda i: i["text"].isNotNull()), "\n\n")
    shown = F.first(relative(F.concat_ws("/", "folder", "__at"), F.lit(base))).alias("path") if format == "app-server" else F.first(F.concat(F.lit("data:image/png;base64,"), "__data")).alias("image_url")
    out = islands.groupBy("folder", "package_id", "item", "type").agg(F.when(F.first("type") == text_name, text).alias("text"), shown, F.array_join(F.array_sort(F.collect_set("violation")), ",").alias("violation"))
    shown_name = "path" if format == "app-server" else "image_url"
    is_image = F.col("type") == image_name
    return out.withColumn(shown_name, F.when(is_image, F.col(shown_name))).withColumn("detail", F.when(is_image, "high"))


def missing_packages(expected: DataFrame, items: DataFrame) -> DataFrame:
    """Packages of expected (package_id) that no folder gave an item of."""
    return expected.select("package_id").distinct().join(items.select("package_id").distinct(), "package_id", "left_anti")


# Conversations as packages whose index, records or images have one fault each, told by their number.
@query(
    "package_faults",
    """WITH t AS (SELECT DISTINCT conv_id FROM conversations) SELECT conv_id % 12 AS kind, CASE conv_id % 12 WHEN 1 THEN 'no index' WHEN 2 THEN 'broken index' WHEN 3 THEN 'unsupported schema' WHEN 4 THEN 'no sequence' WHEN 5 THEN 'checksum' WHEN 6 THEN 'no checksum' WHEN 7 THEN 'unknown item' WHEN 8 THEN 'no record'
 WHEN 9 THEN 'unsafe path' WHEN 10 THEN 'no image' WHEN 11 THEN 'unsupported schema' ELSE '' END AS violation, count(*) AS packages FROM t GROUP BY ALL""",
)
def package_faults(spark, d):
    """Packages with a fault of every kind; each fault is one row at least, and no package vanishes."""
    k = F.col("conv_id") % 12
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("texts"))
    turns = turns.withColumn("folder", F.col("conv_id").cast("string")).withColumn("k", k)
    sha = F.sha2(F.col("folder"), 256)
    text_item = F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("path"), F.when(k == 8, F.size("texts")).otherwise(0).alias("record"), F.lit(None).cast("string").alias("sha256"))
    image_item = F.struct(F.when(k == 7, F.lit(None)).otherwise("image").alias("type"), F.when(k == 9, "../a.png").when(k == 10, "figures/none.png").otherwise("figures/a.png").alias("path"), F.lit(None).cast("int").alias("record"), F.when(k == 5, F.lit("0")).when(k != 6, sha).alias("sha256"))
    content = F.struct(F.when(k == 3, "other/v1").when(k != 11, SCHEMA_NAME).alias("schema"), F.col("folder").alias("package_id"), F.lit("text.json").alias("text_records_path"), F.when(k != 4, F.array(text_item, image_item)).alias("sequence"))
    value = F.when(k == 2, F.concat(F.lit("{oops"), F.to_json(content))).otherwise(F.to_json(content))
    lists = turns.select("folder", F.lit("text.json").alias("name"), F.to_json(F.transform("texts", lambda t: F.struct(t.alias("text")))).alias("value"))
    images = turns.select("folder", F.lit("figures/a.png").alias("at"), sha.alias("sha"))
    items = package_items(turns.select("folder"), turns.where(k != 1).select("folder", value.alias("value")), lists, images)
    one = items.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("violation") != "", F.col("violation")))), ",").alias("violation"))
    return one.groupBy((F.col("folder").cast("bigint") % 12).alias("kind"), "violation").agg(F.count("*").alias("packages"))


def png_size(content: Column) -> list[Column]:
    """Width and height that a PNG's header states."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return [number(17).alias("width"), number(21).alias("height")]


def uncovered(rasters: DataFrame, assets: DataFrame, pad: float = 2.0, share: float = 0.94) -> DataFrame:
    """Raster placements of a point or more on either side that no asset of their page, padded, covers by more than the share."""
    from ..functions import geometry as g
    from .geometry import paired

    seen = assets.select("page", *[(F.col(c) + s * pad).alias(f"b{c}") for c, s in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))])
    own = rasters.where("x1 - x0 >= 1 AND y1 - y0 >= 1").select("page", *[F.col(c).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")])
    return paired(own, seen, f"{g.overlap('a', 'b')} > {share}", "left_anti")


