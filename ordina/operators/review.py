"""Logs of remote sessions: JSON lines, what is kept of them, and how a session ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_schema import schema_violations
from ..registry import query
from ..sources.tables import table

#: Methods of which something is kept, items that are no tool's, words that tell a tool's own events (fixed values).
SAFE_EVENTS = (
    "thread/started", "thread/status/changed", "turn/started", "turn/completed", "item/started", "item/completed", "thread/tokenUsage/updated",
    "error", "model/rerouted", "model/verification", "model/safetyBuffering/updated", "warning", "configWarning",
)
NO_TOOL_ITEMS = ("userMessage", "agentMessage", "reasoning")
TOOL_WORDS = ("toolcall", "commandexecution", "filechange", "websearch", "imageview", "imagegeneration", "requestapproval", "requestuserinput")
NOT_JSON = "nonJsonStdout"

_CONTENT = "array<struct<type:string,text:string>>"
_ITEM = f"struct<id:string,type:string,phase:string,text:string,content:{_CONTENT}>"
_MESSAGE = "struct<message:string>"
PARAMS = f"struct<itemId:string,item:{_ITEM},tokenUsage:struct<total:bigint>,turn:struct<status:string,error:{_MESSAGE}>,error:{_MESSAGE},willRetry:string,message:string>"
EVENT = f"id string, method string, params {PARAMS}"


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with id, method and params; a line that is no JSON object is an event of its own method, never an error."""
    event = F.from_json(F.col(line), f"{EVENT}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    bad = F.col("__e").isNull() | F.col("__e._corrupt_record").isNotNull()
    retry = F.get_json_object(F.col(line), "$.params.willRetry")
    out = lines.withColumn("__e", event).withColumns({"method": F.when(bad, NOT_JSON).otherwise(F.coalesce("__e.method", F.lit(""))), "id": F.when(~bad, F.col("__e.id")), "params": F.when(~bad, F.col("__e.params"))})
    # only the JSON literal counts as yes, a text "true" does not
    literal = F.regexp_like(F.col(line), F.lit(r'"willRetry"\s*:\s*true'))
    return out.withColumn("will_retry", ~bad & F.coalesce(retry == "true", F.lit(False)) & literal).drop("__e")


def event_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Events of JSON-lines files, batch or stream, in the order that files and lines have, as `seq` within a file."""
    reader = spark.readStream if stream else spark.read
    lines = reader.text(path).select(F.col("value").alias("line"), F.element_at(F.split(F.url_decode(F.col("_metadata.file_path")), "/"), -1).alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return parsed(lines if stream else lines.withColumn("seq", F.monotonically_increasing_id()))


def cleaned(message: Column) -> Column:
    """An error's text without bearer tokens and keys, 2000 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(message, r"(?i)(bearer\s+)\S+", "$1[REDACTED]"), r"sk-[A-Za-z0-9_-]+", "[REDACTED]"), 1, 2000)


def classified(events: DataFrame) -> DataFrame:
    """What each event of (session, seq, id, method, params, will_retry) adds to its session: keys of violating items, errors,
    warning, not_json, kept, and new values of usage, final, turn_status and echo (null: none)."""
    method = F.col("method")
    c = lambda path: F.col(f"params.{path}")
    request = F.col("id").isNotNull() & (method != "") & (method != NOT_JSON)
    is_item = method.isin("item/started", "item/completed")
    words = [F.lower(method).contains(w) for w in TOOL_WORDS]
    nested = method.startswith("item/") & ~is_item & F.greatest(*words)
    tool_item = is_item & ~F.coalesce(c("item.type").isin(*NO_TOOL_ITEMS), F.lit(False))
    keys = F.array_distinct(F.array_compact(F.array(
        F.when(request, F.coalesce(c("itemId"), F.concat(F.lit("request:"), "id"))), F.when(nested, F.coalesce(c("itemId"), F.concat(F.lit("tool:"), method))),
        F.when(tool_item, F.coalesce(c("item.id"), F.concat(F.lit("item:"), F.col("seq").cast("string")))),
    )))
    turn_error = (method == "turn/completed") & c("turn.error").isNotNull()
    trouble = method.isin("error", "model/rerouted", "model/verification")
    retried = (method == "error") & F.col("will_retry")
    final = (method == "item/completed") & (c("item.type") == "agentMessage") & (c("item.phase").isNull() | (c("item.phase") == "final_answer"))
    echo = is_item & (c("item.type") == "userMessage")
    shown = F.array_join(F.transform(F.coalesce(c("item.content"), F.array().cast(_CONTENT)), lambda i: F.concat_ws(":", i["type"], F.length(i["text"]).cast("string"), F.sha2(i["text"], 256))), ",")
    sure = lambda x: F.coalesce(x, F.lit(False))
    return events.withColumns({
        "keys": keys, "error": sure(request).cast("bigint") + sure(turn_error).cast("bigint") + sure(trouble & ~retried).cast("bigint"), "warning": sure(retried), "not_json": method == NOT_JSON, "kept": method.isin(*SAFE_EVENTS),
        "usage": F.when(method == "thread/tokenUsage/updated", c("tokenUsage.total")), "final": F.when(final, F.coalesce(c("item.text"), F.lit(""))), "turn_status": F.when(method == "turn/completed", c("turn.status")), "echo": F.when(echo, shown),
    })


LAST = ("usage", "final", "turn_status", "echo")


def outcome(violations: Column, errors: Column, final: Column, turn_status: Column, echo: Column, sent: Column | None = None, valid: Column | None = None) -> Column:
    """A session with violations is quarantined whatever else it says; it is completed if its turn completed, without errors,
    with a final answer (a valid one, if that is asked) and the right echo; else it failed."""
    verified = echo.isNotNull() if sent is None else echo.eqNullSafe(sent)
    done = turn_status.eqNullSafe("completed") & (errors == 0) & (F.coalesce(final, F.lit("")) != "") & verified & (F.lit(True) if valid is None else F.coalesce(valid, F.lit(False)))
    return F.when(violations > 0, "quarantined").when(done, "completed").otherwise("failed")


def valid_answer(final: Column, schema: dict) -> Column:
    """Whether the final answer is JSON that the schema admits."""
    return F.coalesce(F.size(schema_violations(F.coalesce(final, F.lit("")), schema)) == 0, F.lit(False))


def folded(events: DataFrame, sent: Column | None = None, schema: dict | None = None) -> DataFrame:
    """One row a session: counts of everything, violations (distinct keys, counted without being gathered), errors, warnings,
    the last usage, final answer, turn status and echo, and the status that follows (`outcome`). `sent` is the echo (an ordered text
    of types and digests) that the session must show, schema what its answer must be; without them any will do."""
    rows = classified(events)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in LAST]
    out = rows.groupBy("session").agg(F.count("*").alias("events"), F.count_if("kept").alias("kept"), F.sum("error").alias("errors"), F.count_if("warning").alias("warnings"), F.count_if("not_json").alias("not_json"), *last)
    bad = rows.where(F.size("keys") > 0).select("session", F.explode("keys").alias("key")).groupBy("session").agg(F.count_distinct("key").alias("violations"))
    out = out.join(bad, "session", "left").withColumn("violations", F.coalesce("violations", F.lit(0)).cast("bigint"))
    status = outcome(F.col("violations"), F.col("errors"), F.col("final"), F.col("turn_status"), F.col("echo"), sent, None if schema is None else valid_answer(F.col("final"), schema))
    return out.withColumn("status", status).select("session", "events", "kept", "violations", "errors", "warnings", "not_json", *LAST, "status")


# Events of users as such a log: each kind of event stands for a method, and some lines are no JSON.
_FORMS = {
    "view": ("item/completed", """'{"method":"item/completed","params":{"item":{"id":"i' || event_id || '","type":"' || CASE WHEN event_id % 97 = 0 THEN 'commandExecution' ELSE 'userMessage' END || '","content":[{"type":"text","text":"t' || (event_id % 3) || '"}]}}}'"""),
    "click": ("thread/tokenUsage/updated", """'{"method":"thread/tokenUsage/updated","params":{"tokenUsage":{"total":' || event_id || '}}}'"""),
    "signup": ("turn/completed", """'{"method":"turn/completed","params":{"turn":{"status":"' || CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'completed' END || '"}}}'"""),
    "purchase": ("item/completed", """'{"method":"item/completed","params":{"item":{"id":"a' || event_id || '","type":"agentMessage","phase":' || CASE event_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN '"final_answer"' ELSE '"draft"' END || ',"text":"answer ' || event_id || '"}}}'"""),
    "error": ("error", """'{"method":"error","params":{"error":{"message":"Bearer abc sk-12"},"willRetry":' || CASE WHEN event_id % 40 = 0 THEN 'false' WHEN event_id % 41 = 0 THEN '"true"' ELSE 'true' END || '}}'"""),
}
_LINE = f"CASE WHEN event_id % 60 = 7 THEN 'panic: ' || event_id {' '.join(f'WHEN event_type = {chr(39)}{k}{chr(39)} THEN {form}' for k, (_, form) in _FORMS.items())} END"


def session_log(spark: SparkSession, d: str) -> DataFrame:
    """A handful of events a session (users by week), as lines."""
    rows = table(spark, d, "events").withColumn("session", F.col("user_id") * 100 + F.floor(F.dayofyear("ts") / 3))
    order = F.unix_micros(F.col("ts").cast("timestamp"))
    return parsed(rows.select("session", order.alias("seq"), "event_id", F.expr(_LINE.replace("|| event_id", "|| CAST(event_id AS STRING)").replace("(event_id % 3)", "CAST(event_id % 3 AS STRING)")).alias("line")))


_LOG_SQL = """
log AS (SELECT user_id * 100 + CAST(floor(dayofyear(ts) / 3) AS BIGINT) AS session, epoch_us(ts) AS seq, event_id AS e, event_id % 60 = 7 AS broken, CASE WHEN event_id % 60 = 7 THEN '' ELSE event_type END AS t FROM events)
"""


@query("event_line_methods", f"WITH {_LOG_SQL} SELECT session, CASE WHEN broken THEN '{NOT_JSON}' ELSE CASE t {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{m}{chr(39)}' for k, (m, _) in _FORMS.items())} END END AS method, count(*) AS n FROM log GROUP BY 1, 2")
def event_line_methods(spark, d):
    """Methods of JSON lines by session, before anything is filtered; broken lines are events too."""
    return session_log(spark, d).groupBy("session", "method").agg(F.count("*").alias("n"))


@query(
    "session_fold",
    f"""WITH {_LOG_SQL}, s AS (SELECT session, count(*) AS events, CAST(count_if(NOT broken) AS BIGINT) AS kept, CAST(count_if(t = 'view' AND e % 97 = 0) AS BIGINT) AS violations, CAST(count_if(t = 'error' AND (e % 40 = 0 OR e % 41 = 0)) AS BIGINT) AS errors,
 CAST(count_if(t = 'error' AND e % 40 <> 0 AND e % 41 <> 0) AS BIGINT) AS warnings, CAST(count_if(broken) AS BIGINT) AS not_json, max_by(e, seq) FILTER (t = 'click') AS usage, 'answer ' || (max_by(e, seq) FILTER (t = 'purchase' AND e % 3 <> 2)) AS final,
 max_by(CASE WHEN e % 5 = 0 THEN 'failed' ELSE 'completed' END, seq) FILTER (t = 'signup') AS turn_status, max_by('text:2:' || sha256('t' || (e % 3)), seq) FILTER (t = 'view' AND e % 97 <> 0) AS echo FROM log GROUP BY session)
 SELECT *, CASE WHEN violations > 0 THEN 'quarantined' WHEN turn_status = 'completed' AND errors = 0 AND final IS NOT NULL AND echo IS NOT NULL THEN 'completed' ELSE 'failed' END AS status FROM s""",
)
def session_fold(spark, d):
    return folded(session_log(spark, d))


@query("clean_errors", r"""SELECT doc_id, md5(substring(regexp_replace(regexp_replace('BEARER  tok.' || doc_id || ' ' || text || ' sk-' || doc_id, '(?i)(bearer\s+)[^\s]+', '\1[REDACTED]', 'g'), 'sk-[A-Za-z0-9_-]+', '[REDACTED]', 'g'), 1, 2000)) AS digest FROM documents""")
def clean_errors(spark, d):
    message = F.concat(F.lit("BEARER  tok."), F.col("doc_id").cast("string"), F.lit(" "), "text", F.lit(" sk-"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", F.md5(cleaned(message)).alias("digest"))


@query("event_items_overwrite", "SELECT user_id AS session, props AS item, count(*) AS seen, max_by(event_type, (ts, event_id)) AS last_method FROM events GROUP BY 1, 2")
def event_items_overwrite(spark, d):
    """An item that is seen again overwrites what was known of it: the last event of each key."""
    return table(spark, d, "events").groupBy(F.col("user_id").alias("session"), F.col("props").alias("item")).agg(F.count("*").alias("seen"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_method"))


def utc_stamp(at: Column | None = None) -> Column:
    """A time (now, if none is given) as ISO text in UTC."""
    moment = F.current_timestamp() if at is None else at
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").substr(1, 26) if at is None else F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


@query("elapsed_seconds", "SELECT user_id AS session, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS began, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 6) AS seconds FROM events GROUP BY 1")
def elapsed_seconds(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("session")).agg(utc_stamp(F.min(ts)).alias("began"), F.round((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1_000_000, 6).alias("seconds"))
