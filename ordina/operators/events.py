"""Session states folded from event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import event_log

#: Methods that may be kept (fixed values); everything is counted before this filter.
SAFE = ("view", "click", "signup")


def _order():
    return F.struct("ts", "event_id")


@query("event_counts", "SELECT user_id AS session, event_type AS method, count(*) AS n FROM events GROUP BY 1, 2")
def event_counts(spark, d):
    return event_log(spark, d).groupBy("session", "method").agg(F.count("*").alias("n"))


@query("safe_events", "SELECT event_id, user_id AS session, event_type AS method FROM events WHERE event_type IN ('view', 'click', 'signup')")
def safe_events(spark, d):
    return event_log(spark, d).where(F.col("method").isin(*SAFE)).select("event_id", "session", "method")


@query(
    "event_last_values",
    """SELECT user_id AS session, max_by(event_type, (ts, event_id)) AS last_method, round(max_by(value, (ts, event_id)) FILTER (event_type = 'purchase'), 6) AS last_purchase,
 max_by(props, (ts, event_id)) FILTER (event_type = 'click') AS last_click FROM events GROUP BY 1""",
)
def event_last_values(spark, d):
    last = lambda v, m: F.max_by(F.when(F.col("method") == m, F.col(v)), F.when(F.col("method") == m, _order()))
    return event_log(spark, d).groupBy("session").agg(F.max_by("method", _order()).alias("last_method"), F.round(last("value", "purchase"), 6).alias("last_purchase"), last("props", "click").alias("last_click"))


@query(
    "event_violations",
    """SELECT user_id AS session, count(DISTINCT props) FILTER (event_type = 'error') AS distinct_violations, min_by(event_id, (ts, event_id)) FILTER (event_type = 'error') AS first_violation FROM events GROUP BY 1""",
)
def event_violations(spark, d):
    bad = F.col("method") == "error"
    return event_log(spark, d).groupBy("session").agg(F.count_distinct(F.when(bad, F.col("props"))).alias("distinct_violations"), F.min_by(F.when(bad, F.col("event_id")), F.when(bad, _order())).alias("first_violation"))


@query("error_warning_split", "SELECT user_id AS session, CAST(count_if(event_type = 'error' AND CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0) AS BIGINT) AS warnings, CAST(count_if(event_type = 'error' AND NOT coalesce(CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0, FALSE)) AS BIGINT) AS errors FROM events GROUP BY 1")
def error_warning_split(spark, d):
    """An error that says it will be retried is a warning; one that does not say so is an error."""
    retried = F.coalesce(F.get_json_object("props", "$.k").cast("bigint") % 2 == 0, F.lit(False))
    bad = F.col("method") == "error"
    return event_log(spark, d).groupBy("session").agg(F.count_if(bad & retried).alias("warnings"), F.count_if(bad & ~retried).alias("errors"))


def folded_sessions(log: DataFrame) -> DataFrame:
    """One row a session; status: violations quarantine, errors or no final answer fail, else completed."""
    bad = F.col("method") == "error"
    violation = bad & (F.col("value") > 100)
    s = log.groupBy("session").agg(
        F.count("*").alias("events"), F.count_if(violation).alias("violations"), F.count_if(bad & ~violation).alias("errors"), F.count_if(F.col("method") == "purchase").alias("finals"),
    )
    status = F.when(F.col("violations") > 0, "quarantined").when((F.col("errors") > 0) | (F.col("finals") == 0), "failed").otherwise("completed")
    return s.withColumn("status", status)


TERMINAL_SQL = """WITH s AS (SELECT user_id AS session, count(*) AS events, CAST(count_if(event_type = 'error' AND value > 100) AS BIGINT) AS violations,
 CAST(count_if(event_type = 'error' AND NOT value > 100) AS BIGINT) AS errors, CAST(count_if(event_type = 'purchase') AS BIGINT) AS finals FROM events GROUP BY 1)
 SELECT *, CASE WHEN violations > 0 THEN 'quarantined' WHEN errors > 0 OR finals = 0 THEN 'failed' ELSE 'completed' END AS status FROM s"""


@query("terminal_status", TERMINAL_SQL)
def terminal_status(spark, d):
    return folded_sessions(event_log(spark, d))


@query(
    "rounds_until_failure",
    """WITH r AS (SELECT user_id AS session, event_id, event_type = 'error' AS failed, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)
 SELECT session, count(*) AS rounds, CAST(count_if(failed) AS BIGINT) AS failures FROM r WHERE coalesce(before, 0) = 0 GROUP BY session""",
)
def rounds_until_failure(spark, d):
    """The rounds of a session up to its first failure. The first failure is a minimum, so nothing is sorted."""
    rows = event_log(spark, d).select("session", _order().alias("at"), (F.col("method") == "error").alias("failed"))
    first = rows.where("failed").groupBy("session").agg(F.min("at").alias("first"))
    until = rows.join(first, "session", "left").where("first is null or at <= first")
    return until.groupBy("session").agg(F.count("*").alias("rounds"), F.count_if("failed").alias("failures"))


@query(
    "session_timeouts",
    """WITH s AS (SELECT user_id AS session, max(ts) AS last FROM events GROUP BY 1) SELECT session, strftime(last, '%Y-%m-%d %H:%M:%S') AS last_event, last < (SELECT max(ts) FROM events) - INTERVAL 12 HOUR AS timed_out FROM s""",
)
def session_timeouts(spark, d):
    """Sessions that have been silent for longer than their deadline, by event time: the end of the log is one row."""
    last = event_log(spark, d).groupBy("session").agg(F.max("ts").alias("last")).withColumn("one", F.lit(1))
    end = last.groupBy("one").agg(F.max("last").alias("end"))
    late = F.col("last") < F.col("end") - F.expr("INTERVAL 12 HOURS")
    return last.join(F.broadcast(end), "one").select("session", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last_event"), late.alias("timed_out"))
