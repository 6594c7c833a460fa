"""Sessions of a review run as a stream: the whole fold of their events, kept as state, with early stops and deadlines.

State of a session: its violating items (each counted once, whenever it is seen again), and counts
and the last usage, answer, turn status and echo, each with the place it came from. What an event means is decided
before the state, by the same expressions as in the batch fold. Each batch gives the sessions that changed; `stop` tells
which of them should be interrupted: a violating item so far, or an echo other than what was sent. A session whose turn has not ended
when event time passes its deadline is reported as timed out, once; one that has ended, or timed out, is forgotten after that.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.review import LAST, classified, outcome, session_log, valid_answer
from ..registry import SQL, query
from ..sources.tables import shared_path
from .sessions import drained

#: Keeps state outside of the JVM's heap; processors with several variables need it.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTS = ("events", "kept", "errors", "warnings", "not_json", "violations")
#: Counts and the columns they add up; last values and where each came from.
_ADDED = (("kept", "kept"), ("errors", "error"), ("warnings", "warning"), ("not_json", "not_json"))
_PLACES = tuple((n, f"{n}_at") for n in LAST)


def _fields(names: tuple[str, ...], kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


_LAST_KINDS = {"usage": T.LongType(), "final": T.StringType(), "turn_status": T.StringType(), "echo": T.StringType()}
_STATE = T.StructType([T.StructField("wrong", T.BooleanType()), *_fields(COUNTS, T.LongType())] + [T.StructField(n, k) for n, k in _LAST_KINDS.items()] + _fields(tuple(at for _, at in _PLACES), T.LongType()) + [T.StructField("deadline", T.LongType())])
OUTPUT = T.StructType([T.StructField("session", T.LongType()), *_fields(COUNTS, T.LongType()), *[T.StructField(n, k) for n, k in _LAST_KINDS.items()], T.StructField("stop", T.BooleanType()), T.StructField("timed_out", T.BooleanType())])


class SessionFold(StatefulProcessor):
    """Rows of `classified` with session, seq, sent (the echo that is right, or null) and ms (event time). A session has a handful
    of events a batch, so they come as rows: a pandas frame for each would cost more than all the rest."""

    def __init__(self, deadline_ms: int | None) -> None:
        self.deadline_ms = deadline_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("fold", _STATE)
        self.bad = handle.getMapState("violations", T.StructType([T.StructField("key", T.StringType())]), T.StructType([T.StructField("seq", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        names = _STATE.names
        held = self.value.get()
        now = dict(zip(names, held, strict=True)) if held is not None else dict.fromkeys(names)
        fresh = held is None
        for n in COUNTS:
            now[n] = now[n] or 0
        now["wrong"], began = bool(now["wrong"]), None
        for row in rows:
            r = row.asDict()
            now["events"] += 1
            for n, column in _ADDED:
                now[n] += r[column] or 0
            for k in r["keys"] or ():
                if not self.bad.containsKey((k,)):
                    self.bad.updateValue((k,), (r["seq"],))
                    now["violations"] += 1
            for n, at in _PLACES:
                if r[n] is not None and (now[at] is None or r["seq"] >= now[at]):
                    now[n], now[at] = r[n], r["seq"]
            now["wrong"] |= r["echo"] is not None and r["sent"] is not None and r["echo"] != r["sent"]
            began = r["ms"] if began is None else min(began, r["ms"])
        if fresh and self.deadline_ms is not None:
            now["deadline"] = max(began + self.deadline_ms, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(now["deadline"])
        self.value.update(tuple(now.values()))
        yield self._row(key, now, now["wrong"] or now["violations"] > 0, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = dict(zip(_STATE.names, self.value.get(), strict=True))
        self.value.clear()
        self.bad.clear()
        if now["turn_status"] is None:
            yield self._row(key, now, True, True)

    def _row(self, key, now: dict, stop: bool, timed_out: bool) -> Row:
        return Row(session=key[0], **{n: now[n] for n in (*COUNTS, *LAST)}, stop=stop, timed_out=timed_out)


def fold_stream(events: DataFrame, sent: Column | None = None, deadline_ms: int | None = None, lateness: str = "10 minutes") -> DataFrame:
    """A stream of changes of sessions (OUTPUT) from a stream of (session, seq, ts, id, method, params, will_retry). Only deadlines
    need a processor with timers, which is called for each session; without one the same state is an aggregate by session."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = classified(events.withWatermark("ts", lateness)).withColumn("sent", F.lit(None).cast("string") if sent is None else sent)
    rows = rows.select("session", "seq", "ts", F.unix_millis("ts").alias("ms"), "keys", "error", F.col("warning").cast("bigint").alias("warning"), F.col("not_json").cast("bigint").alias("not_json"), F.col("kept").cast("bigint").alias("kept"), *LAST, "sent")
    if deadline_ms is not None:
        return rows.groupBy("session").transformWithState(SessionFold(deadline_ms), OUTPUT, "Update", "EventTime")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in LAST]
    bad = F.array_distinct(F.flatten(F.collect_set(F.when(F.size("keys") > 0, F.col("keys")))))
    wrong = F.coalesce(F.bool_or(F.col("echo") != F.col("sent")), F.lit(False))
    out = rows.groupBy("session").agg(F.count("*").alias("events"), *[F.sum(c).alias(n) for n, c in _ADDED], F.size(bad).cast("bigint").alias("violations"), *last, wrong.alias("wrong"))
    return out.withColumns({"stop": F.col("wrong") | (F.col("violations") > 0), "timed_out": F.lit(False)}).select(*OUTPUT.names)


def last_sessions(changes: DataFrame, sent: Column | None = None, schema: dict | None = None) -> DataFrame:
    """The last change of each session with its status; a session that timed out has failed, or was quarantined before."""
    last = changes.groupBy("session").agg(F.max_by(F.struct(*[c for c in OUTPUT.names if c != "session"]), F.struct("batch", "timed_out")).alias("s")).select("session", "s.*")
    status = outcome(F.col("violations"), F.col("errors"), F.col("final"), F.col("turn_status"), F.col("echo"), sent, None if schema is None else valid_answer(F.col("final"), schema))
    return last.withColumn("status", status)


def log_parts(spark, d, parts: int = 3) -> list[DataFrame]:
    """The session log in `parts`, one after the other in time."""
    log = session_log(spark, d).withColumn("ts", F.timestamp_micros("seq"))
    low, high = log.agg(F.min("seq"), F.max("seq")).first()
    part = F.least(F.floor((F.col("seq") - F.lit(low or 0)) * parts / F.lit((high or 0) - (low or 0) + 1)), F.lit(parts - 1))
    return [log.where(part == k) for k in range(parts)]


@query("stream_session_fold", SQL["session_fold"])
def stream_session_fold(spark, d):
    """The whole fold of sessions over several runs of one stream: each goes on from the state that the last one left."""
    place, grown, out = shared_path(spark, "session_fold"), shared_path(spark, "session_input"), None
    for part in log_parts(spark, d):
        part.write.mode("append").parquet(grown)
        out = drained(fold_stream(spark.readStream.schema(part.schema).parquet(grown)), "update", "session_fold", place)
    return last_sessions(out).drop("stop", "timed_out")
