"""Coverage of pages, re-ranked resamples, and the streamed review fold."""

import json

import numpy as np
from pyspark.sql import functions as F

from ordina.operators import building, panel, review
from ordina.streaming import reviews
from ordina.streaming.sessions import drained

BOX = "x0 double, y0 double, x1 double, y1 double"


def _page(spark):
    lines = spark.createDataFrame([(1, 1, i, t, 10.0, y, 90.0, y + 10) for i, (t, y) in enumerate([("in figure", 12.0), ("in both", 30.0), ("cell a", 60.0), ("cell b", 75.0), ("body text", 200.0), ("edge", 48.0)])], f"doc int, page int, line int, text string, {BOX}")
    figures = spark.createDataFrame([(1, 1, 1, 0.0, 10.0, 100.0, 45.0)], f"doc int, page int, place int, {BOX}")
    tables = spark.createDataFrame([(1, 1, 1, 0.0, 28.0, 100.0, 70.0), (1, 1, 2, 0.0, 55.0, 100.0, 90.0), (1, 1, 3, 500.0, 500.0, 600.0, 600.0)], f"doc int, page int, place int, {BOX}")
    return lines, figures, tables


def test_claims_and_order(spark):
    lines, figures, tables = _page(spark)
    claimed = building.claims(lines, figures, tables)
    assert {r["line"]: (r["owner"], r["owner_place"]) for r in claimed.collect()} == {0: ("figure", 1), 1: ("figure", 1), 2: ("table", 1), 3: ("table", 2), 4: ("body", None), 5: ("table", 1)}
    parts = building.page_parts(claimed, figures, tables).orderBy("place").collect()
    assert [(p["kind"], p["text"]) for p in parts] == [("page_marker", "page 1"), ("image", None), ("table", "edge\ncell a"), ("table", "cell b"), ("text", "body text")]


def test_coverage_tells_gaps_doubles_and_characters(spark):
    lines, figures, tables = _page(spark)
    claimed = building.claims(lines, figures, tables)
    assert building.coverage(lines, claimed).count() == 0
    found = {(r["violation"], r["what"]) for r in building.coverage(lines, claimed.where("line <> 4").unionByName(claimed.where("line = 2"))).collect()}
    assert {("line without a place", "4"), ("line with several places", "2"), ("characters lost", "x"), ("characters added", "a")} <= found
    changed = building.coverage(lines, claimed.withColumn("text", F.regexp_replace("text", "edge", "edgy"))).collect()
    assert {(r["violation"], r["what"]) for r in changed} == {("characters lost", "e"), ("characters added", "y")}
    assert building.coverage(lines, claimed.withColumn("text", F.concat(F.lit(" \n"), "text"))).count() == 0  # white space is none


def _weighted_ranks(v, w):
    order = np.sort(np.unique(v))
    below = {x: w[v < x].sum() + (w[v == x].sum() + 1) / 2 for x in order}
    return np.array([below[x] for x in v])


def test_resamples_are_ranked_anew(spark):
    """10,000 draws of a small table equal a direct resample of it."""
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.integers(1, 6)), round(float(rng.normal()), 1)) for i in range(24)]
    got = {r["b"]: r["v"] for r in panel.bootstrap_ranked(spark.createDataFrame(rows, "paper_id bigint, x double, y double"), "paper_id", 10_000).collect()}
    x, y, ids = (np.array(c) for c in ([r[1] for r in rows], [r[2] for r in rows], [r[0] for r in rows]))
    want = {}
    for b in range(10_000):
        h = ((b * 7919 + ids * 104729 + 12345) % 1000003 * 9973 + ids * 31) % 1000000
        w = sum((h >= p).astype(int) for p in panel._POISSON)
        again = np.repeat(np.arange(len(ids)), w)  # the draw itself, unit by unit
        if len(again) and np.ptp(x[again]) and np.ptp(y[again]):
            rx, ry = (_weighted_ranks(c[again], np.ones(len(again))) for c in (x, y))
            want[b] = np.corrcoef(rx, ry)[0, 1]
    assert len(want) > 9_900 and all(abs(got[b] - v) < 1e-9 for b, v in want.items())


def test_ranked_resamples_of_ties_and_nulls_equal_sql(spark, monkeypatch):
    """One y of most units, in many slices and partitions, and nulls, which are ranked last; units are not multiplied by draws."""
    import duckdb

    seen, kept, parts = {}, panel.stored, panel._ranked_parts
    monkeypatch.setattr(panel, "stored", lambda df, name: seen.setdefault(name, kept(df, name)))
    monkeypatch.setattr(panel, "_ranked_parts", lambda draws: parts(draws, 40 * draws, 5 * draws))
    rng = np.random.default_rng(2)
    rows = [(i, None if i % 31 == 0 else float(rng.integers(1, 9)), None if i % 17 == 0 else 5.0 if i % 4 else round(float(rng.normal(5, 1)), 1)) for i in range(2000)]
    got = {r["b"]: r["v"] for r in panel.bootstrap_ranked(spark.createDataFrame(rows, "paper_id bigint, x double, y double"), "paper_id", 20).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE u (paper_id BIGINT, vx DOUBLE, vy DOUBLE)")
    con.executemany("INSERT INTO u VALUES (?, ?, ?)", rows)
    sql = f"""WITH k AS (SELECT * FROM (SELECT b.range AS b, u.*, {panel._WEIGHT.replace("b *", "b.range *")} AS w FROM range(20) b, u) WHERE w > 0),
     r AS (SELECT b, w, {panel._RANKED.format("vx")} AS x, {panel._RANKED.format("vy")} AS y FROM k), m AS (SELECT b, {panel._MOMENTS} FROM r GROUP BY b) SELECT b, {panel._CORR} FROM m"""
    want = dict(con.execute(sql).fetchall())
    assert len(want) == 20 and all(abs(got[b] - v) < 1e-9 for b, v in want.items())
    assert seen["ranked_parts"].count() < len(rows)


def _event(method, **params):
    return json.dumps({"method": method, "params": params})


def _item(kind, text, **more):
    return _event("item/completed", item={"id": f"{kind}-{text}", "type": kind, "content": [{"type": "text", "text": text}], "text": text, **more})


ANSWER = {"type": "object", "required": ["score"], "properties": {"score": {"type": "integer", "minimum": 1, "maximum": 10}}, "additionalProperties": False}


def test_review_stream_equals_the_batch(spark, tmp_path):
    """Several runs on one checkpoint: wrong echoes stop their session in their batch, deadlines report the silent ones once."""
    done = _event("turn/completed", turn={"status": "completed"})
    sessions = {
        1: [_item("userMessage", "ask"), _item("agentMessage", '{"score": 7}'), done], 2: [_item("userMessage", "other"), _item("agentMessage", '{"score": 7}'), done], 3: [_item("userMessage", "ask"), _item("commandExecution", "ls"), _item("commandExecution", "ls"), done],
        4: [_item("userMessage", "ask"), _item("agentMessage", '{"score": 11}'), done], 5: [_item("userMessage", "ask"), "no json at all"], 6: [_item("userMessage", "ask"), _event("error", error={"message": "x"}, willRetry=True), _item("agentMessage", '{"score": 1}'), done],
        7: [_item("userMessage", "ask"), _event("error", error={"message": "x"}), _item("agentMessage", '{"score": 1}'), done],
    }
    rows = [(s, 1_000_000 * (100 * i + s), line) for s, own in sessions.items() for i, line in enumerate(own)]
    rows.append((99, 1_000_000 * 100_000, done))  # event time goes on
    log = review.parsed(spark.createDataFrame(rows, "session bigint, seq bigint, line string")).withColumn("ts", F.timestamp_micros("seq"))
    sent = spark.createDataFrame([("ask",)], "t string").select(F.concat_ws(":", F.lit("text"), F.length("t").cast("string"), F.sha2("t", 256)).alias("e")).first()["e"]
    grown, place, changes = str(tmp_path / "in"), str(tmp_path / "place"), None
    for low, high in ((0, 1), (1, 2), (2, 90_000), (90_000, 10**9)):
        log.where((F.col("seq") >= low * 100_000_000) & (F.col("seq") < high * 100_000_000) if high < 10**9 else F.col("session") == 99).where((F.col("session") != 99) | (F.lit(high) == 10**9)).write.mode("append").parquet(grown)
        changes = drained(reviews.fold_stream(spark.readStream.schema(log.schema).parquet(grown), F.lit(sent), deadline_ms=3_600_000), "update", "t", place)
    told = changes.where("session <> 99").collect()
    stops = {r["session"]: min(x["batch"] for x in told if x["session"] == r["session"] and x["stop"]) for r in told if r["stop"]}
    assert stops[2] == 0 and stops[3] == min(r["batch"] for r in told if r["session"] == 3 and r["violations"] > 0)
    assert [r["session"] for r in told if r["timed_out"]] == [5] and set(stops) == {2, 3, 5}
    last = {r["session"]: r for r in reviews.last_sessions(changes, F.lit(sent), ANSWER).where("session <> 99").collect()}
    batch = {r["session"]: r for r in review.folded(log, F.lit(sent), ANSWER).where("session <> 99").collect()}
    names = ("events", "kept", "violations", "errors", "warnings", "not_json", "usage", "final", "turn_status", "echo", "status")
    assert {s: tuple(r[n] for n in names) for s, r in last.items()} == {s: tuple(r[n] for n in names) for s, r in batch.items()}
    assert {s: r["status"] for s, r in batch.items()} == {1: "completed", 2: "failed", 3: "quarantined", 4: "failed", 5: "failed", 6: "completed", 7: "failed"} and batch[3]["violations"] == 1


def test_a_fold_without_deadlines_is_no_python(spark, tmp_path):
    """The same changes as those of the processor that keeps deadlines, batch by batch, without a call for each session."""
    done = _event("turn/completed", turn={"status": "completed"})
    runs = [
        [(1, _item("userMessage", "ask")), (2, _item("userMessage", "other")), (3, _item("commandExecution", "ls"))],
        [(1, _item("agentMessage", "a")), (2, _item("userMessage", "ask")), (3, _item("commandExecution", "ls")), (3, _item("fileChange", "f")), (1, "no json")],
        [(1, done), (2, done), (3, _event("error", error={"message": "x"}, willRetry=True)), (4, done)],
    ]
    rows = [(i, s, 1_000_000 * (100 * i + k + 1), line) for i, own in enumerate(runs) for k, (s, line) in enumerate(own)]
    log = review.parsed(spark.createDataFrame(rows, "run int, session bigint, seq bigint, line string")).withColumn("ts", F.timestamp_micros("seq"))
    sent = F.concat(F.lit("text:3:"), F.sha2(F.lit("ask"), 256))
    changes = {}
    for deadline in (None, 10**12):
        grown, place = str(tmp_path / f"in{deadline}"), str(tmp_path / f"place{deadline}")
        for run in range(len(runs)):
            log.where(F.col("run") == run).drop("run").write.mode("append").parquet(grown)
            stream = reviews.fold_stream(spark.readStream.schema(log.drop("run").schema).parquet(grown), sent, deadline)
            assert ("TransformWithState" in stream._jdf.queryExecution().logical().toString()) == (deadline is not None)
            out = drained(stream, "update", "t", place)
        changes[deadline] = sorted(str(r.asDict()) for r in reviews.last_sessions(out, sent).drop("batch").collect())
        changes[deadline, "stops"] = {r["session"]: r["stop"] for r in out.orderBy("batch").collect()}
    assert changes[None] == changes[10**12] and len(changes[None]) == 4
    assert changes[None, "stops"] == changes[10**12, "stops"] == {1: False, 2: True, 3: True, 4: False}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_claims_and_coverage_make_no_row_a_pair_or_character(spark):
    lines, figures, tables = _page(spark)
    claimed = building.claims(lines, figures, tables)
    assert _plan(claimed).count("Join ") == 1 and "Join " not in _plan(building.coverage(lines, lines.withColumn("text", F.col("text"))))
    # a line that is there once, and once more with another text, is not unknown; only the other text adds characters
    more = lines.where("line = 2").withColumn("text", F.lit("xx y"))
    found = {(r["violation"], r["what"]) for r in building.coverage(lines, claimed.select(*lines.columns).unionByName(more)).collect()}
    assert found == {("line with several places", "2"), ("characters added", "x"), ("characters added", "y")}


def test_labels_of_matches_with_repeated_rectangles(spark, tmp_path):
    """Windows over one sort, no table of groups in memory."""
    from ordina.operators.packages import wrapped_match_labels

    rows = [(1, 1, 5, 6, 1.0, 2.0)] * 3 + [(1, 2, 5, 6, 1.0, 2.0)] * 2 + [(2, 1, 7, 8, 1.0, 2.0), (2, 1, 7, 9, 1.0, 2.0)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    out = wrapped_match_labels(spark, str(tmp_path))
    assert "Aggregate" not in _plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, 1, 5, 6, "", 2), (1, 1, 5, 6, "Anonymous", 1), (1, 2, 5, 6, "", 2), (2, 1, 7, 8, "Anonymous", 1), (2, 1, 7, 9, "", 1)]
