import json
import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ordina.functions import geometry as g
from ordina.functions.strings import base64, upper
from ordina.functions.json_schema import check_schema, schema_violations, violations
from ordina.operators.contracts import quota_decision
from ordina.operators.panel import split_of
from ordina.operators.sequences import coalesced
from ordina.operators.text import author_pattern, caption_name, heading, normalized
from ordina.plans.ranking import average_ranks, ordinals
from ordina.sources import papers


def _boxes(spark, rows):
    return spark.createDataFrame(rows, "ax0 double, ay0 double, ax1 double, ay1 double, bx0 double, by0 double, bx1 double, by1 double")


def test_iou_of_identical_disjoint_nested_and_touching_boxes(spark):
    rows = [(0.0, 0.0, 2.0, 2.0, 0.0, 0.0, 2.0, 2.0), (0.0, 0.0, 1.0, 1.0, 5.0, 5.0, 6.0, 6.0), (0.0, 0.0, 4.0, 4.0, 1.0, 1.0, 3.0, 3.0), (0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 2.0, 1.0)]
    got = [tuple(r) for r in _boxes(spark, rows).selectExpr(g.iou("a", "b"), g.overlap("b", "a"), g.intersects("a", "b")).collect()]
    assert got == [(1.0, 1.0, True), (0.0, 0.0, False), (0.25, 1.0, True), (0.0, 0.0, False)]


def test_iou_is_symmetric_and_bounded(spark):
    r = random.Random(1)
    rows = [tuple(float(v) for b in range(2) for v in (lambda x, y: (x, y, x + r.randint(0, 9), y + r.randint(0, 9)))(r.randint(0, 9), r.randint(0, 9))) for _ in range(300)]
    for ab, ba in _boxes(spark, rows).selectExpr(g.iou("a", "b"), g.iou("b", "a")).collect():
        assert ab == pytest.approx(ba) and 0 <= ab <= 1


def test_average_ranks_and_ordinals(spark):
    values = [3.0, 1.0, 3.0, 2.0, 5.0, 3.0]
    got = {(r["v"], r["r"]) for r in average_ranks(spark.createDataFrame([(v,) for v in values], "v double"), "v", "r").collect()}
    assert got == {(1.0, 1.0), (2.0, 2.0), (3.0, 4.0), (5.0, 6.0)}
    rows = ordinals(spark.range(0, 5000).selectExpr("id * 37 % 5000 as k"), "k", "i", 0).collect()
    assert all(r["k"] == r["i"] for r in rows)


@given(st.lists(st.integers(1, 6), min_size=5, max_size=5))
def test_split_patterns_are_exhaustive(scores):
    top = max(scores.count(s) for s in scores)
    kinds = [max(scores) == min(scores), max(scores) - min(scores) == 1 and top == 4, max(scores) - min(scores) == 1 and top == 3, max(scores) - min(scores) >= 2]
    assert sum(kinds) == 1


def test_split_of(spark):
    units = {1: [5, 5, 5, 5, 5], 2: [5, 5, 5, 5, 6], 3: [5, 5, 5, 6, 6], 4: [3, 5, 5, 5, 5]}
    df = spark.createDataFrame([(k, s) for k, v in units.items() for s in v], "paper_id int, score int")
    assert {r["paper_id"]: r["pattern"] for r in split_of(df, "score").collect()} == {1: "same", 2: "4:1", 3: "3:2", 4: "range>=2"}


def test_coalesced_keeps_text_and_order(spark):
    df = spark.createDataFrame([(1, 0, "t", "a"), (1, 1, "t", "b c"), (1, 2, "i", "x"), (1, 3, "t", "d")], "k int, at int, type string, text string")
    got = [(r["type"], r["text"]) for r in coalesced(df, "k", "at", "type", "text").orderBy("island").collect()]
    assert got == [("t", "a\n\nb c"), ("i", "x"), ("t", "d")]


SCHEMA = {"type": "object", "properties": {"score": {"type": "integer", "minimum": 1, "maximum": 10}, "notes": {"type": "array", "items": {"type": "string"}, "maxItems": 3}}, "required": ["score"], "additionalProperties": False}


@pytest.mark.parametrize(
    ("value", "ok"), [({"score": 7}, True), ({"score": 0}, False), ({"score": 11}, False), ({"score": 7.0}, False), ({"score": "7"}, False), ({"score": True}, False), ({}, False), ({"score": 7, "x": 1}, False), ({"score": 7, "notes": ["a"] * 4}, False)],
)
def test_response_contract(value, ok):
    assert (violations(value, SCHEMA) == []) is ok


def test_schema_keywords():
    with pytest.raises(ValueError, match="not supported"):
        check_schema({"pattern": "x"})
    assert violations(3, {"oneOf": [{"type": "integer"}, {"type": "number"}]}) == ["$: oneOf"]
    assert violations({"a": 1}, {"$ref": "#/$defs/n", "$defs": {"n": {"required": ["b"]}}}) == ["$.b: required"]
    assert violations("x", {"minimum": 1}) == ["$: minimum"]
    assert violations(True, {"const": 1}) == ["$: const"]


def test_schema_violations_in_columns(spark):
    df = spark.createDataFrame([(json.dumps({"score": 7}),), ("{",), (None,)], "j string")
    assert [r[0] for r in df.select(schema_violations(F.col("j"), SCHEMA)).collect()] == [[], ["$: json"], None]


@pytest.mark.parametrize(("allowed", "used", "want"), [(None, None, "stop"), (False, 1.0, "stop"), (True, None, "pass"), (True, 100.0, "stop"), (None, 5.0, "pass")])
def test_quota(spark, allowed, used, want):
    df = spark.createDataFrame([(allowed, used)], "a boolean, u double")
    assert df.select(quota_decision(F.col("a"), F.col("u"))).first()[0] == want


def test_text_functions(spark):
    df = spark.createDataFrame([("Ŝmith–Jones­", "Figure 3: x")], "n string, c string")
    assert tuple(df.select(normalized(F.col("n")), caption_name(F.col("c"))).first()) == ("smith-jones", "3")
    names = spark.createDataFrame([("Ada Byron Lovelace", "by ada b. lovelace and"), ("Ada Byron Lovelace", "adalovelace"), ("Li", "by li"), ("Ada Byron Lovelace", "ada lovelace")], "n string, t string")
    assert [r[0] for r in names.select(F.regexp_like("t", author_pattern(F.array(F.lower("n"))))).collect()] == [True, False, False, True]


def test_manifest(spark, tmp_path):
    good = tmp_path / "m.jsonl"
    good.write_text('﻿{"paper_id": "a", "pdf_path": "a.pdf", "authors": "X; Y;", "rating": 3}\n\n{"paper_id": "b", "pdf_path": "b.pdf", "authors": ["Z W"]}\n', encoding="utf-8")
    rows = papers.manifest(spark, str(good)).orderBy("package_id").collect()
    assert [(r["package_id"], r["paper_id"], r["authors"]) for r in rows] == [("paper_001", "a", ["X", "Y"]), ("paper_002", "b", ["Z W"])]
    bad = tmp_path / "d.jsonl"
    bad.write_text('{"paper_id": "a", "pdf_path": "a.pdf"}\n{"paper_id": "a", "pdf_path": "b.pdf"}\n')
    with pytest.raises(ValueError, match="repeat"):
        papers.manifest(spark, str(bad))
    (tmp_path / "e.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="empty"):
        papers.manifest(spark, str(tmp_path / "e.jsonl"))


def test_papers(spark, tmp_path):
    record = {"year": 2026, "paper_id": "p", "status": "withdrawn", "decision": "Reject", "human_ratings": [4, 2], "human_mean_rating": 3.0, "primary_area": "x",
              "human_reviews": [{"review_id": "r1", "tcdate": 1000, "content": {"rating": {"value": 2}}}],
              "ai_reviews": [{"round": i, "response": {"score": s, "confidence": 4}} for i, s in enumerate((3, 3, 3, 3, 4), 1)]}
    (tmp_path / "p.json").write_text(json.dumps(record, indent=1))
    df = papers.papers(spark, str(tmp_path / "p.json"))
    scores = papers.ai_scores(df)
    assert scores.count() == 5
    assert math.isclose(scores.agg(F.stddev_samp("score")).first()[0], 0.4472135954999579)
    assert [r["rating"] for r in papers.human_reviews(df).collect()] == [2]


def test_upper_keeps_the_length_of_a_text(spark):
    texts = ["Straße", "ﬁne ᾳ ŉ\nß", "plain é", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(upper(F.col("t"))).collect()]
    assert got == ["STRAẞE", "ﬁNE ᾼ ŉ\nẞ", "PLAIN É", "", None]


def test_a_heading_of_109_characters_with_sharp_s(spark):
    line = "ß" + "a" * 108
    row = spark.createDataFrame([(line,)], "t string").select(heading(upper(F.col("t")), F.lit(False))).first()
    assert row[0]


def test_base64_of_long_bytes_is_one_line(spark):
    import base64 as plain

    data = bytes(range(256))
    assert spark.createDataFrame([(data,)], "b binary").select(base64(F.col("b"))).first()[0] == plain.b64encode(data).decode()
