"""Both margins of a sample hold."""

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from ordina.operators import sampling
from ordina.sources.tables import units

SF = "/root/testdata/sf0.001"


def beside(whole, exact):
    return (abs(whole - exact) < 1 - 1e-6).all() or (abs(whole - np.floor(exact + 1e-6)) < 1e-6).any() and (abs(whole - exact) < 1 + 1e-6).all()


@settings(deadline=None, max_examples=150)
@given(arrays(int, st.tuples(st.integers(1, 7), st.integers(1, 5)), elements=st.integers(0, 30)), st.integers(1, 60))
def test_controlled_rounding(counts, size):
    if not counts.sum():
        return
    exact = counts * min(1.0, size / counts.sum())
    whole = sampling.controlled(exact)
    assert beside(whole, exact) and beside(whole.sum(1), exact.sum(1)) and beside(whole.sum(0), exact.sum(0)) and abs(whole.sum() - exact.sum()) < 1e-6
    assert (whole <= counts).all() and (whole >= 0).all()


def test_two_margins(spark):
    u = units(spark, SF).collect()
    band = lambda r: min(int(r["human_mean"]), 9)
    rows = sampling.two_margin_sample(spark, SF).collect()
    assert len(rows) == 100 and len({r["paper_id"] for r in rows}) == 100
    for of, own in ((lambda r: (r["area"], band(r)), lambda r: (r["area"], r["band"])), (lambda r: r["status"], lambda r: r["status"]), (lambda r: (r["area"], band(r), r["status"]), lambda r: (r["area"], r["band"], r["status"]))):
        every, some = Counter(map(of, u)), Counter(map(own, rows))
        assert all(abs(some[k] - n * 100 / len(u)) < 1 for k, n in every.items()) and set(some) <= set(every)
    again = sampling.two_margin_sample(spark, SF).collect()
    assert {r["paper_id"] for r in again} == {r["paper_id"] for r in rows}


def test_small_tables_with_nulls(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "y"), (3, "a", None), (4, "a", "x")], "k bigint, s string, m string")
    assert {r["k"] for r in sampling.two_margins(df, ["s"], "m", "k", 9).collect()} == {1, 2, 3, 4}
    assert sampling.two_margins(df, ["s"], "m", "k", 2).count() == 2
    assert sampling.two_margins(df.limit(0), ["s"], "m", "k", 2).count() == 0


def test_ranked_draws_broadcast_only_the_ranges_before(spark):
    from ordina.operators.panel import bootstrap_ranked

    u = spark.range(1000).selectExpr("id AS paper_id", "CAST(id % 46 AS DOUBLE) AS x", "CAST(id * 7 % 1000 AS DOUBLE) AS y")
    plan = bootstrap_ranked(u, "paper_id")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join Inner" in line]
    assert joins and all("rightHint=(strategy=broadcast)" in line for line in joins)
