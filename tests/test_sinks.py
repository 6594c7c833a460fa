import pytest
from pyspark.errors import AnalysisException

from ordina.sources import sinks


def test_rows_are_never_overwritten(spark, tmp_path):
    df = spark.range(3)
    sinks.write_rows(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 3
    with pytest.raises(AnalysisException):
        sinks.write_rows(df, str(tmp_path / "r"))


def test_only_own_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "p")
    sinks.write_replaced(spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string"), path, ["k"])
    sinks.write_replaced(spark.createDataFrame([(3, "b")], "v int, k string"), path, ["k"])
    assert sorted((r["v"], r["k"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]


def test_summary(spark):
    df = spark.createDataFrame([("ok",), ("failed",), (None,)], "status string")
    assert [tuple(r) for r in sinks.summary(df).collect()] == [("ok", 1), ("unknown", 1), ("failed", 1)]
