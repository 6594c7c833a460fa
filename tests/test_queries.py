"""Every registered query beside its SQL, on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from ordina import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    import compare

    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    import compare

    function, sql = registry.queries()[name], registry.oracle_sql().get(name)
    if sql is None:
        assert function(spark, SF).count() > 0
    else:
        assert compare.compare(spark, con, name, function, sql, SF).startswith("ok")


def test_entry_works_without_the_text_operators():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
