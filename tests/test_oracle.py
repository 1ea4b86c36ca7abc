"""Every registered query against its DuckDB text on the smallest tables."""

import pytest
from conftest import SMALL
from oracle import compare, connect, plan_of

from ridership.registry import ORACLES, QUERIES

MODELS = sorted(set(QUERIES) - set(ORACLES))
# no row has a missing vehicle at this size
EMPTY_HERE = {"c8_null_vehicle_blocks"}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def check_plan(key):
    """No Python evaluation and no pairing of all rows in a registered query."""

    def check(df):
        plan = plan_of(df)
        for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert node not in plan, f"{key}: {node}"

    return check


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_rows_equal(spark, duck, key):
    diff = compare(spark, duck, SMALL, QUERIES[key], ORACLES[key], check_plan(key))
    if key in EMPTY_HERE:
        assert diff == "empty result"
    else:
        assert diff is None, f"{key}: {diff}"


@pytest.mark.parametrize("key", MODELS)
def test_model_query_has_rows(spark, key):
    assert QUERIES[key](spark, SMALL).limit(1).count() == 1


def test_model_rows_repeat(spark):
    rows = [sorted(map(str, QUERIES["m3_forest"](spark, SMALL).collect())) for _ in range(2)]
    assert rows[0] == rows[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
