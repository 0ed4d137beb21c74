"""Every registered query against its SQL on the smallest tables, and the shape of its plan."""

import re

import pytest

import check_oracle
from __spark_entry__ import entry, oracle_sql, queries
from small_tables import SF


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(SF)


# Windows over one row per partition of a sort, or over a top-seven list.
SMALL_GLOBAL_WINDOWS = {"a01_group_members", "j10_names_with_images", "w01_row_index", "u02_halves", "o03_longest_stages"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Those of the optional part have tests of their own.
OWN_TESTS = re.compile(r"op\d+_|pipeline")


@pytest.mark.parametrize("name", sorted(q for q in queries() if not OWN_TESTS.match(q)))
def test_query(spark, con, name):
    """Result as the SQL says, and a plan without cross joins, whole-table windows and
    row-at-a-time Python."""
    df = queries()[name](spark, SF)
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text
    if name not in SMALL_GLOBAL_WINDOWS:
        # a window without partition keys starts with its ordering
        assert not re.search(r"windowspecdefinition\(\S+ (ASC|DESC)", text)
    message, _, rows = check_oracle.compare(spark, con, name, SF, df)
    assert not message
    assert rows > 0


def test_scan_reads_two_columns(spark):
    assert "ReadSchema: struct<event_type:string,value:double>" in plan(queries()["a23_standard_error"](spark, SF))


def test_filters_reach_the_scan(spark):
    assert "In(event_type, [" in plan(queries()["s09_event_lines"](spark, SF)) or "PushedFilters: [" in plan(queries()["s13_logged_times"](spark, SF))


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert rows and [r["n_yellow"] for r in rows] == sorted(r["n_yellow"] for r in rows)
