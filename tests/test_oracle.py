"""Every registered query against its SQL on the smallest tables, and the shape of its plan."""

import re

import pytest
from compare import connect, difference

from __spark_entry__ import entry, oracle_sql, queries

# The training-data operators have tests of their own.
NAMES = [n for n in queries() if n != "pipeline" and not n.startswith("op")]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, con, name):
    df = queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # A window must have a partition key: "windowspecdefinition(" is followed by a column, not by a sort order.
    assert not re.search(r"windowspecdefinition\([^,()]* (ASC|DESC)", plan)
    sql = oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        assert difference(df, con, sql) is None


def test_oracle_names_are_known():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    row = entry(spark).first()
    assert row.is_leakage_free and row.train_rows + row.val_rows + row.test_rows == 200
