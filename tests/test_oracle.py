"""Every registered query against its SQL statement, whole results, on the smallest tables."""

import contextlib
import io

import pytest
from oracle import connect, differences

import __spark_entry__ as entry_module
from tallyforge.plans import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


# All pairs of two tables, and Python called for each row or batch.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def explained(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = explained(df)
    assert not [node for node in FORBIDDEN if node in plan]
    if name in ORACLES:
        assert differences(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry_contract(spark):
    assert entry_module.entry(spark).columns == ["event_type", "n_users"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
