"""Queries of the package against their SQL statements, and the contract of the others."""

import pytest
from oracle import connect, differences

import __spark_entry__ as entry_module
from tallyforge.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) is None


def test_every_operator_has_a_query():
    names = entry_module.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(names)


@pytest.mark.parametrize("name", ["op1_mix_sources", "op6_host_quality", "op7_line_runs", "op10_decontaminate"])
def test_native_plans_have_no_python(spark, name, capsys):
    QUERIES[name](spark, SF_DIR).explain()
    plan = capsys.readouterr().out
    assert not [n for n in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin") if n in plan]
