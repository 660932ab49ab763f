"""The registered queries against their SQL twins on the smallest tables.

All of them run; SAMPLE=1 runs every sixth.
"""
import os

import pytest
from compare import check, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = sorted(QUERIES)[::6] if os.environ.get("SAMPLE") else sorted(QUERIES)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) >= 5 and all(r["value"] > 0 for r in rows)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    problem = check(spark, duck, name, QUERIES[name], ORACLES.get(name), SF)
    assert problem is None or problem.startswith("near"), problem
