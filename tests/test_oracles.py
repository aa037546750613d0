"""Every query with an oracle gives the SQL's rows."""

from __future__ import annotations

import pytest

from compare import connect, differences
from snipscan.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert {r.band for r in __spark_entry__.entry(spark).collect()} == {"inert", "routine", "check", "read"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
