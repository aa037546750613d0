"""Queries against their SQL over keys longer than those of the small tables."""

from __future__ import annotations

import pytest
from compare import connect, differences
from snipscan.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
USERS = (0, 9_999, 10_000, 89_999, 123_456, 9_999_999)


@pytest.fixture(scope="module")
def longer(tmp_path_factory):
    """Events of each type by users whose ids have one to seven digits, and a connection that sees them."""
    con, folder = connect(SF), tmp_path_factory.mktemp("longer")
    con.sql(f"create table kinds as select event_type, min(ts) as ts, any_value(props) as props from '{SF}/events.parquet' group by 1")
    con.sql(f"copy (select 7000000 + row_number() over () as event_id, ts, user_id, event_type, 1.5 as value, props from kinds, (select unnest({list(USERS)}::bigint[]) as user_id)) to '{folder}/events.parquet' (format parquet)")
    con.sql(f"create or replace view events as select * from '{folder}/events.parquet'")
    return con, str(folder)


@pytest.mark.parametrize("name", ["dashboards", "whole_pages"])
def test_equals_sql(spark, longer, name):
    con, folder = longer
    assert differences(QUERIES[name](spark, folder), con, ORACLES[name]) == []
