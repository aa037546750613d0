"""Facts kept between runs."""

from __future__ import annotations

from snipscan.operators import events
from snipscan.operators.known import FactStore
from snipscan.plans.corpus import snippets

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_new_sources_are_walked(spark, tmp_path):
    store, every = FactStore(spark, str(tmp_path), events.REPORT_PARTS), snippets(spark, SF)
    early = every.where("snippet_id % 10 <> 0")
    n, m = early.select("source").distinct().count(), every.select("source").distinct().count()
    assert store.learn(early) == n and store.new_sources(early).count() == 0 and store.learn(early) == 0
    assert store.learn(every) == m - n
    again = FactStore(spark, str(tmp_path), events.REPORT_PARTS)  # another session finds them
    told = events.reports(every, walked=again.with_facts(every))
    assert "ArrowEvalPython" not in plan(told)
    assert rows(told) == rows(events.reports(every)) == rows(events.reports_once(every).select(*told.columns))


def test_odd_sources_and_other_parts(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "def f(:"), (4, "print(1)"), (5, "print(1)")], "snippet_id int, source string")
    store = FactStore(spark, str(tmp_path), ("parsed", "bytes"))
    assert store.learn(df) == 3  # null is the empty source
    got = {r.snippet_id: r.facts for r in store.with_facts(df).collect()}
    assert got[4] == got[5] and got[4].parsed and not got[3].parsed and got[1] == got[2] and got[1].bytes == 0
    assert store.with_facts(spark.createDataFrame([(9, "x")], df.schema)).first().facts is None
    other = FactStore(spark, str(tmp_path), ("parsed",))
    assert other.path != store.path and other.known().count() == 0 and other.learn(df.limit(0)) == 0
