from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

from compare import connect
from snipscan.llm import token_rollup as tr
from snipscan.llm.queries import QUERIES
from test_packing import ids


def state(store):
    return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


def test_query(spark, sf, documents):
    want = collections.Counter(), collections.Counter()
    for r in documents.collect():
        want[0][r.source, r.lang] += 1
        want[1][r.source, r.lang] += len(ids(r.text))
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in QUERIES["op9_token_rollup"](spark, sf).collect()}
    assert got == {k: (want[0][k], want[1][k]) for k in want[0]}


def counts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, tokenizer_version string, tokens long")


def test_inserts_deletes_and_revisions(spark):
    old = counts(spark, [(1, "a", "en", "v", 10), (2, "a", "en", "v", 20), (3, None, "en", "v", 5), (4, "b", None, "v", 0)])
    new = counts(spark, [(1, "a", "en", "v", 11), (2, "b", "en", "v", 20), (3, None, "en", "v", 5), (5, "c", "de", "v", 7)])
    store = tr.Rollup(spark)
    assert state(store) == {}
    assert store.commit("load", tr.inserts(old)) and not store.commit("load", tr.inserts(old))
    assert state(store) == {("a", "en", "v"): (2, 30), (None, "en", "v"): (1, 5), ("b", None, "v"): (1, 0)}
    delta = tr.revisions(old, new)
    assert store.commit("revise", delta) and not store.commit("revise", delta)
    assert state(store) == {("a", "en", "v"): (1, 11), ("b", "en", "v"): (1, 20), (None, "en", "v"): (1, 5), ("c", "de", "v"): (1, 7)}
    assert state(tr.Rollup(spark, store.path)) == state(store)
    assert store.commit("drop", tr.deletes(new)) and state(store) == {}
    assert store.commit("nothing", tr.inserts(new.limit(0))) and state(store) == {}


def test_a_snapshot_without_a_log_line_does_not_count(spark):
    store = tr.Rollup(spark)
    store.commit("one", tr.inserts(counts(spark, [(1, "a", "en", "v", 10)])))
    spark.createDataFrame([("a", "en", "v", 9, 9)], tr._TOTALS).write.parquet(f"{store.path}/snapshot-1-torn")
    assert state(store) == {("a", "en", "v"): (1, 10)}


def test_torn_logs_and_two_writers(spark, tmp_path):
    one, two = counts(spark, [(1, "a", "en", "v", 10)]), counts(spark, [(2, "b", "en", "v", 5)])
    (tmp_path / "r" / "log" / "_temporary" / "0").mkdir(parents=True)
    store = tr.Rollup(spark, str(tmp_path / "r"))
    assert state(store) == {} and store.commit("one", tr.inserts(one))
    (tmp_path / "r" / "log" / "000000000001.json").write_text('{"batch_id": "two", "numb')
    (tmp_path / "r" / "log" / "000000000002.json").write_text("")
    assert state(store) == {("a", "en", "v"): (1, 10)}
    assert store.commit("two", tr.inserts(two)) and not store.commit("two", tr.inserts(two))
    other, real, calls = tr.Rollup(spark, store.path), tr.Rollup._create, []

    def late(self, number, line):
        if not calls:
            calls.append(number)
            assert other.commit("three", tr.inserts(two))
        return real(self, number, line)

    store._create = late.__get__(store)
    held = lambda: sorted(p.name for p in (tmp_path / "r").glob("snapshot-*"))
    assert not store.commit("three", tr.inserts(two))
    assert state(store) == {("a", "en", "v"): (1, 10), ("b", "en", "v"): (2, 10)}
    assert len(held()) == 3  # the lost try's is gone
    assert store.vacuum(1) == 2 and len(held()) == 1
    assert state(store) == {("a", "en", "v"): (1, 10), ("b", "en", "v"): (2, 10)}


def test_a_writer_that_never_wins_gives_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tr, "TRIES", 2)
    store = tr.Rollup(spark, str(tmp_path / "r"))
    store._create = lambda number, line: False
    with pytest.raises(RuntimeError, match="lost 2 races"):
        store.commit("one", tr.inserts(counts(spark, [(1, "a", "en", "v", 10)])))
    assert not list((tmp_path / "r").glob("snapshot-*")) and state(tr.Rollup(spark, store.path)) == {}


def test_documents_equal_sql(spark, sf):
    """The counts of documents, as SQL states them."""
    want = connect(sf).sql("select source, lang, count(*) from documents group by all").fetchall()
    assert sorted(want, key=str) == sorted(((r.source, r.lang, r.n_docs) for r in QUERIES["op9_token_rollup"](spark, sf).collect()), key=str)


def test_odd_rows(make):
    docs = make([(1, None), (2, "", None), (3, "w " * 30_000), (3, "one"), (None, "two")], {"tokens": "x", "tokenizer_version": "y"})
    got = sorted(r.tokens for r in tr.token_counts(docs).collect())
    assert got == [0, 0, 1, 1, 30_000]
    assert tr.token_counts(docs.limit(0)).agg(F.count("*")).first()[0] == 0
