from __future__ import annotations

import hashlib
import random

import pytest

from compare import connect, differences
from snipscan.llm import decontamination as dc
from snipscan.llm.queries import ORACLES, QUERIES
from test_importance import words


def brute(docs, items, size=10):
    found = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            found.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, which = words(text), set(), set()
        for n in {len(x) for x in found}:
            for k in range(len(w) - n + 1):
                of = found.get(tuple(w[k : k + n]))
                if of:
                    which |= of
                    hit.update(range(k, k + n))
        out.append((i, len(w), len(hit), len(which), hashlib.sha256(",".join(sorted(which)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def items_of(spark, rows, extra=()):
    df = spark.createDataFrame(rows, "item_id bigint, text string")
    return df.selectExpr("*", *[f"'x' as {c}" for c in extra])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    sf = f"/root/testdata/{sf}"
    df = QUERIES["op13_decontamination"](spark, sf)
    assert df.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean")]
    got = told(df)
    assert got == brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    assert any(r[5] for r in got) and differences(df, connect(sf), ORACLES["op13_decontamination"]) == []


def test_few_words_everywhere(spark, make, monkeypatch):
    """Texts of six words, so that shingles and windows recur in many places; short items; hot shingles dealt over tasks."""
    monkeypatch.setattr("snipscan.llm.skew.SPLIT_ROWS", 100)
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice("abcdeä") for _ in range(n))
    items = [(k, some(n)) for k, n in enumerate([1, 2, 3, 4, 5, 6, 9, 10, 11, 14, 30])]
    docs = [(i, some(rng.choice([0, 1, 3, 9, 10, 40, 200]))) for i in range(200)] + [(i, f"{items[10][1]}, {items[9][1].upper()}") for i in range(200, 400)]
    assert told(dc.decontaminate(make(docs), items_of(spark, items))) == brute(docs, items)
    assert told(dc.decontaminate(make(docs), items_of(spark, items[6:]), size=7)) == brute(docs, items[6:], 7)


def test_odd_rows(spark, make):
    passage = "One two THREE four-five six seven, eight nine ten eleven twelve"
    items = [(1, passage), (1, "another text of the same item with more than ten words in it"), (2, passage), (None, passage + " thirteen"), (3, None), (4, ""), (5, "... !")]
    docs = [(1, f"x {passage} y"), (1, f"x {passage} y"), (None, passage), (2, None), (3, ""), (4, "two three four five six seven eight nine ten"), (5, "w " * 60_000 + passage), (6, passage.replace("six", "sixth")), (7, "five six seven eight nine ten eleven twelve thirteen"), (8, f"{passage} {passage}")]
    extra = ("row", "window", "of", "item", "shingle", "at", "n", "place")
    assert told(dc.decontaminate(make(docs, {c: "0" for c in ("item_id", "row", "id", "places", "n_words")}), items_of(spark, items, extra))) == brute(docs, items)
    assert dc.decontaminate(make(docs).limit(0), items_of(spark, items)).count() == 0
    assert told(dc.decontaminate(make(docs), items_of(spark, items).limit(0))) == brute(docs, [])


def test_a_full_field_loses_nothing(spark, make, monkeypatch):
    """With a field of so few bits that it lets all pass, the words decide."""
    monkeypatch.setattr("snipscan.llm.bitfield.LOG_BITS", (7, 7))
    docs, items = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(40))) for i in range(60)], [(9, " ".join(f"w{k}" for k in range(3, 30)))]
    assert told(dc.decontaminate(make(docs), items_of(spark, items))) == brute(docs, items)


def test_plan(spark, make):
    """The windows of items meet documents by a join on the rarest shingle; no cross join, nothing in one task."""
    df = dc.decontaminate(make([(1, "a b c d e f g h i j k")]), items_of(spark, [(1, "b c d e f g h i j k")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "SinglePartition" not in plan
