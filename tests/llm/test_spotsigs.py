from __future__ import annotations

import hashlib
import re

import pytest

from compare import connect, differences
from snipscan.llm import skew, spotsigs
from snipscan.llm.queries import ORACLES, QUERIES

COMMON = set(spotsigs.anchors())


def signatures(text):
    words = [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]
    content = [w for w in words if w not in COMMON]
    code = lambda *p: int(hashlib.md5(" ".join(p).encode()).hexdigest()[:8], 16) - 2**31
    out = {code("^", *content[:2])} if words else set()
    before = 0
    for w in words:
        if w in COMMON:
            if before + 2 <= len(content):
                out.add(code(w, *content[before : before + 2]))
        else:
            before += 1
    return out


def likeness(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def check(rows, out):
    rows = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    got = sorted(out.collect(), key=lambda r: (r.doc_id, r.fingerprint))
    want = []
    for i, (doc, text) in enumerate(rows):
        text, nxt = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + nxt[:k]
        s, e, n = signatures(text), signatures(edited), signatures(nxt)
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), ",".join(map(str, sorted(s))), ",".join(map(str, sorted(e))), round(likeness(s, e), 9), round(likeness(s, n), 9)))
    want.sort(key=lambda r: (r[0], r[3]))
    assert [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got] == want


def run(spark, tmp_path, make, rows):
    make(rows).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return QUERIES["op3_spotsigs"](spark, str(tmp_path))


def test_against_brute_force(spark, sf, documents):
    check([(r.doc_id, r.text) for r in documents.collect()], QUERIES["op3_spotsigs"](spark, sf))


def test_query_equals_sql(spark, sf):
    assert differences(QUERIES["op3_spotsigs"](spark, sf), connect(sf), ORACLES["op3_spotsigs"]) == []


def test_groups_hand_over(spark, tmp_path, make, monkeypatch):
    monkeypatch.setattr(spotsigs, "GROUP_ROWS", 3)
    rows = [(i * i, f"the start {i} of a chain {i * 7} and the end {i % 3} of it all") for i in range(1, 40)]
    check(rows, run(spark, tmp_path, make, rows))


def test_odd_texts(spark, tmp_path, make):
    rows = [(1, None), (2, ""), (3, "the"), (4, "one"), (5, "ü日本 the x y"), (6, "the a of " * 5_000), (7, "😀 the b c " * 20)]
    check(rows, run(spark, tmp_path, make, rows))
    check(rows[:1], run(spark, tmp_path, make, rows[:1]))


def test_equal_rows_and_empty_table(spark, tmp_path, make):
    out = run(spark, tmp_path, make, [(1, "the same x y"), (1, "the same x y"), (2, "the same x y")]).collect()
    assert len(out) == 3 and len({r.fingerprint for r in out}) == 1
    assert run(spark, tmp_path, make, []).count() == 0


def test_rows_without_an_id_come_first(spark, tmp_path, make):
    for rows in ([(None, "the start of a text x"), (1, "the other one of it all"), (2, "in the end of the third y")], [(None, "the a b c"), (None, "of the d e f g h")]):
        out = run(spark, tmp_path, make, rows)
        assert differences(out, connect_to(tmp_path), ORACLES["op3_spotsigs"]) == []


def connect_to(folder):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    return con


def test_classes_equal_sql(spark, sf):
    assert differences(QUERIES["near_fingerprints"](spark, sf), connect(sf), ORACLES["near_fingerprints"]) == []


def test_edited_texts_are_nearer_than_the_next(spark, sf):
    r = QUERIES["op3_spotsigs"](spark, sf).where("n_chars > 200").toPandas()
    assert (r.near_edited > r.near_next).mean() > 0.98


def test_pruned_likeness(spark):
    df = spark.sql("select array(1,2,3,4,5) a, array(1,2,3,4,6) b, array(1,2,3,4,5) c, sequence(1,50) d")
    from pyspark.sql import functions as F

    got = df.select(*[spotsigs.pruned_likeness(F.col("a"), F.col(x)) for x in "bcd"]).first()
    assert list(got) == [0.0, 1.0, 0.0]


@pytest.mark.parametrize("split", [False, True])
def test_near_classes_against_brute_force(make, monkeypatch, split):
    import random

    if split:
        monkeypatch.setattr(skew, "SPLIT_ROWS", 3)
        monkeypatch.setattr(skew, "HOT", 40)

    rng = random.Random(2)
    rows = []
    for g in range(30):
        base = [rng.choice(["the", "of", "a", "in"]) if rng.random() < 0.4 else f"w{rng.randrange(900)}" for _ in range(rng.choice([20, 80, 200]))]
        for _ in range(rng.choice([1, 2, 5])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"x{rng.random()}"
            rows.append(" ".join(words))
    rows += ["", None, "the", "the"]
    rng.shuffle(rows)
    sets = [signatures(t) for t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if likeness(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.class_id for r in spotsigs.near_classes(make(list(enumerate(rows)))).collect()}
    assert got == {i: find(i) for i in range(len(rows))}
