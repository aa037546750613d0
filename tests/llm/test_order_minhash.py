from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from snipscan.llm import buckets, skew
from snipscan.llm import order_minhash as om
from snipscan.llm.buckets import by_sifted_counts, by_counts, crowded, link_buckets
from snipscan.llm.common import materialize
from snipscan.llm.components import connected_components
from snipscan.llm.queries import QUERIES


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def similar(s, t):
    a, b = words_of(s), words_of(t)
    if not a or not b:
        return (s or "") == (t or "")
    if sum((collections.Counter(a) & collections.Counter(b)).values()) < 0.8 / 1.8 * (len(a) + len(b)):
        return False
    m = lcs(a, b)
    return m / (len(a) + len(b) - m) >= 0.8


def brute(rows):
    """Classes by comparing every pair of texts whose lengths allow it."""
    first = {}
    for i, t in rows:
        first.setdefault(t or "", []).append(i)
    texts = sorted(first, key=lambda t: len(words_of(t)))
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    n = [len(words_of(t)) for t in texts]
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if n[b] > n[a] / 0.8:
                break
            if find(texts[a]) != find(texts[b]) and similar(texts[a], texts[b]):
                parent[find(texts[a])] = find(texts[b])
    low = {}
    for t, ids in first.items():
        low[find(t)] = min(low.get(find(t), min(ids)), *ids)
    return {i: low[find(t or "")] for i, t in rows}


def edited(words, n, rng):
    out = list(words)
    for _ in range(min(n, len(out) - 1)):
        i = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.5:
            out[i] = f"new{rng.random()}"
        elif kind < 0.75:
            del out[i]
        else:
            out.insert(i, f"more{rng.random()}")
    return out


def classes(docs):
    return {r.doc_id: r.class_id for r in om.near_classes(docs).collect()}


def test_near_copies_against_brute_force(make):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(25):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([8, 30, 120, 400]))]
        for c in range(rng.choice([1, 2, 3, 8])):
            words = edited(base, rng.choice([0, 0, 1, 2, len(base) // 60, len(base) // 20]), rng)
            rows.append(words)
    rows += [passage + [f"u{k}_{i}" for i in range(rng.choice([5, 14, 40]))] for k in range(60)]
    rows += [[], [], ["one"], ["one"], ["Two", "words"], ["two", "WORDS"]]
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    assert classes(make(rows)) == brute(rows)


def test_query_on_the_table(spark, documents, sf):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert {r.doc_id: r.class_id for r in QUERIES["op10_order_minhash"](spark, sf).collect()} == brute(rows)


def test_near_copies_of_the_large_table_are_found(spark):
    """Planted near copies differ in up to a tenth of their words; all pairs of distinct texts that share rare words are compared."""
    folder = "/root/testdata/sf0.1"
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in QUERIES["op10_order_minhash"](spark, folder).collect()}
    class_of = {t: got[i] for i, t in rows}
    texts = sorted(class_of)
    bags = [collections.Counter(words_of(t)) for t in texts]
    holders = collections.defaultdict(list)
    for k, bag in enumerate(bags):
        for w in bag:
            holders[w].append(k)
    shared = collections.Counter(p for ks in holders.values() if 2 <= len(ks) <= 12 for i, a in enumerate(ks) for p in ((a, b) for b in ks[i + 1 :]))
    pairs = [(a, b) for (a, b), n in shared.items() if sum((bags[a] & bags[b]).values()) >= 0.8 / 1.8 * (bags[a].total() + bags[b].total())]
    near = []
    for a, b in pairs:
        code = {w: i for i, w in enumerate(bags[a] | bags[b])}
        x, y = (np.array([code[w] for w in words_of(texts[k])], np.uint64) for k in (a, b))
        if om.ordered_similarity(x, y) >= 0.8:
            near.append((a, b))
    assert len(near) > 500
    missed = [p for p in near if class_of[texts[p[0]]] != class_of[texts[p[1]]]]
    assert len(missed) <= 0.01 * len(near)


def test_order_matters(make):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words[100:] + words[:100])), (3, " ".join(words[:190]))]
    assert classes(make(rows)) == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("seed", range(5))
def test_alignment_is_exact_where_it_counts(seed):
    rng = random.Random(seed)
    for _ in range(60):
        a = [rng.randrange(9) for _ in range(rng.randrange(1, 70))]
        b = edited(a, rng.randrange(9), rng)
        code = {v: i for i, v in enumerate(dict.fromkeys(map(str, a + b)))}
        x, y = (np.array([code[str(v)] for v in s], np.uint64) for s in (a, b))
        m = lcs(a, b)
        true = m / (len(a) + len(b) - m) if b else 0.0
        got = om.ordered_similarity(x, y)
        assert (got >= 0.8) == (true >= 0.8) and (true < 0.8 or abs(got - true) < 1e-9)


def test_bags_never_rule_out_like_texts():
    import pyarrow as pa

    rng = random.Random(6)
    a, b = [], []
    for n in (0, 1, 5, 40, 300, 3_000):
        for edits in (0, 1, n // 10, n // 9, n):
            words = [f"w{rng.randrange(200)}" for _ in range(n)]
            a.append(" ".join(words))
            b.append(" ".join(edited(words, edits, rng)) if n > 1 else a[-1])
    room = om.may_be_like(om.bags(pa.array(a)), om.bags(pa.array(b))).to_pylist()
    assert all(r for r, s, t in zip(room, a, b, strict=True) if similar(s, t)) and not all(room)
    many = pa.array(["x " * 70_000, "x " * 140_000])
    assert om.may_be_like(om.bags(many), om.bags(many.take(pa.array([1, 0])))).to_pylist() == [True, True]


def test_window_slides_over_long_texts():
    x = np.random.default_rng(0).integers(0, 1 << 60, 20_000).astype(np.uint64)
    y = np.delete(x, np.arange(50, 19_000, 40))
    assert abs(om.ordered_similarity(x, y) - len(y) / len(x)) < 1e-9


def test_one_of_each_group_stays(make):
    text = " ".join(f"w{i}" for i in range(100))
    docs = make([(5, text), (3, text + " end"), (3, text + " end"), (9, "other words stand here and nothing else"), (None, text), (7, None), (8, ""), (None, "alone without an id"), (None, "alone without an id"), (3, "the same id with other words")], {"class_id": "c", "rep": "r", "digest": "d"})
    out = om.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out.collect()) == [(False, 0), (True, 3), (True, 3), (True, 7), (True, 9)]
    got = collections.Counter((r.doc_id, r.class_id) for r in om.near_classes(docs).collect())
    assert got == {(5, 3): 1, (3, 3): 3, (9, 9): 1, (None, 3): 1, (7, 7): 1, (8, 7): 1, (None, None): 2}
    assert om.near_classes(docs.limit(0)).count() == 0 and om.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("split", [False, True])
def test_components(spark, monkeypatch, split):
    if split:  # hubs and large classes are dealt over several tasks
        monkeypatch.setattr(skew, "SPLIT_ROWS", 3)
        monkeypatch.setattr(skew, "HOT", 20)
    edges = [(i, i + 1) for i in range(10, 60)] + [(1, 2), (2, 3), (3, 1), (100, 200)] + [(500, i) for i in range(501, 600)]
    got = {r.id: r["class"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 10 for i in range(10, 61)} | {1: 1, 2: 1, 3: 1, 100: 100, 200: 100} | {i: 500 for i in range(500, 600)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_copies_that_only_their_original_joins(make):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    rows = [(400, " ".join(base))]
    for i in range(801):
        if i != 400:
            words = list(base)
            for at in rng.sample(range(0, 195, 6), 3):
                words[at : at + 5] = [f"x{i}_{at + k}" for k in range(5)]
            rows.append((i, " ".join(words)))
    assert all(similar(rows[0][1], t) for _, t in rows) and sum(similar(rows[1][1], t) for _, t in rows[2:]) < 80
    assert set(classes(make(rows)).values()) == {0}


@pytest.mark.parametrize("first", [by_counts, by_sifted_counts])
def test_bucket_of_a_chain_is_linked_whole(spark, first):
    sets = [(r, [r * 2 + k for k in range(40)]) for r in range(120)] + [(500 + r, [10_000 * r + k for k in range(40)]) for r in range(1, 30)]
    random.Random(3).shuffle(sets)
    table = spark.createDataFrame(sets, "rep bigint, items array<bigint>").cache()
    met = crowded(table.selectExpr("1L as key", "rep", "size(items) as n"))

    def verify(pairs):
        both = pairs.join(table.selectExpr("rep as a", "items as x"), "a").join(table.selectExpr("rep as b", "items as y"), "b")
        return materialize(both.where("size(array_intersect(x, y)) >= 0.8 * size(array_union(x, y))").select("a", "b"), "links")

    got = {r.id: r["class"] for r in link_buckets(met, verify, 0.8, 3, lambda some: table.join(some, "rep"), first).collect()}
    assert got == {r: 0 for r in range(120)}


def rows_of_leaders(spark, run):
    """How many rows the explode of a second round's leaders makes while ``run`` runs, from Spark's own counts."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    begun = store.executionsCount()
    run()
    bus.waitUntilEmpty()
    made = []
    for k in range(begun, store.executionsCount()):
        execution = store.executionsList().apply(k).executionId()
        nodes, values = store.planGraph(execution).allNodes(), store.executionMetrics(execution)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if node.name() == "Generate" and "leads" in node.desc():
                metrics = node.metrics()
                ids = [m.accumulatorId() for m in (metrics.apply(i) for i in range(metrics.size())) if m.name() == "number of output rows"]
                made += [int(values.get(i).get().replace(",", "")) for i in ids if values.contains(i)]
    assert len(made) == 1
    return made[0]


def test_second_round_makes_only_rows_that_class_and_size_allow(spark):
    base = list(range(10_000, 10_040))
    sets = [(r, [*base[:38], 2 * r, 2 * r + 1]) for r in range(300)] + [(900 + r, [100_000 * (r + 1) + k for k in range(60)]) for r in range(5)]
    table = spark.createDataFrame(sets, "rep bigint, items array<bigint>").cache()
    met = crowded(table.selectExpr("1L as key", "rep", "size(items) as n"))

    def verify(pairs):
        both = pairs.join(table.selectExpr("rep as a", "items as x"), "a").join(table.selectExpr("rep as b", "items as y"), "b")
        return materialize(both.where("size(array_intersect(x, y)) >= 0.8 * size(array_union(x, y))").select("a", "b"), "links")

    found = []
    made = rows_of_leaders(spark, lambda: found.extend(link_buckets(met, verify, 0.8, 3, lambda some: table.join(some, "rep"), by_counts).collect()))
    assert {r.id: r["class"] for r in found} == {r: 0 for r in range(300)}
    # only the five others, of another size, may be alike: each of three leaders meets at most four of them, not all 305 members
    assert 0 < made <= 3 * 4


def python_steps(plan):
    """The Python steps of each stage of a finished plan: exchanges and broadcasts part stages."""
    steps, path = collections.Counter(), []
    for line in plan.split("== Initial Plan ==")[0].splitlines():
        depth = len(re.match(r"[ :+*-]*", line)[0])
        name = re.sub(r"^\(\d+\) ", "", line[depth:])
        path = [p for p in path if p[0] < depth]
        stage = path[-1][1] if path else 0
        if re.search("Exchange", name):
            stage = len(steps) + 1
            steps[stage] = 0
        elif re.match("ArrowEvalPython|MapInArrow", name):
            steps[stage] += 1
        path.append((depth, stage))
    return steps


def test_no_stage_holds_two_python_steps(make, monkeypatch):
    plans = {}

    def seen(df, name):
        df.collect()
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, name)

    monkeypatch.setattr(om, "materialize", seen)
    monkeypatch.setattr(buckets, "materialize", seen)
    rng = random.Random(5)
    rows = []
    for i in range(40):
        words = [f"v{rng.randrange(10**6)}" for _ in range(120)]
        rows.append((10 * i, " ".join(words)))
        rows += [(10 * i + k, " ".join(edited(words, n, rng))) for k, n in ((1, 2), (2, 40), (3, 45))]
    found = classes(make(rows))
    assert all(found[10 * i] == found[10 * i + 1] for i in range(40))
    assert {"links", "unlinked-sets"} <= set(plans)
    assert any("MapInArrow" in p for p in plans.values())
    assert {name: max(python_steps(p).values(), default=0) for name, p in plans.items() if max(python_steps(p).values(), default=0) > 1} == {}
