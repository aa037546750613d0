from __future__ import annotations

import re
from fractions import Fraction

import numpy as np
import pytest

from snipscan.llm import mixing
from snipscan.llm.queries import QUERIES


def test_targets():
    t = mixing.source_targets({"b": 100, "a": 10, None: 5, "c": 1000})
    assert t == {"a": 30.0, "b": 300.0, "c": 770.0, None: 15.0}
    assert sum(t.values()) == 1115 and mixing.source_targets({}) == {}
    assert mixing.source_targets({"a": 0, "b": 10}) == {"a": 0.0, "b": 10.0}


@pytest.mark.parametrize("shards", [1, 2, 7, 64])
def test_splitting_tree_is_a_partition(shards):
    quotas = np.array([1000, 0, 53, 300])
    parts = [mixing.split_quotas(quotas, shards, s, 5) for s in range(shards)]
    assert (sum(n for _, n in parts) == quotas).all()
    for k, q in enumerate(quotas):
        taken = sorted((f[k], n[k]) for f, n in parts if n[k])
        assert [f for f, _ in taken] == list(np.cumsum([0, *[n for _, n in taken]])[: len(taken)])
    sizes = [n.sum() for _, n in parts]
    assert max(sizes) - min(sizes) <= len(bin(shards))


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def own_targets(sizes):
    """The targets by the contract's words alone, in exact fractions."""
    total = sum(sizes.values())
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    stopped = {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in stopped}
        left = total - sum(stopped.values())
        share = {s: Fraction(left * w, sum(rest.values())) for s, w in rest.items()}
        above = {s: Fraction(3 * sizes[s]) for s, x in share.items() if x > 3 * sizes[s]}
        if not above or len(above) == len(rest):
            return {s: float(x) for s, x in (stopped | share | above).items()}
        stopped |= above


def test_targets_of_random_sources():
    rng = np.random.default_rng(2)
    for n in range(1, 40):
        sizes = {None if k == 3 else f"s{rng.integers(10**6)}é": int(rng.integers(0, 10 ** rng.integers(1, 6))) for k in range(n)}
        got, want = mixing.source_targets(sizes), own_targets(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-6) for s in want)


def check(docs, out):
    rows = [(r.doc_id, r.source, words(r.text)) for r in docs.collect()]
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    target = own_targets(sizes)
    got = sorted((r.doc_id is not None, r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in out)
    assert got == sorted((d is not None, d, n, sizes[s], round(target[s], 6)) for d, s, n in rows)
    assert all(r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in out)
    return target


def test_query(spark, sf, documents):
    out = QUERIES["op7_mixing"](spark, sf).collect()
    target = check(documents, out)
    source = {r.doc_id: r.source for r in documents.collect()}
    for s, t in target.items():
        assert abs(sum(r.taken for r in out if source[r.doc_id] == s) - t) <= max(r.size for r in out if source[r.doc_id] == s)
    again = QUERIES["op7_mixing"](spark, sf).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_partitions_do_not_matter(documents):
    a, b = (sorted((r.doc_id, len(r.draws)) for r in mixing.with_draws(d).select("doc.doc_id", "draws").collect()) for d in (documents, documents.repartition(13)))
    assert a == b


def test_mix_repeats_and_shards(documents, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 3_000)
    drawn = mixing.with_draws(documents, shard_words=3_000)
    from pyspark.sql import functions as F

    rows = drawn.select("doc.doc_id", F.explode("draws").alias("d")).select("doc_id", "d.*").collect()
    assert len(set((r.doc_id, r["pass"]) for r in rows)) == len(rows) and len({r.shard for r in rows}) > 3
    out = mixing.mix(documents)
    assert out.columns == documents.columns and sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in rows)


def test_odd_rows(spark, tmp_path, make):
    rows = [(1, None, "a"), (2, "", "b"), (3, "w " * 40_000, None), (None, "x y", "a"), (4, "p q r", "b"), (4, "p q r", "b"), (5, "one", "")]
    docs = make(rows, {"target": "x", "_size": "y", "_key": "k", "size": "z", "_draws": "d", "doc": "o"})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    check(docs, QUERIES["op7_mixing"](spark, str(tmp_path)).collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and {(r._size, r._key, r.size, r._draws, r.doc) for r in mixed.collect()} == {("y", "k", "z", "d", "o")}
    assert mixing.with_draws(docs.limit(0)).count() == 0 and mixing.mix(docs.where("text = ''")).count() <= 1


def test_many_sources_stay_within_the_generator():
    for rows, sources in ((10**10, 10), (10**10, 100_000), (10**10, 1_000_000), (100, 3)):
        blocks = mixing.blocks_of_source(rows, sources)
        assert blocks >= 1 and blocks * sources * (mixing.CAP + 1) < 10**9
    quotas = np.full(5_000, 199_000)
    first, n = mixing.split_quotas(quotas, 64, 17, 5)
    assert abs(n.sum() - quotas.sum() / 64) <= 64


def test_thousand_sources(make):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 1000:04}") for i in range(3000)]
    out = mixing.with_draws(make(rows), carry=["doc_id", "source"]).select("doc.*", "size", "source_size", "target", "draws").collect()
    taken, target = {}, {r.source: r.target for r in out}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + r.size * len(r.draws)
    assert len(target) == 1000 and abs(sum(target.values()) - sum(r.size for r in out)) < 1e-6
    assert all(abs(taken[s] - t) <= 7 for s, t in target.items())
