from __future__ import annotations

import math

import numpy as np
import pytest

from snipscan.llm import whitening
from snipscan.llm.queries import QUERIES


def rows_of(df):
    return {(r.vec_id, r.component): r for r in df.collect()}


def brute(vectors):
    """(n, sums, eigenvalues, axes, trace) of the distinct whole-number vectors."""
    x = np.array(sorted({tuple(math.floor(256 * c) for c in v) for v in vectors}), float)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    return len(x), x.sum(0), values[::-1], axes[:, ::-1], values.sum()


def check(got, vectors: dict):
    n, sums, values, axes, trace = brute(vectors.values())
    top = min(4, len(sums))
    assert len(got) == len(vectors) * top
    signs = {}
    for (i, k), r in got.items():
        x = np.array([math.floor(256 * c) for c in vectors[i]])
        assert r.n == n and r.deviation == sum((n * int(c) - int(s)) ** 2 for c, s in zip(x, sums, strict=True))
        assert r.explained == pytest.approx(values[k - 1] / trace, rel=1e-9) and r.identity_error < 1e-9
        want = (x - sums / n) @ axes[:, k - 1] / math.sqrt(values[k - 1])
        if abs(want) > 1e-3:
            sign = signs.setdefault(k, np.sign(want) * np.sign(r.whitened))
            assert r.whitened == pytest.approx(sign * want, rel=1e-7, abs=1e-9)


def test_query(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    check(rows_of(QUERIES["op11_whitening"](spark, sf)), {r.vec_id: r.embedding for r in table.collect()})


def make(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int")


@pytest.mark.parametrize("dims", [1, 3, 33, 70])
def test_tiles_and_copies(spark, dims, monkeypatch):
    """Several blocks of rows and tiles, far from zero, with a third of the rows being copies."""
    monkeypatch.setattr(whitening, "ENTRIES", 256 * dims)
    rng = np.random.default_rng(dims)
    base = rng.normal(5_000, 2, (600, dims)) * rng.uniform(0.5, 3, dims)
    vectors = {i: base[i].tolist() if i < 600 else base[0].tolist() for i in range(900)}
    got = rows_of(whitening.whiten(make(spark, [(i, v, 0) for i, v in vectors.items()])))
    check(got, vectors)
    assert dims == 1 or {r.n for r in got.values()} == {600}


def test_broken_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = {1: [0.1, 0.2], 2: [-0.3, 0.4], None: [0.5, -0.6], 4: [0.1, 0.2]}
    broken = [(10, None, 0), (11, [], 0), (12, [None, 1.0], 0), (13, [nan, 1.0], 0), (14, [1.0, inf], 0), (15, [-inf, 1.0], 0), (16, [1.0, 2.0, 3.0], 0)]
    df = make(spark, [(i, v, 0) for i, v in good.items()] + broken).selectExpr("vec_id", "embedding", "label as id", "label as x", "label as p")
    got = rows_of(whitening.whiten(df))
    assert {i for i, _ in got} == set(good) and {r.n for r in got.values()} == {3}
    check(got, good)


def test_no_variance_and_nothing(spark):
    same = rows_of(whitening.whiten(make(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])))
    assert len(same) == 4 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, 0.0, 0.0, 0.0) for r in same.values())
    line = rows_of(whitening.whiten(make(spark, [(1, [1.0, 2.0], 0), (2, [3.0, 2.0], 0)])))
    assert [line[1, k].explained for k in (1, 2)] == pytest.approx([1, 0]) and line[1, 2].whitened == 0 and abs(line[1, 1].whitened) == pytest.approx(1)
    none = whitening.whiten(make(spark, [(1, None, 0)]))
    assert none.count() == 0 and none.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]


def test_large_numbers(spark):
    """Beyond a long: the deviation is null, the rest is there."""
    got = rows_of(whitening.whiten(make(spark, [(1, [1e300, 0.0], 0), (2, [3e7, 1.0], 0), (3, [-2e7, 5.0], 0)])))
    assert got[1, 1].deviation is None and len(got) == 6
    small = rows_of(whitening.whiten(make(spark, [(1, [1e6, 0.0], 0), (2, [-1e6, 1.0], 0)], "float")))
    assert small[1, 1].deviation == 4 * 256_000_000**2 + 256**2


def test_plan(spark, sf):
    """Tiles are summed before their shuffle; nothing meets all rows."""
    fit = whitening.fit_list(whitening.whole_numbers(spark.read.parquet(f"{sf}/embeddings.parquet")))
    plan = whitening.tile_sums(whitening.column_blocks(fit, [0] * 64))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and plan.count("Exchange hashpartitioning(tile_i") == 1 and plan.count("HashAggregate(keys=[tile_i") == 2
