"""Whitening of embeddings by their principal components, from a covariance summed tile by tile.

Entries become whole numbers (``floor(256 * entry)``). The fit list holds each distinct vector once. Its rows are cut into blocks
of rows, and each of these into blocks of columns, centred on whole numbers next to the means. The column blocks are shuffled by
their block of rows; there each pair of them (a tile key) is multiplied, and the products are summed by tile before and after a
shuffle. The driver assembles the sums, which are as many numbers as a vector has entries, squared, whatever the number of
vectors, takes what the whole-number centres left off, and finds eigenvalues and unit eigenvectors. Products of whole numbers
below 2**53 are exact in doubles, so the order of tasks and their repetition change nothing.

Rows with a null vector, an empty one, or null, NaN or infinite entries go. Where vectors differ in length, the length with the
most distinct vectors counts (of equals the longest), and the others go. Repeated vectors count once in the fit and each gets its
rows; repeated and null ids are rows like any other. A component without variance has 0 as ``whitened`` and counts neither for
``identity_error``; if no component has any, ``explained`` and ``identity_error`` are 0. A deviation beyond a long is null. An
empty table gives an empty result. Only the id and the vector are read, so other columns of any name change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipscan.llm.common import discard, materialize, small_batches

COMPONENTS, SCALE = 4, 256
#: Columns of a tile, and entries of a block of rows: it has this number divided by the length of a vector, from 256 to 8192 rows.
TILE, ENTRIES = 32, 1 << 20
#: Eigenvalues below this share of the largest are rounding.
FLAT = 1e-12
_BLOCK = "row_block bigint, col_block int, width int, kind string, cells binary"
_LINE = "tile_i int, tile_j int, line int, " + ", ".join(f"c{k} double" for k in range(TILE))


@dataclass
class Fit:
    """What the fit list says: ``n`` vectors with ``sums``, unit ``axes`` as columns by falling ``values``, ``trace`` of the covariance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    def scales(self) -> np.ndarray:
        """1 / sqrt(e) of each component; 0 where it has no variance."""
        live = self.values > FLAT * max(self.values[0], 0.0)
        return np.where(live, 1 / np.sqrt(np.where(live, self.values, 1.0)), 0.0)

    def explained(self) -> list[float]:
        return [float(max(e, 0.0) / self.trace) if self.trace > 0 else 0.0 for e in self.values]


def whole_numbers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x): the rows whose vector is whole, its entries as longs."""
    v = F.col(vector)
    whole = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(v.isNotNull() & F.coalesce(whole, F.lit(False))).select(F.col(key).alias("id"), F.transform(v, lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("bigint")).alias("x"))


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct vector once, as a written table."""
    return materialize(rows.groupBy("x").agg(F.lit(1).alias("_one")).select("x"), "fit-list")


def moments(fit: DataFrame) -> tuple[int, list[int]]:
    """(n, sums by dimension) of the vectors of the length that counts; (0, []) where there are none."""
    cells = fit.select(F.size("x").alias("d"), F.posexplode("x").alias("k", "c"))
    found = cells.groupBy("d", "k").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(19,0)")).alias("s"))
    by_length: dict[int, dict[int, tuple[int, int]]] = {}
    for r in found.toLocalIterator():  # a row for each dimension
        by_length.setdefault(r.d, {})[r.k] = (r.n, int(r.s))
    if not by_length:
        return 0, []
    best = by_length[max(by_length, key=lambda d: (by_length[d][0][0], d))]
    return best[0][0], [best[k][1] for k in sorted(best)]


def matrix(x: pa.Array, dims: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _smallest(block: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as hold them exactly."""
    top = float(np.abs(block).max(initial=0.0))
    return np.ascontiguousarray(block, "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8")


def column_blocks(fit: DataFrame, centres: list[int]) -> DataFrame:
    """Blocks of rows, cut into blocks of TILE columns; a task that runs again makes the same ones."""
    dims, middle = len(centres), np.array(centres, float)
    most = min(8192, max(256, ENTRIES // dims))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32

        def blocks(x: np.ndarray, k: int) -> pa.RecordBatch:
            parts = [_smallest(x[:, lo : lo + TILE]) for lo in range(0, dims, TILE)]
            columns = [[name + k] * len(parts), range(len(parts)), [p.shape[1] for p in parts], [p.dtype.str for p in parts], [p.tobytes() for p in parts]]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["row_block", "col_block", "width", "kind", "cells"])

        held, rows, k = [], 0, 0
        for batch in batches:
            x = matrix(batch.column(0), dims) - middle
            while rows + len(x) >= most:
                full, x = x[: most - rows], x[most - rows :]
                yield blocks(np.concatenate([*held, full]), k)
                held, rows, k = [], 0, k + 1
            if len(x):
                held.append(x)
                rows += len(x)
        if rows:
            yield blocks(np.concatenate(held), k)

    return fit.where(F.size("x") == dims).select("x").mapInArrow(cut, _BLOCK)


def _multiply(blocks: pa.Table) -> pa.Table:
    """The products of all pairs of column blocks of a block of rows, a row for each line of a tile."""
    rows = sorted(blocks.to_pylist(), key=lambda r: r["col_block"])
    parts = [np.frombuffer(r["cells"], r["kind"]).reshape(-1, r["width"]).astype(float) for r in rows]
    keys, lines = [], []
    for i, a in enumerate(parts):
        for j in range(i, len(parts)):
            tile = np.zeros((a.shape[1], TILE))
            tile[:, : parts[j].shape[1]] = a.T @ parts[j]
            keys += [(i, j, k) for k in range(len(tile))]
            lines.append(tile)
    at, cells = np.array(keys, np.int32), np.concatenate(lines)
    names = ["tile_i", "tile_j", "line", *[f"c{k}" for k in range(TILE)]]
    return pa.table([*[pa.array(at[:, k]) for k in range(3)], *[pa.array(np.ascontiguousarray(cells[:, k])) for k in range(TILE)]], names)


def tile_sums(blocks: DataFrame) -> DataFrame:
    """Sums of the tiles' products over all blocks of rows, a row for each line of a tile."""
    products = blocks.groupBy("row_block").applyInArrow(_multiply, _LINE)
    return products.groupBy("tile_i", "tile_j", "line").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(TILE)])


def assemble(sums: DataFrame, dims: int) -> np.ndarray:
    """The whole matrix of products from its tiles."""
    out = np.zeros((dims, dims))
    for r in sums.toLocalIterator():
        lo, hi = r.tile_j * TILE, min(dims, (r.tile_j + 1) * TILE)
        out[r.tile_i * TILE + r.line, lo:hi] = r[3 : 3 + hi - lo]
    return np.triu(out) + np.triu(out, 1).T


def fit_components(fit: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The leading components of the covariance of a written fit list; None if it is empty."""
    n, sums = moments(fit)
    if not n:
        return None
    centres = [round(Fraction(s, n)) for s in sums]
    off = np.array([float(Fraction(s, n) - c) for s, c in zip(sums, centres, strict=True)])
    covariance = assemble(tile_sums(column_blocks(fit, centres)), len(sums)) / n - np.outer(off, off)
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    return Fit(n, sums, axes[:, order], values[order], float(np.trace(covariance)))


def _projector(found: Fit):
    """A column of struct<deviation, whitened> of x."""
    n, sums, dims = found.n, found.sums, found.dims
    centres = [round(Fraction(s, n)) for s in sums]
    off = np.array([float(Fraction(s, n) - c) for s, c in zip(sums, centres, strict=True)])
    axes, scales = found.axes, found.scales()
    wide = max(map(abs, sums))

    def deviations(x: np.ndarray) -> list[int | None]:
        most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + wide
        if dims * most**2 < 2**63:
            return ((n * x - np.array(sums)) ** 2).sum(1).tolist()
        exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
        return [d if d < 2**63 else None for d in exact]

    @F.arrow_udf("struct<deviation: bigint, whitened: array<double>>")
    def project(column: pa.Array) -> pa.Array:
        x = matrix(column, dims)
        w = ((x - np.array(centres, float)) - off) @ axes * scales
        lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), np.ascontiguousarray(w).reshape(-1))
        return pa.StructArray.from_arrays([pa.array(deviations(x), pa.int64()), lists], ["deviation", "whitened"])

    return project.asNondeterministic()  # so that it isn't merged into its uses


def identity_error(fit: DataFrame, found: Fit) -> float:
    """How far the covariance of the whitened fit list is from the identity, in its worst entry."""
    live = [k for k, s in enumerate(found.scales()) if s > 0]
    if not live:
        return 0.0
    w = fit.where(F.size("x") == found.dims).select(_projector(found)("x").getField("whitened").alias("w"))
    pairs = [(i, j) for i in live for j in live if i <= j]
    got = w.agg(*[F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"v{i}_{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(got, pairs, strict=True))


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each row of a whole vector and component."""
    small_batches(vectors.sparkSession)
    rows = whole_numbers(vectors, key, vector)
    fit = fit_list(rows)
    found = fit_components(fit, components)
    if found is None:
        empty = rows.select(F.col("id").alias(key), F.lit(0).alias("component"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("deviation"), *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")])
        return empty.where(F.lit(False))
    error = identity_error(fit, found)
    discard(fit)
    out = rows.where(F.size("x") == found.dims).select("id", _projector(found)("x").alias("p"))
    out = out.select("id", "p.deviation", F.posexplode("p.whitened").alias("k", "whitened"))
    share: Column = F.get(F.array(*map(F.lit, found.explained())), F.col("k"))
    return out.select(F.col("id").alias(key), (F.col("k") + 1).alias("component"), F.lit(found.n).cast("bigint").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
