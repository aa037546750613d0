"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of the text is cut into bins; boosting goes round the features in turn, and at each turn a tree of at most
four leaves over that one feature's bins adds a small step to the feature's lookup table. Then the strongest pairs get
two-way tables in the same manner. A score is the logistic of a sum of table entries.

Null and empty texts get the score of a text of no word; a very long text is counted whole. Repeated rows get equal scores, a
value on a bin's edge belongs to the bin above. Without labels of both kinds each score is the share of good rows, or 0.5. An
empty table gives an empty result. Columns of the input are never overwritten: a result whose name is taken gets underscores before it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipscan.llm.common import free_name, held_out, small_batches
from snipscan.llm.rule_forest import labelled_counts
from snipscan.llm.textstats import COUNTS, features, text_counts
from snipscan.llm.textwords import as_bytes

#: Labelled rows that training sees at most.
TRAIN_ROWS = 16_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 60, 0.15, 2.0


@dataclass
class Gam:
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: np.ndarray = field(default_factory=lambda: np.zeros((0, BINS)))
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: np.ndarray = field(default_factory=lambda: np.zeros((0, PAIR_BINS, PAIR_BINS)))

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, edges in enumerate(self.edges):
            out += self.tables[f][np.searchsorted(edges, x[:, f], side="right")]
        if self.pairs:
            coarse = _binned(x, self.pair_edges)
            for table, (i, j) in zip(self.pair_tables, self.pairs, strict=True):
                out += table[coarse[:, i], coarse[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T]


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)])


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """(bins on the left, gain) of the best cut in two."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0, 0.0
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    k = int(np.argmax(gain))
    return k + 1, float(gain[k])


def _step(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """What a tree of this depth over the bins adds to each bin."""
    at, gain = _cut(g, h) if depth else (0, 0.0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.concatenate((_step(g[:at], h[:at], depth - 1), _step(g[at:], h[at:], depth - 1)))


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, step) of the best pair of cuts, one along each axis."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    n = len(g) - 1
    parts = []
    for c in (cg, ch):
        a = c[:n, :n]
        parts.append((a, c[:n, -1:] - a, c[-1:, :n] - a, c[-1, -1] - c[:n, -1:] - c[-1:, :n] + a))
    gain = sum(_gain(x, y) for x, y in zip(*parts, strict=True))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    step = np.empty_like(g)
    leaf = [x[i, j] / (y[i, j] + RIDGE) for x, y in zip(*parts, strict=True)]
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = leaf
    return float(gain[i, j] - _gain(cg[-1, -1], ch[-1, -1])), step


def fit_gam(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of one-feature tables, then of tables for the PAIRS pairs that gain most."""
    good = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = Gam(base=float(np.log(good / (1 - good))))
    if len(np.unique(y)) < 2:
        return model
    model.edges = _edges(x, BINS)
    model.tables = np.zeros((x.shape[1], BINS))
    fine = _binned(x, model.edges)
    z = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(x.shape[1]):
            g, h = slopes()
            add = RATE * np.clip(_step(np.bincount(fine[:, f], g, BINS), np.bincount(fine[:, f], h, BINS)), -4, 4)
            model.tables[f] += add
            z += add[fine[:, f]]
    model.pair_edges = _edges(x, PAIR_BINS)
    coarse = _binned(x, model.pair_edges)

    def grid(i: int, j: int, w: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[:, i] * PAIR_BINS + coarse[:, j], w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

    g, h = slopes()
    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: (-_quadrants(grid(*p, g), grid(*p, h))[0], p))
    model.pairs = ranked[:PAIRS]
    model.pair_tables = np.zeros((len(model.pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_ROUNDS):
        for table, (i, j) in zip(model.pair_tables, model.pairs, strict=True):
            g, h = slopes()
            add = RATE * np.clip(_quadrants(grid(i, j, g), grid(i, j, h))[1], -4, 4)
            table += add
            z += add[coarse[:, i], coarse[:, j]]
    return model


def score_quality(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS, seed: int = 5) -> DataFrame:
    """``docs`` with ``_held_out`` and ``_score`` as the last columns (more underscores where the names are taken); labels of held-out rows are never read by the training."""
    small_batches(docs.sparkSession)
    known = labelled_counts(docs, labels.where(~held_out(F.col("doc_id"), 3, 1)), "quality", bound, seed).sort_values("doc_id", kind="stable")
    model = fit_gam(features(known[COUNTS]), known["_label"].to_numpy(np.float64))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(features(text_counts(as_bytes(texts)))) if len(texts) else np.zeros(0))

    held, name = free_name(docs, "_held_out"), free_name(docs, "_score")
    return docs.withColumns({held: held_out(F.col("doc_id"), 3, 1), name: score.asNondeterministic()(F.col("text"))})
