"""Quality rules: hard limits on words, then an isolation forest over the rule statistics.

A document fails the base rules with fewer than ``min_words`` words or with over half of its words in repeated windows. Of
the others, the forest finds those whose statistics random splits set apart after few cuts; the score beyond which a
document goes is calibrated on rows with a quality label.

The forest is grown on rows labelled good, each statistic on the scale of their own spread. A cut falls anywhere in the box
that all labelled rows span, not only among the rows of its node: so regions without a good row arise, and a document that
falls into one has a short path. (Cuts among a node's rows alone can't tell what lies beyond the good rows, and bad rows in
the sample, being many and alike, hide one another.)

Nulls and empty texts count as texts of no word and fail the base rules; a very long text is counted whole. Repeated rows
and ties of the score get equal verdicts. An empty table gives an empty result. Without labelled rows of good quality nothing
is rejected beyond the base rules. Columns of the input are never overwritten: a result whose name is taken gets underscores before it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipscan.llm.common import bounded_sample, free_name, small_batches
from snipscan.llm.textstats import COUNTS, FEATURES, features, text_counts
from snipscan.llm.textwords import as_bytes

#: Rows that the forest and its calibration see at most.
SAMPLE_ROWS = 12_000
TREES, TREE_ROWS, DEPTH = 128, 256, 8
#: Share of good labelled rows that the calibrated threshold may cost at most.
MAX_GOOD_LOSS = 0.005
#: How far the box reaches beyond all labelled rows, and the threshold above all scores when no labelled row lies beyond it.
MARGIN, LOOSE = 0.5, 0.02
#: The rule statistics that the forest sees, and the least spread that counts as one: a word in fifty.
STATISTICS = ["word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "bang_share", "pipe_share", "distinct_share", "gram_share"]
LEAST_SPREAD = 0.02
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, np.float64)
    big = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(big - 1) + 0.5772156649) - 2 * (big - 1) / big, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Complete binary trees in heap order: the node's column (-1 at a leaf), its cut, and the path length that a leaf stands for."""

    centre: np.ndarray
    spread: np.ndarray
    column: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    norm: float
    threshold: float = np.inf

    def score(self, statistics: np.ndarray) -> np.ndarray:
        """Anomaly in (0, 1); higher is odder."""
        x = scaled(statistics, self.centre, self.spread)
        out = np.empty(len(x))
        tree = np.arange(len(self.column))[None, :]
        for lo in range(0, len(x), 2048):
            part = x[lo : lo + 2048]
            node = np.zeros((len(part), tree.shape[1]), np.int64)
            row = np.arange(len(part))[:, None]
            for _ in range(DEPTH):
                c = self.column[tree, node]
                right = part[row, np.maximum(c, 0)] >= self.cut[tree, node]
                node = np.where(c < 0, node, 2 * node + 1 + right)
            out[lo : lo + 2048] = 2 ** (-self.path[tree, node].mean(axis=1) / self.norm)
        return out


def scaled(statistics: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Statistics on the scale of the good rows' spread; far values are drawn in."""
    return np.arcsinh((statistics - centre) / spread)


def fit_forest(good: np.ndarray, others: np.ndarray, seed: int = 11) -> Forest:
    """TREES trees, each over TREE_ROWS rows of ``good`` drawn without replacement, in the box of all rows and a little around it."""
    centre = np.median(good, axis=0)
    spread = np.maximum(np.quantile(np.abs(good - centre), 0.9, axis=0), LEAST_SPREAD)
    x = scaled(good, centre, spread)
    every = np.concatenate((x, scaled(others, centre, spread)))
    box = every.min(axis=0) - MARGIN, every.max(axis=0) + MARGIN
    rng = np.random.default_rng(seed)
    nodes = 2 ** (DEPTH + 1) - 1
    column, cut, path = np.full((TREES, nodes), -1), np.zeros((TREES, nodes)), np.zeros((TREES, nodes))
    take = min(TREE_ROWS, len(x))
    for t in range(TREES):
        todo = [(0, 0, x[rng.choice(len(x), take, replace=False)], *box)]
        while todo:
            node, depth, rows, low, high = todo.pop()
            if depth == DEPTH or not len(rows):
                path[t, node] = depth + _mean_path(len(rows))
                continue
            c = rng.integers(len(low))
            at = rng.uniform(low[c], high[c])
            right = rows[:, c] >= at
            column[t, node], cut[t, node] = c, at
            left_high, right_low = high.copy(), low.copy()
            left_high[c] = right_low[c] = at
            todo += [(2 * node + 1, depth + 1, rows[~right], low, left_high), (2 * node + 2, depth + 1, rows[right], right_low, high)]
    return Forest(centre, spread, column, cut, path, float(max(_mean_path(take), 1)))


def statistics(counts: pd.DataFrame) -> np.ndarray:
    """STATISTICS of each text."""
    return features(counts)[:, [FEATURES.index(k) for k in STATISTICS]]


def base_failed(counts: pd.DataFrame) -> np.ndarray:
    n = counts["n_words"].to_numpy()
    return (n < MIN_WORDS) | (100 * counts["n_repeat_words"].to_numpy() > MAX_REPEAT_PERCENT * n)


_COUNT_TYPE = ", ".join(f"{k}: bigint" for k in COUNTS)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the struct ``_counts`` of the text's COUNTS as its last column."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(f"struct<{_COUNT_TYPE}>")
    def count(texts: pa.Array) -> pa.Array:
        c = text_counts(as_bytes(texts))
        return pa.StructArray.from_arrays([pa.array(c[k].to_numpy(np.int64)) for k in COUNTS], names=COUNTS)

    return docs.withColumn(free_name(docs, "_counts"), count.asNondeterministic()(F.col(text)))


def labelled_counts(docs: DataFrame, labels: DataFrame, column: str, bound: int, seed: int) -> pd.DataFrame:
    """doc_id, the label and COUNTS of at most ``bound`` labelled documents."""
    known = labels.select("doc_id", F.col(column).cast("int").alias("_label")).where("doc_id is not null and _label is not null")
    picked = bounded_sample(known.groupBy("doc_id").agg(F.max("_label").alias("_label")), ["doc_id"], bound, seed)
    rows = with_counts(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))
    return rows.select("doc_id", "_label", "_counts.*").orderBy("doc_id", *COUNTS).limit(bound).toPandas()


def calibrated(good: np.ndarray, bad: np.ndarray) -> float:
    """The threshold where the share of bad rows beyond it less that of good rows is greatest, in the middle of the gap that follows.

    It costs at most MAX_GOOD_LOSS of the good rows. Of equal choices the lowest is taken.
    """
    good, bad = np.sort(good), np.sort(bad)
    cuts = np.unique(np.concatenate((good, bad)))
    cuts = cuts[cuts >= np.quantile(good, 1 - MAX_GOOD_LOSS)]
    beyond = lambda x: 1 - np.searchsorted(x, cuts, "right") / max(len(x), 1)
    best = int(np.argmax((beyond(bad) if len(bad) else 0) - beyond(good)))
    return float(cuts[best] + cuts[best + 1]) / 2 if best + 1 < len(cuts) else float(cuts[best]) + LOOSE


def fit_rules(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS, seed: int = 11) -> Forest | None:
    """The forest over labelled documents that pass the base rules, with its calibrated threshold; None if too few of them are good."""
    known = labelled_counts(docs, labels, "quality", bound, seed)
    known = known[~base_failed(known)].sort_values("doc_id", kind="stable")
    good = (known["_label"] == 1).to_numpy()
    if good.sum() < 20:
        return None
    x = statistics(known[COUNTS])
    forest = fit_forest(x[good], x[~good], seed)
    odd = forest.score(x)
    forest.threshold = calibrated(odd[good], odd[~good])
    return forest


def judge(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``_rules`` as the last column: the counts, ``base_failed``, ``anomaly`` (0 to 1) and ``kept``."""
    small_batches(docs.sparkSession)
    forest = fit_rules(docs, labels, bound)

    @F.arrow_udf(f"struct<{_COUNT_TYPE}, base_failed: boolean, anomaly: double, kept: boolean>")
    def verdict(texts: pa.Array) -> pa.Array:
        c = text_counts(as_bytes(texts))
        failed = base_failed(c)
        odd = forest.score(statistics(c)) if forest and len(c) else np.zeros(len(c))
        kept = ~failed & (odd <= (forest.threshold if forest else np.inf))
        return pa.StructArray.from_arrays([*(pa.array(c[k].to_numpy(np.int64)) for k in COUNTS), pa.array(failed), pa.array(odd), pa.array(kept)], names=[*COUNTS, "base_failed", "anomaly", "kept"])

    return docs.withColumn(free_name(docs, "_rules"), verdict.asNondeterministic()(F.col("text")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    judged = judge(docs, labels)
    return judged.where(F.col(f"`{judged.columns[-1]}`.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
