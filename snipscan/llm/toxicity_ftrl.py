"""Toxicity: logistic regression over hashed word n-grams and skip-grams, learnt by FTRL-proximal.

Every coordinate has a learning rate of its own, and the L1 term keeps most weights at exactly zero, so what goes to the
executors is a short list of (coordinate, weight). A feature counts once per text, however long the text is.

Null and empty texts have no feature: their score is the logistic of the intercept; a very long text is read whole. Repeated
rows get equal scores, and a score of just 0.5 counts as toxic. Without labelled rows each score is 0.5. An empty table gives
an empty result. Columns of the input are never overwritten: a result whose name is taken gets underscores before it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipscan.llm.common import bounded_sample, discard, free_name, held_out, materialize, small_batches
from snipscan.llm.textwords import U64, Words, chunks, mix

#: Labelled rows of each kind that training sees at most, and the distinct coordinates of all of them together. Rows are taken
#: in the order of a hash of their ids up to these bounds, so long texts are learnt from as often as they are labelled.
TRAIN_ROWS, TRAIN_COORDINATES = 5_000, 24_000_000
BITS = 20
ALPHA, BETA, L2, EPOCHS = 1.5, 1.0, 0.2, 6
#: L1 for very many rows, and the rows at which half of it holds: with few rows a gradient sum is small, but chance n-grams of long texts are many.
L1, L1_ROWS = 16.0, 300

_KEEP = bytes(b if b >= 128 or bytes([b]).isalnum() or b in b"'\n" else 32 for b in range(256))
#: Words count by their first bytes too: inflected forms share them.
STEM_BYTES = 5
#: (distance of the second word, seed): single words, bigrams and two skip-grams.
_SHAPES = ((0, 0x1), (1, 0x2), (2, 0x3), (3, 0x4))


def _clean(texts: pa.Array) -> list[bytes]:
    return [x.lower().encode().translate(_KEEP) if x else b"" for x in texts.to_pylist()]


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, coordinate) of each word, stem, bigram and skip-gram, repeats included."""
    words = Words(texts)
    h = words.hashes()
    doc, at = [], []
    for gap, seed in _SHAPES:
        if len(h) <= gap:
            continue
        first = h[: len(h) - gap] if gap else h
        same = words.doc[gap:] == words.doc[: len(h) - gap]
        key = first if not gap else mix(first * U64(0xD6E8FEB86659FD93) + h[gap:])
        doc.append(words.doc[gap:][same])
        at.append((mix(key[same] + U64(seed)) >> U64(64 - BITS)).astype(np.int64))
    if len(h):
        doc.append(words.doc)
        at.append((mix(words.hashes(STEM_BYTES) + U64(0x5)) >> U64(64 - BITS)).astype(np.int64))
    return (np.concatenate(doc), np.concatenate(at)) if doc else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Weights:
    at: np.ndarray
    weight: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.at] = self.weight
        return out


def logits(table: np.ndarray, intercept: float, texts: list[bytes]) -> np.ndarray:
    """Only n-grams of a non-zero weight are made distinct, which are few."""
    out = np.full(len(texts), intercept)
    for lo, hi in chunks(texts):
        doc, at = _hashed(texts[lo:hi])
        live = table[at] != 0
        once = np.unique((doc[live] << BITS) | at[live])
        out[lo:hi] += np.bincount(once >> BITS, table[once & ((1 << BITS) - 1)], hi - lo)
    return out


def fit_ftrl(rows: list[np.ndarray], y: np.ndarray, seed: int = 3) -> Weights:
    """``rows``: the distinct coordinates of each text. The intercept is a coordinate without L1."""
    if not len(y):
        return Weights(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0)
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1 = np.full(size + 1, L1 * len(y) / (len(y) + L1_ROWS))
    l1[size] = 0.0
    rng = np.random.default_rng(seed)

    def weights(i: np.ndarray) -> np.ndarray:
        s = np.maximum(np.abs(z[i]) - l1[i], 0.0)
        return -np.sign(z[i]) * s / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for k in rng.permutation(len(y)):
            i = np.append(rows[k], size)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y[k]
            root = np.sqrt(n[i])
            z[i] += g - (np.sqrt(n[i] + g * g) - root) / ALPHA * w
            n[i] += g * g
    w = weights(np.arange(size + 1))
    at = np.flatnonzero(w[:size])
    return Weights(at, w[at].astype(np.float32), float(w[size]))


def sample(docs: DataFrame, labels: DataFrame, bound: int, seed: int) -> DataFrame:
    """doc_id, label, rank and the distinct coordinates ``at`` of the whole text, for at most ``bound`` labelled rows of each kind that aren't held out."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def coordinates(texts: pa.Array) -> pa.Array:
        clean = _clean(texts)
        out: list[np.ndarray] = []
        for lo, hi in chunks(clean):
            doc, at = _hashed(clean[lo:hi])
            once = np.unique((doc << BITS) | at)
            cuts = np.searchsorted(once >> BITS, np.arange(1, hi - lo))
            out += np.split((once & ((1 << BITS) - 1)).astype(np.int32), cuts)
        return pa.array(out, pa.list_(pa.int32()))

    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label is not null").where(~held_out(F.col("doc_id"), 5, 0))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = bounded_sample(known.where("label = 0"), ["doc_id"], bound, seed).unionByName(bounded_sample(known.where("label = 1"), ["doc_id"], bound, seed))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "label", coordinates.asNondeterministic()("text").alias("at"))
    once = rows.groupBy("doc_id", "label").agg(F.min("at").alias("at"))  # of rows with the same id, one
    return materialize(once.withColumn("rank", F.xxhash64("doc_id", F.lit(seed))), "toxicity-sample")


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS, most: int = TRAIN_COORDINATES, seed: int = 3) -> Weights:
    """Fit on the sample, in the order of the rows' hashes, as far as ``most`` coordinates go."""
    known = sample(docs, labels, bound, seed)
    sizes = known.select("rank", F.size("at").alias("n")).toPandas().sort_values("rank", kind="stable")
    fit = sizes["rank"][sizes["n"].cumsum() <= most]
    got = known.where(F.col("rank") <= int(fit.iloc[-1])).select("rank", "label", "at").toArrow().combine_chunks() if len(fit) else None
    discard(known)
    if got is None:
        return fit_ftrl([], np.zeros(0), seed)
    lists = got.column("at").combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    order = np.argsort(got.column("rank").to_numpy(), kind="stable")
    return fit_ftrl([flat[ends[i] : ends[i + 1]] for i in order], got.column("label").to_numpy()[order].astype(np.float64), seed)


def score_toxicity(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with ``_held_out`` and ``_score`` as the last columns (more underscores where the names are taken); labels of held-out rows are never read by the training."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, bound))
    tables: dict[int, np.ndarray] = {}

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if 0 not in tables:
            tables[0] = weights.value.table()
        return pa.array(1 / (1 + np.exp(-np.clip(logits(tables[0], weights.value.intercept, _clean(texts)), -30, 30))))

    held, name = free_name(docs, "_held_out"), free_name(docs, "_score")
    return docs.withColumns({held: held_out(F.col("doc_id"), 5, 0), name: score.asNondeterministic()(F.col("text"))})
