"""Packing documents into sequences of at most CAPACITY tokens by patterns of lengths.

A document is its token ids and one end id; only a longer one is cut. The histogram of piece lengths is all that the plan
needs: patterns of a few lengths that nearly fill a sequence are enumerated, non-negative least squares fits how often each
is repeated so that the histogram is used up, the counts are rounded down to what there is, and what remains is packed best
fit, longest first, on counts. Then each piece gets its rank among the pieces of its length and so its place in the plan.

Null and empty texts are one piece of the end id. Repeated rows are packed as often as they stand; pieces that equal one another
in all that is known of them may take one another's places. A very long text is tokenised whole. An empty table gives an empty
result. Only doc_id and text are read, so other columns of any name change nothing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snipscan.llm import tokens
from snipscan.llm.common import materialize, small_batches

CAPACITY, END_ID = 2048, 0
#: Patterns tried in each fit, fits, gradient steps of a fit, and tokens that a pattern may leave empty.
PATTERNS, FITS, STEPS, SLACK = 12_000, 4, 250, 2
#: Pieces of one length are ranked in groups of about so many rows.
GROUP_ROWS, GROUPS_LOW, GROUPS_HIGH = 20_000, 64, 65_536


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with tokens.task_cache(tokenizer) as known:
            for texts in batches:
                out = []
                for ids in known.encode(texts.to_pylist()):
                    ids += END_ID.to_bytes(4, "little")
                    step = 4 * capacity
                    out.append([{"piece": k, "start": k * capacity, "length": len(ids[i : i + step]) // 4, "ids_crc32": zlib.crc32(ids[i : i + step])} for k, i in enumerate(range(0, len(ids), step))])
                yield pa.array(out, pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])))

    return docs.select("doc_id", F.explode(cut.asNondeterministic()("text")).alias("_p")).select("doc_id", "_p.*")


def enumerate_patterns(left: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Patterns of at most four lengths, a row each (0: none), that fill a sequence but for SLACK: all of one or two lengths, and of three or four those that draws by frequency find."""
    have = np.flatnonzero(left)
    below = np.zeros(capacity + 1, np.int64)  # the longest length there is, up to each
    below[have] = have
    below = np.maximum.accumulate(below)
    share = np.cumsum(left[have]) / left.sum()
    first = have[np.searchsorted(share, rng.random(PATTERNS))]
    weight = np.cumsum(left[have] * have) / (left[have] * have).sum()
    first[::2] = have[np.searchsorted(weight, rng.random(len(first[::2])))]
    rows = [np.column_stack((have, below[capacity - have], np.zeros((len(have), 2), np.int64)))]
    second = below[np.minimum(capacity - first, have[np.searchsorted(share, rng.random(PATTERNS))])]
    rows.append(np.column_stack((first, second, below[capacity - first - second], np.zeros(PATTERNS, np.int64))))
    room = capacity - first - second
    third = below[np.minimum(room, have[np.searchsorted(share, rng.random(PATTERNS))])]
    rows.append(np.column_stack((first, second, third, below[room - third])))
    found = np.unique(np.sort(np.concatenate(rows), axis=1)[:, ::-1], axis=0)
    return found[found.sum(axis=1) >= capacity - SLACK]


def fit_repeats(patterns: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Non-negative least squares: repeats x so that the patterns' lengths add up to the histogram (accelerated projected gradient)."""
    size = len(left)

    def used(x: np.ndarray) -> np.ndarray:
        out = np.bincount(patterns.ravel(), np.repeat(x, patterns.shape[1]), size)
        out[0] = 0
        return out

    goal = left.astype(float)
    goal[0] = 0
    v = np.ones(len(patterns))
    for _ in range(12):
        v = used(v)[patterns].sum(axis=1)
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(STEPS):
        new = np.maximum(0.0, y - (used(y) - goal)[patterns].sum(axis=1) / (1.05 * norm))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


Group = tuple[int, tuple[tuple[int, int], ...]]


def plan_packing(histogram: np.ndarray, capacity: int = CAPACITY, seed: int = 7) -> list[Group]:
    """(number of sequences, ((length, times), ...)): every piece of the histogram in a sequence of at most ``capacity``."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    plan: list[Group] = []
    if left[capacity]:
        plan.append((int(left[capacity]), ((capacity, 1),)))
        left[capacity] = 0
    rng = np.random.default_rng(seed)
    for _ in range(FITS):
        if not left.any():
            break
        patterns = enumerate_patterns(left, capacity, rng)
        if not len(patterns):
            break
        repeats = fit_repeats(patterns, left)
        for k in np.lexsort((-repeats, -patterns.sum(axis=1))):
            if repeats[k] < 0.5:
                continue
            lengths, times = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
            n = int(min(round(repeats[k]), (left[lengths] // times).min()))
            if n:
                left[lengths] -= n * times
                plan.append((n, tuple(zip(lengths.tolist(), times.tolist(), strict=True))))
    return plan + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[Group]:
    """Best fit decreasing on counts: groups of sequences of equal content are filled together."""
    rooms: list[int] = []
    by_room: dict[int, list[list]] = {}

    def put(room: int, n: int, content: tuple) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append([n, content])

    for length in np.flatnonzero(left)[::-1].tolist():
        c = int(left[length])
        while c:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                break
            room = rooms[at]
            n, content = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            fit = room // length
            if n * fit <= c:
                put(room - fit * length, n, (*content, (length, fit)))
                c -= n * fit
                continue
            full, rest = divmod(c, fit)
            if n - full - bool(rest):
                put(room, n - full - bool(rest), content)
            if full:
                put(room - fit * length, full, (*content, (length, fit)))
            if rest:
                put(room - rest * length, 1, (*content, (length, rest)))
            c = 0
        if c:
            fit = capacity // length
            full, rest = divmod(c, fit)
            if full:
                put(capacity - fit * length, full, ((length, fit),))
            if rest:
                put(capacity - rest * length, 1, ((length, rest),))
    return [(n, content) for groups in by_room.values() for n, content in groups]


def _intervals(plan: list[Group], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (ranks up to, sequence, times, offset): where the pieces of consecutive ranks go."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for n, content in plan:
        offset = 0
        for length, times in content:
            rows.setdefault(length, []).append((int(used[length]), sequence, times, offset))
            used[length] += n * times
            offset += length * times
        sequence += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, capacity, tokenizer), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        histogram[length] = n
    where = spark.sparkContext.broadcast(_intervals(plan_packing(histogram, capacity), capacity))
    groups = int(min(GROUPS_HIGH, max(GROUPS_LOW, histogram.sum() // GROUP_ROWS)))
    dealt = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    sizes = dealt.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("length").alias("_of"), F.col("_salt").alias("_os"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(offsets, (F.col("length") == F.col("_of")) & (F.col("_salt") == F.col("_os"))).withColumn("_rank", F.col("_rank") + F.col("_before"))

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        size, r = np.asarray(length), np.asarray(rank)
        sequence, offset = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
        for k in np.unique(size):
            at = np.flatnonzero(size == k)
            rows = where.value[int(k)]
            row = rows[np.searchsorted(rows[:, 0], r[at], side="right") - 1]
            nth = r[at] - row[:, 0]
            sequence[at] = row[:, 1] + nth // row[:, 2]
            offset[at] = row[:, 3] + nth % row[:, 2] * k
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    return ranked.withColumn("_at", place.asNondeterministic()("length", "_rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")
