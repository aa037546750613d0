"""Keyed state of streams: totals and the last events of each source, seeded from a log; calls that wait for their results.

Both run on ``transformWithState`` and the RocksDB state store. A source's state is its totals and at most ``n`` events, a
session's state at most ``keep`` calls, whatever comes in. Rows of a batch are read in pieces; what they add to a state is folded
in piece by piece.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from snipscan.functions import catalog
from snipscan.operators import events as ev

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"
#: The names of the totals, in the order of ``events.totals``.
TOTALS = ["events", "blocked", *[f"band_{b}" for b in catalog.BANDS], *[f"cap_{e}" for e in catalog.BARCODE.replace("|", "").split()], "flagged"]
_RECENT = "seq bigint, ts bigint, risk int, band string"
_STATE = "source string, " + ", ".join(f"{c} bigint" for c in TOTALS) + f", recent array<struct<{_RECENT.replace(' ', ': ').replace(',:', ',')}>>"


@contextmanager
def rocks(spark: SparkSession):
    """The session's state store is RocksDB while a query starts."""
    was = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if was is None else spark.conf.set(STORE, was)


# ---- totals and the last events of each source


def seed(events: DataFrame, n: int = 240) -> DataFrame:
    """What a batch of events leaves as state: a row for each source, its totals and its last ``n`` events by ``seq``, oldest first."""
    last = ev.recent(events, n, "source").groupBy(F.col("source").alias("of")).agg(F.sort_array(F.collect_list(F.struct("seq", "ts", "risk", "band"))).alias("recent"))
    return ev.session_stats(events, "source").join(last, F.col("source").eqNullSafe(F.col("of"))).select("source", *TOTALS, "recent")


class _Sources(StatefulProcessor):
    def __init__(self, n: int, keep_for: int | None):
        self.n, self.keep_for = n, keep_for

    def init(self, handle) -> None:
        self.totals = handle.getValueState("totals", ", ".join(f"{c} bigint" for c in TOTALS))
        self.recent = handle.getListState("recent", _RECENT, self.keep_for)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        self.totals.update(tuple(int(row[c]) for c in TOTALS))
        last = [(int(r["seq"]), int(r["ts"]), int(r["risk"]), r["band"]) for r in row["recent"]]
        if last:
            self.recent.put(last[-self.n :])

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        totals = list(self.totals.get()) if self.totals.exists() else [0] * len(TOTALS)
        new: list[tuple] = []
        for batch in rows:
            totals = [a + int(batch[c].sum()) for a, c in zip(totals, TOTALS, strict=True)]
            new += batch[["seq", "ts", "risk", "band"]].itertuples(index=False, name=None)
            new = sorted(new)[-self.n :]
        before = list(self.recent.get()) if self.recent.exists() else []
        last = ([(int(a), int(b), int(c), d) for a, b, c, d in before] + [(int(a), int(b), int(c), d) for a, b, c, d in new])[-self.n :]
        self.totals.update(tuple(totals))
        self.recent.put(last)
        told = [dict(zip(("seq", "ts", "risk", "band"), r, strict=True)) for r in last]
        yield pd.DataFrame({"source": [key[0]], **{c: [t] for c, t in zip(TOTALS, totals, strict=True)}, "recent": [told]})

    def close(self) -> None:
        """Nothing is open."""


def source_states(events: DataFrame, start: DataFrame | None = None, n: int = 240, keep_for: int | None = None) -> DataFrame:
    """A stream of events (seq, ts, source, risk, band, mask, blocked) as a stream of states: after each batch the sources that it changed.

    ``start`` is what ``seed`` made of events before the stream's; it is read when the query first starts, and not when
    it starts again from its checkpoint. Events of a batch count in order of ``seq``, and after those of batches before it.
    ``keep_for`` is how many milliseconds a source without events keeps its list.
    """
    rows = events.select("source", "seq", "ts", "risk", "band", *[flag.alias(name) for name, flag in _flags().items()])
    seeded = start.groupBy("source") if start is not None else None
    mode = "None" if keep_for is None else "ProcessingTime"
    return rows.groupBy("source").transformWithStateInPandas(_Sources(n, keep_for), _STATE, "Update", mode, initialState=seeded)


def _flags() -> dict[str, Column]:
    """What one event adds to each of the totals, 0 or 1."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    caps = {e: F.col("mask").bitwiseAND(F.lit(1 << catalog.EFFECTS.index(e))) != 0 for e in catalog.BARCODE.replace("|", "").split()}
    flags = {"events": F.lit(True), "blocked": F.col("blocked"), **{f"band_{b}": F.col("band") == b for b in catalog.BANDS}, **{f"cap_{e}": c for e, c in caps.items()}, "flagged": F.col("band").isin("check", "read")}
    return {name: one(flag) for name, flag in flags.items()}


def write_states(states: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write each batch's states to a folder of its own under ``path``, over what a failed attempt left there."""
    when = {"processingTime": every} if every else {"availableNow": True}

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with rocks(states.sparkSession):
        return states.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(**when).start()


def latest_states(spark: SparkSession, path: str, start: DataFrame | None = None) -> DataFrame:
    """The last state of each source: what ``write_states`` wrote last, or what it started from."""
    told = spark.read.schema(f"{_STATE}, batch bigint").parquet(path)
    if start is not None:
        told = told.unionByName(start.withColumn("batch", F.lit(-1).cast("bigint")))
    whole = F.struct(*TOTALS, "recent")
    return told.groupBy("source").agg(F.max_by(whole, "batch").alias("s")).select("source", "s.*")


# ---- calls that wait for their results

KEEP, WAIT = 64, 600_000


class _Calls(StatefulProcessor):
    """A session's pending calls in order of asking, (key, seq, at) each."""

    def __init__(self, keep: int, wait: int):
        self.keep, self.wait = keep, wait

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "key string, seq bigint, at bigint")

    def _held(self) -> OrderedDict:
        return OrderedDict((k, (s, t)) for k, s, t in self.pending.get()) if self.pending.exists() else OrderedDict()

    def _hold(self, held: OrderedDict) -> None:
        self.pending.put([(k, s, t) for k, (s, t) in held.items()]) if held else self.pending.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.handle.registerTimer(min(t for _, t in held.values()) + self.wait + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        held, out = self._held(), []
        batch = pd.concat(list(rows)).sort_values("seq")  # a session's rows of one batch
        for r in batch.itertuples(index=False):
            at = int(r.at.value // 1_000_000)
            if not r.result:
                held[r.key] = (int(r.seq), at)
                while len(held) > self.keep:
                    held.popitem(last=False)
                continue
            found = held.pop(r.key, None)
            if found is None and isinstance(r.other, str):
                found = held.pop(r.other, None)
            if found is not None and at - found[1] > self.wait:
                found = None
            out.append((key[0], int(r.seq), found and found[0]))
        self._hold(held)
        told = pd.DataFrame(out, columns=["session", "seq", "asked"])
        yield told.astype({"asked": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        now = expiredTimerInfo.getExpiryTimeInMs()
        held = OrderedDict((k, (s, t)) for k, (s, t) in self._held().items() if t + self.wait >= now)
        self._hold(held)
        yield pd.DataFrame({"session": pd.Series([], dtype=str), "seq": pd.Series([], dtype="int64"), "asked": pd.Series([], dtype="Int64")})

    def close(self) -> None:
        """Nothing is open."""


def take_pending(calls: DataFrame, keep: int = KEEP, wait: int = WAIT, late: str = "1 minute") -> DataFrame:
    """(session, seq, asked) for each result in a stream of calls: ``asked`` is the seq of its call, null if none waits.

    ``calls`` has session, seq (order of arrival), at (timestamp), result (false: a call is asked, true: it is answered), key and
    other (a second key for a result whose first none knows, or null). A session holds the ``keep`` calls asked last; a call
    is taken once, one asked again under its key keeps its place, and one that waited over ``wait`` milliseconds is not
    found; a timer in event time clears it away.
    """
    rows = calls.select("session", "seq", "at", "result", "key", "other").withWatermark("at", late)
    return rows.groupBy("session").transformWithStateInPandas(_Calls(keep, wait), "session string, seq bigint, asked bigint", "Append", "EventTime")
