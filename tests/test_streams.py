"""The tailing source, keyed state with a seed, pending calls, sums and pages over ranges."""

from __future__ import annotations

import random
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from snipscan.operators import events as ev
from snipscan.operators import ranges
from snipscan.plans.corpus import made_events
from snipscan.plans.streams import feed_lines
from snipscan.streaming import feed, state, tail

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# ---- the tailing source


def of(parts) -> list[tuple[str, int]]:
    return [tuple(r.values()) for p in parts for b in tail.lines(p) for r in b.to_pylist()]


def stream(path, **options):
    return tail.TailStream({"path": str(path), **options})


def test_each_line_is_told_once_however_the_file_is_cut(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "STEP", 5)
    path = tmp_path / "log"
    lines = ["", "a", "bc" * 20, "", "déjà vu\r", "x" * 99, "end"]
    data = "\n".join(lines).encode() + b"\n"
    path.write_bytes(data + b"torn")
    starts = [0, *(i + 1 for i, b in enumerate(data) if b == 10)][: len(lines)]
    want = [(x.removesuffix("\r"), s) for x, s in zip(lines, starts, strict=True)]
    for size in (1, 2, 7, 50, 1000):
        assert of(tail.TailBatch({"path": str(path), "rangeBytes": size}).partitions()) == want, size
    for cut in range(len(data) + 1):  # a batch up to a byte and a stream from there
        first = of(tail.TailBatch({"path": str(path), "endBytes": cut}).partitions())
        reader = stream(path, startBytes=cut)
        assert first + of(reader.partitions(reader.initialOffset(), reader.latestOffset())) == want


def test_torn_lines_wait_and_replaced_files_start_again(tmp_path):
    path = tmp_path / "log"
    path.write_text("one\ntorn")
    reader = stream(path)
    start = reader.initialOffset()
    at = reader.latestOffset()
    assert of(reader.partitions(start, at)) == [("one", 0)]
    with path.open("a") as f:
        f.write(" line\nlast\n")
    end = reader.latestOffset()
    assert of(reader.partitions(at, end)) == [("torn line", 4), ("last", 14)]
    planned = reader.partitions(start, end)
    path.write_text("new\n")  # shorter
    assert of(planned) == [] and of(reader.partitions(end, new := reader.latestOffset())) == [("new", 0)]
    path.write_text("other\n" + "and longer\n" * 9)
    assert of(reader.partitions(new, reader.latestOffset()))[0] == ("other", 0)
    path.unlink()
    assert of(reader.partitions(new, reader.latestOffset())) == []
    assert stream(tmp_path / "none").latestOffset()["bytes"] == 0
    assert stream(path, replay="false").initialOffset()["bytes"] == 0


def test_a_batch_takes_so_many_bytes(tmp_path):
    path = tmp_path / "log"
    path.write_text("".join(f"line {i}\n" for i in range(100)))
    reader, got = stream(path, batchBytes=50), []
    at = reader.initialOffset()
    while (to := reader.latestOffset()) != at:
        assert to["bytes"] - at["bytes"] <= 50
        got += of(reader.partitions(at, to))
        at = to
    assert [x for x, _ in got] == [f"line {i}" for i in range(100)]


def test_tail_as_a_source(spark, tmp_path):
    """Two ranges are two tasks; the driver plans by offsets; what is appended comes in the next batch."""
    path = tmp_path / "log"
    lines = [r.value for r in feed_lines(spark, SF).orderBy("seq").collect()]
    path.write_text("".join(x + "\n" for x in lines[:600]))
    tail.register(spark)
    half = path.stat().st_size // 2 + 1
    batch = spark.read.format("tail").option("rangeBytes", half).load(str(path))
    assert batch.rdd.getNumPartitions() == 2 and [r.value for r in batch.orderBy("seq").collect()] == lines[:600]
    q = feed.parse(spark.readStream.format("tail").option("rangeBytes", half).load(str(path))).writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    assert spark.table("tailed").count() == 600
    with path.open("a") as f:
        f.write("".join(x + "\n" for x in lines[600:]))
    for _ in range(60):
        q.processAllAvailable()
        if spark.table("tailed").count() == len(lines):
            break
        time.sleep(0.5)
    q.stop()
    assert spark.table("tailed").count() == len(lines)


# ---- state


def last_of(rows, n):
    """The last n (seq, risk) of each source."""
    out = {}
    for r in sorted(rows, key=lambda r: r.seq):
        out[r.source] = [*out.get(r.source, []), (r.seq, r.risk)][-n:]
    return out


def test_states_of_log_and_stream_equal_the_batch_and_survive_a_restart(spark, tmp_path):
    every = made_events(spark, SF).withColumn("source", F.concat(F.lit("s"), (F.col("seq") % 7).cast("string"))).orderBy("seq")
    rows = every.collect()
    parts = [every.where(F.col("seq").between(lo, hi)) for lo, hi in ((0, 299), (300, 600), (601, 10**9))]
    start = state.seed(parts[0], 20)
    start.write.parquet(str(tmp_path / "seed"))
    start = spark.read.parquet(str(tmp_path / "seed"))
    assert {r.source: [(x.seq, x.risk) for x in r.recent] for r in start.collect()} == last_of(rows[: parts[0].count()], 20)
    for part in parts[1:]:  # a query for each part: the second starts from the checkpoint
        part.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        came = spark.readStream.schema(every.schema).json(str(tmp_path / "in"))
        state.write_states(state.source_states(came, start, 20), str(tmp_path / "states"), str(tmp_path / "cp")).awaitTermination(180)
    got = {r.source: r for r in state.latest_states(spark, str(tmp_path / "states"), start).collect()}
    assert {s: [(x.seq, x.risk) for x in r.recent] for s, r in got.items()} == last_of(rows, 20)
    for want in ev.session_stats(every, "source").collect():
        assert {c: got[want.source][c] for c in state.TOTALS} == {c: want[c] for c in state.TOTALS}


def test_the_names_of_totals(spark):
    assert ev.session_stats(made_events(spark, SF)).columns == state.TOTALS


def held(calls, keep, wait):
    """What a session's results find, one after the other."""
    pending, out = {}, {}
    for session, seq, at, result, key, other in sorted(calls, key=lambda c: c[1]):
        mine = pending.setdefault(session, {})
        if not result:
            mine[key] = (seq, at)
            while len(mine) > keep:
                del mine[next(iter(mine))]
            continue
        found = mine.pop(key, None) or (mine.pop(other, None) if other else None)
        out[session, seq] = found[0] if found and at - found[1] <= wait else None
    return out


@pytest.mark.parametrize("files", [1, 6])
def test_pending_calls(spark, tmp_path, files):
    """Calls beyond the last 8 are pushed out, in one batch and in six; by either key; asked again; waited too long."""
    rng, calls = random.Random(files), []
    for seq in range(600):
        session, at = f"s{seq % 2}", 1_700_000_000_000 + seq * 1000
        asked = [c[4] for c in calls if c[0] == session and not c[3]][-14:]
        result = bool(asked) and rng.random() < 0.4
        key = rng.choice(asked) if result or (asked and rng.random() < 0.1) else f"k{seq}"
        calls.append((session, seq, at, result, "unknown" if result and rng.random() < 0.2 else key, key if rng.random() < 0.5 else None))
    rows = spark.createDataFrame([(a, b, datetime.fromtimestamp(c / 1000, timezone.utc).replace(tzinfo=None), *rest) for a, b, c, *rest in calls], "session string, seq bigint, at timestamp, result boolean, key string, other string")
    size, got = 600 // files, {}
    for k in range(files):
        rows.where(F.col("seq").between(k * size, (k + 1) * size - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        came = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        with state.rocks(spark):
            q = state.take_pending(came, 8, 12_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {(r.session, r.seq): r.asked for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = held(calls, 8, 12_000)
    assert got == want and 20 < sum(v is not None for v in want.values()) < len(want) - 20


# ---- ranges


def test_trim(spark):
    rows = spark.createDataFrame([(i, "x" * 9) for i in range(10)], "seq int, value string")
    assert [r.seq for r in feed.trim(rows, 60).orderBy("seq").collect()] == [5, 6, 7, 8, 9]
    assert feed.trim(rows, 100).count() == 10
    assert feed.trim(rows.limit(0), 1).count() == 0
    logs = rows.withColumn("log", F.when(F.col("seq") > 2, "b"))  # null is a log too
    assert sorted((r.log or "", r.seq) for r in feed.trim(logs, 20, "log").collect()) == [("", 2), *[("b", i) for i in (7, 8, 9)]]


def test_running_sums_equal_a_window(spark):
    rng = random.Random(1)
    data = [(None if k % 50 == 0 else k * 3.5 - (k % 3), rng.choice(["a", "b", None]), rng.randrange(9)) for k in range(1, 700)]
    df = spark.createDataFrame(data, "o double, g string, w int")
    for keys in ((), ("g",)):
        got = ranges.with_running_sum(df.where("o is not null"), "o", F.col("w"), *keys, parts=16).collect()
        before, total = {}, {}
        for o, g, w in sorted((r for r in data if r[0] is not None), key=lambda r: r[0]):
            k = g if keys else 0
            before[o] = total.get(k, 0)
            total[k] = before[o] + w
        assert len(got) == len(before) and all(r["_before"] == before[r.o] and r["_total"] == total[r.g if keys else 0] for r in got)
    nulls = ranges.with_running_sum(df, "o", F.lit(1), parts=16).collect()
    assert sorted(r["_before"] for r in nulls) == list(range(len(data))) and max(r["_before"] for r in nulls if r.o is None) < min(r["_before"] for r in nulls if r.o is not None)
    assert "SinglePartition" not in plan(feed.trim(df.withColumnsRenamed({"o": "seq", "g": "value"}), 10))


def test_pages(spark, tmp_path):
    made_events(spark, SF).write.parquet(str(tmp_path / "feed"))
    index = ranges.Index(spark.read.parquet(str(tmp_path / "feed")), "seq", 32)
    seqs = sorted(r.seq for r in index.rows.select("seq").collect())
    assert len(index) == len(seqs)
    for first, count in ((0, 10), (333, 100), (len(seqs) - 5, 50), (10**6, 5), (-3, 4), (5, 0), (0, 10**6)):
        got = sorted((r.position, r.seq) for r in index.page(first, count).collect())
        lo = max(0, first)
        assert got == list(enumerate(seqs))[lo : max(lo, first + count)], (first, count)
    assert sorted(r.seq for r in index.latest(100, 16).collect()) == seqs[-116:-100]
    text = plan(index.page(333, 100))
    assert "GreaterThanOrEqual(seq," in text and "LessThanOrEqual(seq," in text and "SinglePartition" not in text
    odd = ranges.Index(spark.createDataFrame([(None,), (None,), (5,), (5,), (7,)], "seq int"), "seq", 4)
    assert sorted((r.position, r.seq) for r in odd.page(1, 3).collect()) == [(1, None), (2, 5), (3, 5)]
    assert ranges.Index(odd.rows.limit(0), "seq").page(0, 5).count() == 0
