"""The feed in batch and as streams, and decisions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from snipscan.functions import render
from snipscan.operators import events as ev
from snipscan.operators import policy
from snipscan.streaming import feed

BASE = {"schema": 1, "ts": 1_700_000_000_000, "name": "n", "source": "s", "lines": 1, "risk": 30, "band": "check", "mask": 16, "worst": "caution", "synopsis": "runs", "notes": [{"effect": "process", "severity": "caution", "verb": "run", "line": 2}], "blocked": False}


def line(**changes):
    return json.dumps({k: v for k, v in (BASE | changes).items() if v is not ...})


def write(path, lines):
    path.write_text("".join(x + "\n" for x in lines))


def test_reader(spark, tmp_path):
    write(tmp_path / "a.jsonl", [line(), line(schema=..., name="old"), line(schema=2), line()[:40], "", line(risk=...), line(band="odd"), line(worst=None, notes=[])])
    got = feed.read(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r.name, r.schema) for r in got] == [("n", 1), ("n", 1), ("old", 0)]


def test_round_trip(spark, tmp_path):
    write(tmp_path / "in.jsonl", [line(), line(name="m", worst=None, notes=[])])
    events = feed.read(spark, str(tmp_path / "in.jsonl"))
    feed.write(events, str(tmp_path / "out"))
    feed.write(events, str(tmp_path / "out"))
    assert feed.read(spark, str(tmp_path / "out")).count() == 4


def test_stream_totals_equal_batch(spark, tmp_path):
    for i in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        write(tmp_path / "in" / f"{i}.jsonl", [line(risk=r, source=f"s{r % 2}", band="read" if r > 60 else "inert") for r in range(i, 100, 3)])
    stream = feed.running_totals(feed.read_stream(spark, str(tmp_path / "in"), maxFilesPerTrigger="1"), "source")
    q = stream.writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    batch = ev.session_stats(feed.read(spark, str(tmp_path / "in")), "source")
    assert sorted(spark.table("totals").collect()) == sorted(batch.collect())


def test_recent_state_is_bounded(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.jsonl", [line(risk=r % 100) for r in range(50)])
    q = feed.keep_recent(feed.read_stream(spark, str(tmp_path / "in")), 10).writeStream.format("memory").queryName("recent").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(90)
    assert [r.n for r in spark.table("recent").collect()] == [10]


def test_windows_and_sessions(spark, tmp_path):
    write(tmp_path / "a.jsonl", [line(ts=1_700_000_000_000 + 1000 * s) for s in (0, 5, 10, 2000)])
    events = feed.read(spark, str(tmp_path))
    assert sorted(r.events for r in feed.sessions(events).collect()) == [1, 3]
    assert sum(r.events for r in feed.windowed_totals(events).collect()) == 4


def test_sessions_end_with_their_gap(spark, tmp_path):
    """An event a whole gap after another opens a session, one a millisecond earlier doesn't; without a time each is alone."""
    at = lambda *ms: [line(ts=1_700_000_000_000 + t) for t in ms]
    write(tmp_path / "a.jsonl", at(0, 599_999, 1_199_999, 1_799_999, 1_800_000))
    told = lambda df: sorted((bool(r.session_window) and (r.session_window.end - r.session_window.start).total_seconds(), r.events) for r in df.collect())
    assert told(feed.sessions(feed.read(spark, str(tmp_path)))) == [(600.0, 1), (600.001, 2), (1199.999, 2)]
    timed = feed.read(spark, str(tmp_path))
    lost = timed.withColumn("ts", F.lit(None).cast("bigint")).limit(2)
    assert told(feed.sessions(timed.unionByName(lost))) == [(False, 1), (False, 1), (600.0, 1), (600.001, 2), (1199.999, 2)]
    q = feed.sessions(feed.read_stream(spark, str(tmp_path))).writeStream.format("memory").queryName("gaps").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(90)
    assert told(spark.table("gaps")) == [(600.0, 1), (600.001, 2), (1199.999, 2)]


def test_decisions(spark, tmp_path):
    write(tmp_path / "a.jsonl", [line(risk=0), line(risk=30), line(risk=80)])
    events = feed.read(spark, str(tmp_path))
    blocked = lambda gate: policy.decide(events, gate).where("decision = 'block'").count()
    assert [blocked(F.lit(g).cast("int")) for g in (None, 0, 30, 100)] == [0, 2, 1, 0]
    answer = json.loads(policy.decide(events, F.lit(50)).where("answer is not null").first().answer)
    assert answer["decision"] == "block" and answer["hookSpecificOutput"]["permissionDecision"] == "ask"
    assert "line 2: run" in policy.verdict_text(events).first().verdict


def test_pending_calls_are_taken_once(spark):
    asked = spark.sql("select 'a' tool_call_id, timestamp'2024-01-01 00:00:00' at, 1 x union all select 'b', timestamp'2024-01-01 00:00:00', 2")
    done = spark.sql("select 'a' tool_call_id, timestamp'2024-01-01 00:00:05' at, true ok")
    assert [r.tool_call_id for r in policy.take_once(asked, done).collect()] == ["a"]
    later = done.withColumn("at", F.expr("at + interval 1 minute"))
    taken = policy.take_once(asked.union(asked), done.union(later)).collect()
    assert [(r.tool_call_id, r.answered.second) for r in taken] == [("a", 5)]


def test_pending_calls_are_taken_once_in_a_stream(spark, tmp_path):
    for side, rows in (("asked", [("a", 0), ("b", 0)]), ("done", [("a", 5), ("a", 9), ("c", 5)])):
        (tmp_path / side).mkdir()
        write(tmp_path / side / "1.json", [json.dumps({"tool_call_id": k, "at": f"2024-01-01T00:00:0{s}Z"}) for k, s in rows])
    read = lambda side: spark.readStream.schema("tool_call_id string, at timestamp").json(str(tmp_path / side))
    q = policy.take_once(read("asked"), read("done")).writeStream.format("memory").queryName("taken").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert [r.tool_call_id for r in spark.table("taken").collect()] == ["a"]


def test_directives(spark, tmp_path):
    write(tmp_path / "a.jsonl", [line(risk=70), line(risk=5)])
    events = feed.read(spark, str(tmp_path))
    asked = [json.loads(r.directive) for r in policy.directive(events, F.lit(50)).where("directive is not null").collect()]
    assert asked == [{"action": "approve", "message": "risk 70 is over the gate of 50 (check it) — runs\n  line 2: run", "rule_key": "snipscan:check"}]
    stopped = json.loads(policy.directive(events, F.lit(50), "block").where("directive is not null").first().directive)
    assert stopped["action"] == "block" and "rule_key" not in stopped


def test_worst_by_risk_then_band(spark):
    df = spark.createDataFrame([("c", 1, 30, "routine"), ("c", 2, 30, "check"), ("c", 3, 30, "check"), ("c", 4, 10, "read")], "call string, seq int, risk int, band string")
    assert ev.worst_of(df, "call").first().seq == 1 and ev.worst_of(df, "call", by_band=True).first().seq == 2


def test_card_index_is_read_newest_first(spark):
    df = spark.createDataFrame(list(enumerate(['{"card": 1}', "torn {", '{"card": 2}', "[3]", '{"card": 4}', "5"])), "seq int, value string")
    got = ev.read_index(df, 2).select("seq", F.variant_get("row", "$.card", "int").alias("card")).collect()
    assert [(r.seq, r.card) for r in got] == [(4, 4), (2, 2)]


def test_formats(spark):
    df = spark.createDataFrame([("a <b>\nc",)], "t string")
    made = df.select(render.ansi(F.col("t"), F.lit("#0a10ff")).alias("a"), render.svg(F.col("t"), F.lit("#0a10ff")).alias("s")).first()
    assert made.a == "\x1b[38;2;10;16;255ma <b>\nc\x1b[0m"
    import xml.etree.ElementTree as tree

    assert [x.text for x in tree.fromstring(made.s)] == ["a <b>", "c"]
    assert {r.kind for r in render.listing(spark, "/feed").collect()} == {"theme", "layout", "format", "schema", "feed"}


def test_a_feed_that_fails_is_told(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text(json.dumps({"snippet_id": 0, "ts": 5, "name": "n", "origin": "o", "source": "print(1)"}) + "\n")
    (tmp_path / "blocked").write_text("a file, not a folder")
    stream = spark.readStream.schema("snippet_id int, ts long, name string, origin string, source string").json(str(tmp_path / "in"))
    q = feed.look(stream, str(tmp_path / "blocked"), str(tmp_path / "cp"), str(tmp_path / "pages"), errors=str(tmp_path / "errors"))
    q.awaitTermination(120)
    assert q.exception() is None and spark.read.json(f"{tmp_path}/errors/*").first().feed_error
    assert spark.read.text(f"{tmp_path}/pages/*").count() == 1


def test_an_analysis_that_fails_is_no_feed_error(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text(json.dumps({"snippet_id": 0, "ts": 5, "name": "n", "origin": "o", "source": "print(1)"}) + "\n")
    broken = ev.events
    monkeypatch.setattr(ev, "events", lambda batch: broken(batch).withColumn("risk", F.raise_error(F.lit("odd")).cast("int")))
    stream = spark.readStream.schema("snippet_id int, ts long, name string, origin string, source string").json(str(tmp_path / "in"))
    q = feed.look(stream, str(tmp_path / "feed"), str(tmp_path / "cp"), errors=str(tmp_path / "errors"))
    try:
        q.awaitTermination(120)
    except Exception as e:
        assert "odd" in str(e)
    assert "odd" in str(q.exception()) and not (tmp_path / "errors").exists()


def test_rows_and_cards(spark, tmp_path):
    write(tmp_path / "a.jsonl", [line()])
    events = feed.read(spark, str(tmp_path)).withColumn("seq", F.lit(1))
    rows = ev.feed_rows(events, F.lit(BASE["ts"] + 65_000)).orderBy("part").collect()
    assert len(rows) == 2 and rows[0].text.strip().startswith("1m ██  30") or "1m" in rows[0].text
    card = events.select(render.card(F.col("name")).alias("c"), render.html_card(F.lit("<x>")).alias("h")).first()
    assert {len(x) for x in card.c.split("\n")} == {60} and "&lt;x&gt;" in card.h


def test_look_writes_each_batch_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, code in enumerate(["import os\\nos.remove('x')", "print(1)"]):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"snippet_id": i, "ts": 5, "name": f"n{i}", "origin": "o", "source": code.replace("\\n", "\n")}) + "\n")
    stream = spark.readStream.schema("snippet_id int, ts long, name string, origin string, source string").option("maxFilesPerTrigger", "1").json(str(tmp_path / "in"))
    feed.look(stream, str(tmp_path / "feed"), str(tmp_path / "cp"), str(tmp_path / "pages")).awaitTermination(120)
    got = {r.name: r.band for r in feed.read(spark, f"{tmp_path}/feed/*").collect()}
    assert got == {"n0": "check", "n1": "inert"}
    assert spark.read.text(f"{tmp_path}/pages/*").count() == 2


def test_files(spark, tmp_path):
    from snipscan.operators import events
    from snipscan.sources import files

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("print(1)\nprint(2)\n")
    (tmp_path / "y.py").write_bytes(b"# \xff\n")
    (tmp_path / "z.txt").write_text("no")
    found = files.read(spark, str(tmp_path))
    assert sorted(r.name for r in found.collect()) == ["x.py", "y.py"]
    assert [r.name for r in files.long_enough(found, 2).collect()] == ["x.py"]
    assert events.reports(found).count() == 2
    assert {r.path for r in files.scripts(spark, str(tmp_path), f"{tmp_path}/").collect()} == {"a/x.py", "y.py", "z.txt"}
