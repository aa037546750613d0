"""Queries over origins, files' lengths, wrappers of commands and small facts of sources, and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from snipscan.operators import classify, digest, events, facts
from snipscan.plans.claims import _sources, _values
from snipscan.plans.corpus import MADE_EVENTS, dealt, made_events, snippets, table
from snipscan.plans.queries import longs, query
from snipscan.plans.streams import feed_lines, shared_folder
from snipscan.sources import extract, files
from snipscan.streaming import feed


@query(f"with {MADE_EVENTS} select case when risk < 10 then 'inert' when risk < 30 then 'routine' when risk < 60 then 'check' else 'read' end as band, count(*) as events from feed group by 1")
def score_bands(spark, sf):
    """Bands by the score alone."""
    return made_events(spark, sf).groupBy(digest.band_of_score(F.col("risk")).alias("band")).agg(F.count("*").alias("events"))


@query("select event_id, case event_id % 3 when 0 then 'agent' else 'hook' end || case event_id % 2 when 0 then ':' || substr('session-' || user_id, 1, 8) else '' end as origin from events")
def payload_origins(spark, sf):
    """Where payloads say they come from."""
    session = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("session-"), F.col("user_id").cast("string")))
    payload = F.to_json(F.struct(session.alias("session_id"), F.when(F.col("event_id") % 3 == 0, "agent").alias("hook_source")))
    return table(spark, sf, "events").select("event_id", extract.origin(payload).alias("origin"))


@query("select event_type, count(*) as snippets from events where event_type in ('error', 'view', 'click', 'signup') group by event_type")
def long_snippets(spark, sf):
    """Snippets of three lines or more; the others aren't parsed."""
    return files.long_enough(snippets(spark, sf), 3).groupBy("event_type").agg(F.count("*").alias("snippets"))


#: Sources, and their hits as (line, column, effect, verb, target): arguments, columns in characters, hazards only where they apply.
SMALL = [
    ("import sys\né = 1; who = sys.argv[{k}]", [(2, 14, "env", "argv", None)]),
    ("'ü{k}'; open('ß{k}')", [(1, 7 , "fs_read", "read", "ß{k}")]),
    ("import os\nfor x in y:\n\tos.remove('t{k}')", [(3, 2, "fs_delete", "delete", "t{k}")]),
]


@query(f"with x(i, line, col, effect, verb, target) as (values {_values([(i, *h) for i, (_, hits) in enumerate(SMALL) for h in hits])}) select p_partkey as snippet_id, cast(line as bigint) as line, cast(col as bigint) + case when i = 1 then length(p_partkey::varchar) - 1 else 0 end as col, effect, verb, replace(target, '{{k}}', p_partkey::varchar) as target from part join x on p_partkey % {len(SMALL)} = i")
def arguments_and_columns(spark, sf):
    hits = classify.classify(facts.with_facts(_sources(spark, sf, [text for text, _ in SMALL])))
    return longs(digest.dedup_hits(hits), "line", "col").select("snippet_id", "line", "col", "effect", "verb", "target")


#: Commands that run Python through another program, and what of them is Python (null: nothing).
WRAPPED = [("uv run python -c 'a{k}'", "a{k}"), ("poetry run python3 -c \"b{k}\"", "b{k}"), ("conda run -n env python -c c{k}", "c{k}"), ("busybox sh -c 'python -c d{k}'", "d{k}"), ("dash -c \"python3 -c 'e{k}'\"", "e{k}"), ("pip install p{k}", None), ("zsh -lc 'ls {k}'", None)]


@query(f"with x(i, source) as (values {_values([(i, s) for i, (_, s) in enumerate(WRAPPED) if s])}) select o_orderkey, replace(source, '{{k}}', o_custkey::varchar) as source from orders join x on o_orderkey % {len(WRAPPED)} = i")
def wrapped_commands(spark, sf):
    """Python within the commands of runners and shells."""
    text = F.get(F.array(*[F.lit(c) for c, _ in WRAPPED]), (F.col("o_orderkey") % len(WRAPPED)).cast("int"))
    commands = dealt(table(spark, sf, "orders").select("o_orderkey", "o_custkey")).select("o_orderkey", F.replace(text, F.lit("{k}"), F.col("o_custkey").cast("string")).alias("command"))
    return extract.extract_all(commands).select("o_orderkey", "source")


@query(f"with {MADE_EVENTS} select name, source, ts, cast(risk as bigint) as risk, band, blocked from feed")
def feed_appended(spark, sf):
    """Events that two appends wrote as lines of a feed, read back."""
    folder = shared_folder(spark)
    every = feed.parse(feed_lines(spark, sf).select("value"))
    for k in (0, 1):
        feed.write(every.where(F.pmod(F.xxhash64("name"), F.lit(2)) == k), f"{folder}/feed")
    return longs(feed.read(spark, f"{folder}/feed").select("name", "source", "ts", "risk", "band", "blocked"), "risk")


@query("select case event_type when 'view' then 'inert' when 'click' then 'routine' when 'purchase' then 'check' when 'error' then 'read' else 'inert' end as band, count(*) as events, count(*) as pages from events group by 1")
def looked_at(spark, sf):
    """Snippets that come as a stream: each is analysed once, its event goes to the feed and its line to the pages."""
    folder = shared_folder(spark)
    came = snippets(spark, sf).select("snippet_id", "ts", "name", "origin", "source")
    came.write.parquet(f"{folder}/in")
    feed.look(spark.readStream.schema(came.schema).parquet(f"{folder}/in"), f"{folder}/feed", f"{folder}/checkpoint", f"{folder}/pages").awaitTermination()
    told = feed.read(spark, f"{folder}/feed/*").groupBy("band").agg(F.count("*").alias("events"))
    first = F.split("value", " ")[0]
    bands = {"inert": "█", "routine": "█", "check": "██", "read": "███"}
    pages = spark.read.text(f"{folder}/pages/*").select(F.regexp_extract("value", r"\be(\d+)\b", 1).cast("bigint").alias("snippet_id"), first.alias("block"))
    kinds = pages.join(events_bands(spark, sf), "snippet_id").where(F.col("block") == F.create_map(*[F.lit(x) for kv in bands.items() for x in kv])[F.col("_band")]).groupBy("_band").agg(F.count("*").alias("pages"))
    return told.join(kinds, F.col("band") == F.col("_band")).select("band", "events", "pages")


def events_bands(spark, sf):
    """(snippet_id, _band) of the reports of all snippets."""
    return events.reports_once(snippets(spark, sf)).select("snippet_id", F.col("band").alias("_band"))
