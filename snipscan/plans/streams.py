"""Queries over logs, streams with state, and pages of a feed, with the SQL that states their results in batch."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipscan.operators import events as ev
from snipscan.operators import ranges
from snipscan.plans.corpus import MADE_EVENTS, made_events
from snipscan.plans.queries import STATS, longs, query
from snipscan.streaming import feed, state, tail


def shared_folder(spark) -> str:
    """A new folder that driver and executors share; in local mode without one, a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="spark-stream-")


def feed_lines(spark, sf) -> DataFrame:
    """The made events as the lines of a feed (seq, value)."""
    e = made_events(spark, sf).withColumns({"schema": F.lit(1), "lines": F.lit(1), "worst": F.lit(None).cast("string"), "notes": F.array().cast(feed.EVENT["notes"].dataType)})
    return e.select("seq", F.to_json(F.struct(*[c.name for c in feed.EVENT])).alias("value"))


def _log(spark, sf) -> str:
    """The made events as one log, a line for each in order, as one process writes it."""
    folder = f"{shared_folder(spark)}/log"
    feed_lines(spark, sf).orderBy("seq").select("value").coalesce(1).write.text(folder)
    tail.register(spark)
    return spark.read.text(folder).inputFiles()[0]


@query(f"with {MADE_EVENTS} select name, source, cast(risk as bigint) as risk, row_number() over (order by seq) - 1 as nth from feed")
def tail_lines(spark, sf):
    """The lines of one log, read by a task for each 64 kB of it, in order of their first bytes."""
    log = spark.read.format("tail").option("rangeBytes", 1 << 16).load(_log(spark, sf))
    events = ranges.with_running_sum(feed.parse(log), "seq", F.lit(1), before="nth")
    return longs(events, "risk", "nth").select("name", "source", "risk", "nth")


def _followed(spark, sf, n: int) -> DataFrame:
    """The states of all sources after the first half of a log's bytes as a batch and the rest as a stream."""
    log, folder = _log(spark, sf), shared_folder(spark)
    half = tail.mark(log)["bytes"] // 2
    first = feed.parse(spark.read.format("tail").option("endBytes", half).load(log))
    start = state.seed(first, n)
    start.write.parquet(f"{folder}/seed")  # read by the stream's first batch and by the result
    start = spark.read.parquet(f"{folder}/seed")
    rest = feed.parse(spark.readStream.format("tail").option("startBytes", half).load(log))
    state.write_states(state.source_states(rest, start, n), f"{folder}/states", f"{folder}/checkpoint").awaitTermination()
    return state.latest_states(spark, f"{folder}/states", start)


@query(f"with {MADE_EVENTS} select source, {STATS} from feed group by source")
def seeded_totals(spark, sf):
    """Totals seeded from the log and kept up by what follows it: those of the whole log."""
    return _followed(spark, sf, 5).drop("recent")


@query(f"with {MADE_EVENTS} select source, ts, cast(risk as bigint) as risk, band, row_number() over (partition by source order by seq desc) - 1 as back from feed qualify back < 5")
def seeded_recent(spark, sf):
    """The last five events of each source, from the log and what follows it."""
    last = _followed(spark, sf, 5).select("source", F.posexplode(F.reverse("recent")).alias("back", "r"))
    return longs(last.select("source", "r.ts", "r.risk", "r.band", "back"), "risk", "back")


#: Calls are asked at every event; each is answered a while later, many after over 64 others or over ten minutes.
CALLS = """
asks as (select cast(event_id as bigint) as e, 's' || (event_id % 3) as session, 2 * cast(event_id as bigint) as a, 2 * (cast(event_id as bigint) + event_id * 37 % 300) + 1 as r from events)
"""


@query(f"""with {CALLS},
crowd as (select i.e, t.a as at, count(*) as n from asks i join asks t on t.session = i.session and t.a > i.a and t.a < i.r join asks j on j.session = i.session and j.a > i.a and j.a <= t.a and j.r > t.a group by i.e, t.a),
out as (select distinct e from crowd where n >= 64)
select session, r as seq, case when out.e is null and (r - a) * 1500 <= 600000 then a end as asked from asks left join out using (e)""")
def pending_calls(spark, sf):
    """Calls met by their results in each session: of those that wait the last 64 are held, for ten minutes."""
    e = F.col("seq")
    made = made_events(spark, sf).select(F.concat(F.lit("s"), (e % 3).cast("string")).alias("session"), F.concat(F.lit("c"), e.cast("string")).alias("key"), (2 * e).alias("a"), (2 * (e + e * 37 % 300) + 1).alias("r"))
    sides = F.array(F.struct(F.lit(False).alias("result"), F.col("a").alias("seq")), F.struct(F.lit(True).alias("result"), F.col("r").alias("seq")))
    rows = made.select("session", "key", F.explode(sides).alias("x")).select("session", "key", "x.*", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("x.seq") * 1500).alias("at"), F.lit(None).cast("string").alias("other"))
    folder = shared_folder(spark)
    rows.write.parquet(f"{folder}/calls")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/calls")
    with state.rocks(spark):
        q = state.take_pending(stream).writeStream.format("parquet").option("path", f"{folder}/taken").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/taken")


@query(f"with {MADE_EVENTS} select seq, source, row_number() over (order by seq) - 1 as position from feed qualify position >= count(*) over () - 700 and position < count(*) over () - 450")
def feed_page(spark, sf):
    """A page deep in a feed: the 250 events before the last 450, read from the ranges that hold them."""
    return ranges.Index(made_events(spark, sf), "seq", 64).latest(450, 250).select("seq", "source", "position")


@query(f"with {MADE_EVENTS}, b as (select seq, 'line ' || name as value from feed), s as (select *, coalesce(sum(length(value) + 1) over (order by seq rows between unbounded preceding and 1 preceding), 0) as before, sum(length(value) + 1) over () as total from b) select seq, value from s where total <= 20000 or before >= floor(total / 2)")
def feed_trim_whole(spark, sf):
    """One huge log trimmed by sums over its ranges."""
    return feed.trim(made_events(spark, sf).select("seq", F.concat(F.lit("line "), F.col("name")).alias("value")), 20_000)


@query(f"with {MADE_EVENTS} select source, band, cast(2 - grouping(source) - grouping(band) as bigint) as level, {STATS} from feed group by rollup (source, band)")
def rolled_stats(spark, sf):
    """Totals by source and band, by source, and of all."""
    return longs(ev.rolled_stats(made_events(spark, sf), "source", "band"), "level")


@query(f"with {MADE_EVENTS} select band, count(*) as events, true as near from feed group by band")
def merged_sketches(spark, sf):
    """Distinct sources of each band from sketches by day and band, against exact counts: within six standard errors."""
    e = made_events(spark, sf).withColumn("day", F.floor(F.col("ts") / 86_400_000))
    told = ev.merged(ev.sketched(e, "band", "day"), "band")
    exact = e.groupBy("band").agg(F.count_distinct("source").alias("exact")).withColumnRenamed("band", "_band")
    error = 6 * 1.04 / 2 ** (ev.SKETCH / 2)
    return told.join(exact, F.col("band") == F.col("_band")).select("band", "events", (F.abs(F.col("sources") - F.col("exact")) <= error * F.col("exact") + 1).alias("near"))
