"""The feed of events: one JSON object a line. Reading, writing, trimming, and running totals over a stream of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from snipscan.functions import catalog, render
from snipscan.operators import events as ev
from snipscan.operators import ranges
from snipscan.sources.extract import once

NOTE = T.StructType([T.StructField("effect", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("verb", T.StringType()), T.StructField("target", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("note", T.StringType())])
EVENT = T.StructType([
    T.StructField("schema", T.IntegerType()), T.StructField("ts", T.LongType()), T.StructField("name", T.StringType()), T.StructField("source", T.StringType()), T.StructField("lines", T.IntegerType()), T.StructField("risk", T.IntegerType()),
    T.StructField("band", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("worst", T.StringType()), T.StructField("synopsis", T.StringType()), T.StructField("notes", T.ArrayType(NOTE)), T.StructField("blocked", T.BooleanType()),
])
REQUIRED = "ts name source lines risk band mask synopsis notes blocked".split()
#: Bytes over which a feed is halved.
TRIM_BYTES = 4 << 20


def parse(lines: DataFrame, text: str = "value") -> DataFrame:
    """Events from lines of text: torn lines, lines without a required field or with an unknown name, and lines of a newer schema are dropped. A line without a schema counts as schema 0."""
    rest = [F.col(f"`{c}`") for c in lines.columns if c != text]
    e = lines.select(*rest, once(F.col(text), EVENT.simpleString()).alias("_e"))  # one parse of each line
    of = lambda c: F.col(f"_e.{c}")
    whole = F.lit(True)
    for c in REQUIRED:
        whole = whole & of(c).isNotNull()
    known = of("band").isin(catalog.BANDS) & (of("worst").isNull() | of("worst").isin(catalog.SEVERITIES))
    notes = F.forall(of("notes"), lambda n: n["effect"].isin(catalog.EFFECTS) & n["severity"].isin(catalog.SEVERITIES) & n["verb"].isNotNull() & n["line"].isNotNull())
    ranges = of("risk").between(0, 255) & of("mask").between(0, 65535) & (of("ts") >= 0) & (of("lines") >= 0)
    schema = F.coalesce(of("schema"), F.lit(0))
    good = e.where(whole & known & F.coalesce(notes, F.lit(False)) & ranges & (schema <= ev.SCHEMA))
    return good.select(*rest, schema.alias("schema"), *[of(f.name).alias(f.name) for f in EVENT if f.name != "schema"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """All events under a path of JSON lines."""
    return parse(spark.read.text(path))


def read_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Events of the files that come to a folder. For one file that grows use ``snipscan.streaming.tail``."""
    return parse(spark.readStream.format("text").options(**options).load(path))


def write(events: DataFrame, path: str) -> None:
    """Append events as JSON lines; null fields are left out."""
    events.write.mode("append").json(path)


def write_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def look(snippets: DataFrame, path: str, checkpoint: str, pages: str | None = None, errors: str | None = None, every: str | None = None) -> StreamingQuery:
    """Analyse a stream of snippets: each batch's events go to the feed, and a line for each to ``pages``, if given.

    A batch writes to a folder of its own, over what a failed attempt may have left there, so a retry adds nothing twice.
    Its events are analysed into a table beside the checkpoint first, and both feed and pages are written from that. With ``errors`` a feed that can't be written doesn't stop the analysis: the batch's number and the error go there as
    a JSON line (batch, feed_error), and its pages are written all the same. ``every`` is the time between polls; without
    it what is there is read and the query ends.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark, staged = batch.sparkSession, f"{checkpoint}/looked-{number}"
        ev.events(batch).write.mode("overwrite").parquet(staged)  # what fails here is the analysis, and stops the query
        events = spark.read.parquet(staged)
        try:
            events.write.mode("overwrite").json(f"{path}/batch={number}")
        except Exception as e:
            if errors is None:
                raise
            told = spark.createDataFrame([(number, f"{type(e).__name__}: {e}"[:2000])], "batch bigint, feed_error string")
            told.write.mode("overwrite").json(f"{errors}/batch={number}")
        if pages:
            events.select(render.line(F.col("name")).alias("value")).write.mode("overwrite").text(f"{pages}/batch={number}")
        place = spark._jvm.org.apache.hadoop.fs.Path(staged)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    when = {"processingTime": every} if every else {"availableNow": True}
    return snippets.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**when).start()


def trim(lines: DataFrame, limit: int = TRIM_BYTES, group: str | None = None) -> DataFrame:
    """Of lines (seq, value, and a group) of over ``limit`` bytes, those that start after half of them; under it, all. A group is one log, of any size: no task sees more than a range of it."""
    out = ranges.with_running_sum(lines, "seq", F.octet_length("value") + 1, *([group] if group else []))
    return out.where((F.col("_total") <= limit) | (F.col("_before") >= F.floor(F.col("_total") / 2))).drop("_before", "_total")


def at(events: DataFrame) -> Column:
    """The event's time."""
    return F.timestamp_millis("ts")


def running_totals(events: DataFrame, *keys: str) -> DataFrame:
    """Session totals, batch or stream (output modes complete and update)."""
    return events.groupBy(*keys).agg(*ev.totals())


def windowed_totals(events: DataFrame, size: str = "1 minute", late: str = "5 minutes", *keys: str) -> DataFrame:
    """Totals by window of event time; a watermark bounds the state."""
    timed = events.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size), *keys).agg(*ev.totals())


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Totals by source and session: a session ends after a gap without events; one that comes just as the gap ends opens the next.

    In a batch an event without a time is a session of its own, without start and end; a stream's feed has none.
    """
    # Spark joins what lies a whole gap apart, so its gap is a microsecond shorter, the least that a timestamp tells apart
    timed = events.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    found = timed.groupBy("source", F.session_window("at", f"{gap} -1 microseconds")).agg(*ev.totals())
    found = found.withColumn("session_window", F.col("session_window").withField("end", F.expr("session_window.end + interval 1 microsecond")))
    if events.isStreaming:
        return found
    none = F.lit(None).cast(found.schema["session_window"].dataType)
    timeless = events.where(F.col("ts").isNull()).withColumn("_n", F.monotonically_increasing_id()).groupBy("source", "_n").agg(*ev.totals())
    return found.unionByName(timeless.withColumn("session_window", none).drop("_n"))


def keep_recent(events: DataFrame, n: int = 240):
    """The last ``n`` (risk, band) of each source as keyed state: each batch gives the sources that changed, oldest event first.

    A key's state is bounded by ``n``, whatever its number of events.
    """
    import pandas as pd

    def step(key, batches, state):
        last = list(state.get[0]) if state.exists else []
        for b in batches:
            last = (last + [f"{r}:{x}" for r, x in zip(b["risk"], b["band"], strict=True)])[-n:]
        state.update((last,))
        yield pd.DataFrame({"source": [key[0]], "recent": [",".join(last)], "n": [len(last)]})

    return events.select("source", "risk", "band").groupBy("source").applyInPandasWithState(step, "source string, recent string, n int", "recent array<string>", "update", "NoTimeout")
