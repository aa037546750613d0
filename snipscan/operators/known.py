"""Facts kept between runs: a table of what the walk told of each distinct source, so that only new sources are walked.

Agents run the same code again and again, and a nightly run sees most of yesterday's sources. A source is known by its SHA-256
and the parts asked of it; a store holds one set of parts, under the version of the walk that told them, and a walk of another version
starts anew. What is new is found by an anti-join before anything is parsed, each distinct source once. A run writes a folder
of its own; two runs at a time may both learn a source, which is then read once.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snipscan.operators.facts import facts_type, with_facts


def _version(parts: tuple[str, ...]) -> str:
    """What names the walk and its result: the code that reads a source, and the parts' types."""
    from snipscan.functions import labels
    from snipscan.sources import walker

    told = hashlib.sha256(facts_type(parts).encode())
    for module in (labels, walker):
        told.update(module.__loader__.get_source(module.__name__).encode())
    return told.hexdigest()[:16]


def digest_of(source: Column) -> Column:
    return F.sha2(F.coalesce(source, F.lit("")), 256)


class FactStore:
    """The facts of the sources seen so far, under ``path``, which driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, parts: tuple[str, ...] = ("parsed", "failed", "bytes", "counters", "calls", "env")):
        self.spark, self.parts = spark, parts
        self.path = f"{path.rstrip('/')}/facts-{_version(parts)}"
        self.schema = T.StructType().add("digest", "string").add("facts", T._parse_datatype_string(facts_type(parts)))

    def known(self) -> DataFrame:
        """(digest, facts) of each source seen."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/run=*").dropDuplicates(["digest"])

    def new_sources(self, snippets: DataFrame, source: str = "source") -> DataFrame:
        """(digest, source) of each distinct source that the store doesn't know."""
        every = snippets.select(digest_of(F.col(source)).alias("digest"), F.coalesce(F.col(source), F.lit("")).alias("source"))
        return every.groupBy("digest").agg(F.first("source").alias("source")).join(self.known().select("digest"), "digest", "left_anti")

    def learn(self, snippets: DataFrame, source: str = "source") -> int:
        """Walk what is new and keep its facts; how many sources that were."""
        walked = with_facts(self.new_sources(snippets, source), self.parts).select("digest", "facts")
        run = f"{self.path}/run={uuid.uuid4().hex}"
        walked.write.parquet(run)
        return self.spark.read.schema(self.schema).parquet(run).count()

    def with_facts(self, snippets: DataFrame, source: str = "source") -> DataFrame:
        """``snippets`` with the struct ``facts``, from the store alone: sources that it hasn't learnt have null facts."""
        keyed = snippets.withColumn("_digest", digest_of(F.col(source)))
        return keyed.join(self.known(), F.col("_digest") == F.col("digest"), "left").drop("_digest", "digest")
