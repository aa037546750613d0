"""Snippets that stand in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, pattern: str = "*.py") -> DataFrame:
    """snippet_id (the path), ts (when it was changed, in ms), name, origin, source of each file under a path. What isn't UTF-8 is replaced."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return f.select(F.col("path").alias("snippet_id"), F.unix_millis("modificationTime").alias("ts"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("file").alias("origin"), F.make_valid_utf8(F.col("content").cast("string")).alias("source"))


def scripts(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """The table (path, content) that ``extract_all`` joins; paths are taken from ``root`` on, as commands name them."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace("path", "^file:/*", "/")
    return f.select(F.when(name.startswith(root), F.substring(name, len(root) + 1, 1_000_000)).otherwise(name).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def long_enough(snippets: DataFrame, lines: int) -> DataFrame:
    """Snippets of at least so many lines: a filter on the source, before any of it is parsed."""
    text = F.regexp_replace("source", r"\n\z", "")
    return snippets.where((F.lit(lines) <= 0) | (F.coalesce(F.when(F.length("source") > 0, F.size(F.split(text, "\n", -1))), F.lit(0)) >= lines))
