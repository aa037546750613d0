"""A corpus through five stages: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the table is written and read again. All
but the last return the columns of ``documents``, whatever else they are called: no column is taken or renamed.

Rows with a null or empty text have no word and go in the first stage, as the base rules say. A null source is a site, and a
source, of its own; rows without an id stay as they are in line dedup, one of each class without an id stays in near-dedup,
and mixing and packing treat them as any other. Very long texts are read whole in each stage; only packing cuts, into
pieces. Repeated rows are judged alike, edited alike, and are one class, of which one row stays. Ties are broken by ids and
hashes of the rows, never by how they lie. An empty table runs through to an empty result, and so does one without labels,
whose first stage knows the base rules alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from snipscan.llm import line_dedup, mixing, order_minhash, packing, rule_forest
from snipscan.llm.common import discard, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return rule_forest.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the lines of many sites; n_chars follows the text."""
    return line_dedup.edit_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return order_minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", remove_common_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL states the forest, the tokenizer or the packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are a table in the shared folder, until the next stage's are there."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if written is not None:
            discard(written)
        written = docs
    return docs
