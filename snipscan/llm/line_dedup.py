"""Line dedup: removes lines that stand on many sites, and keeps each such line once.

A line is what lies between newlines, compared without the blanks at its ends; blank lines are never removed. Its spread is
the number of distinct sites (``source``) with a document that holds it. Per line, a HyperLogLog sketch of its sites is built
before the shuffle and merged after it. Where the estimate is near the threshold, the distinct sites are counted exactly. A
line with a spread of at least ``min_sites`` goes from everywhere but its first place: the smallest document id, then the
first position. A line that stands in very many documents, as the lines sought here do, is dealt over several tasks.

Null texts stay null, empty ones empty; a null source is a site of its own. Rows without an id are left as they are. Equal rows are
edited alike: the first place is one of each of them; of documents with the same id the text's hash decides. A very long text
is split and joined whole. An empty table gives an empty result. Columns of any name are kept: a result whose name is taken
gets underscores before it. Everything is DataFrame functions.
"""

from __future__ import annotations

from math import floor, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipscan.llm.common import discard, free_name, materialize
from snipscan.llm.skew import HOT, SPLIT_ROWS, join_split

MIN_SITES = 5
#: log2 of the sketch's registers, and the standard errors within which an estimate counts as near the threshold.
LG_REGISTERS, SIGMAS = 12, 6.0
_BLANKS = " \t\r"


def _lines(docs: DataFrame, text: str, site: str) -> DataFrame:
    """A row for each line that isn't blank: the key (96 bits of hashes and the length), site, place."""
    return (
        docs.where(F.col("doc_id").isNotNull() & F.col(text).isNotNull())
        .select("doc_id", F.xxhash64(text).alias("_t"), F.coalesce(F.concat(F.lit("s"), F.col(site)), F.lit("")).alias("_site"), F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line"))
        .select("doc_id", "_t", "_site", "_pos", F.btrim("_line", F.lit(_BLANKS)).alias("_line"))
        .where("_line <> ''")
        .select(F.xxhash64("_line").alias("_a"), F.hash("_line").alias("_b"), F.length("_line").alias("_n"), "_site", "doc_id", "_t", "_pos")
    )


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Keys of the lines on at least ``min_sites`` sites, each with its first place and how often it stands, as a written table."""
    key = ["_a", "_b", "_n"]
    error = SIGMAS * 1.04 / sqrt(2**LG_REGISTERS)
    low, high = min_sites * (1 - error), min_sites * (1 + error)
    sketched = lines.groupBy(*key).agg(F.hll_sketch_agg("_site", F.lit(LG_REGISTERS)).alias("_sketch"), F.min(F.struct("doc_id", "_t", "_pos")).alias("_first"), F.count("*").alias("_times"))
    sketched = materialize(sketched.select(*key, "_first", "_times", F.hll_sketch_estimate("_sketch").alias("_sites")).where(F.col("_sites") >= floor(low)), "line-spread")
    far = sketched.where(F.col("_sites") > high).select(*key, "_first", "_times")
    near = sketched.where(F.col("_sites") <= high).select(*key, "_first", "_times")
    exact = lines.join(near.select(*key), key, "left_semi").groupBy(*key, "_site").agg(F.lit(1).alias("_one")).groupBy(*key).agg(F.count("*").alias("_sites"))
    wide = materialize(far.unionByName(near.join(exact.where(F.col("_sites") >= min_sites).select(*key), key, "left_semi")), "wide-lines")
    discard(sketched)
    return wide


def _hot(wide: DataFrame) -> DataFrame | None:
    """The keys (_hot, _is_hot) of lines that stand so often that one task isn't enough for one; fewer than HOT, or None."""
    least = max(SPLIT_ROWS, (wide.agg(F.sum("_times")).first()[0] or 0) // HOT)
    hot = wide.where(F.col("_times") > least)
    return hot.select(F.struct("_a", "_b", "_n").alias("_hot"), F.lit(True).alias("_is_hot")) if hot.limit(1).count() else None


def dedup_lines(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with the text edited; last come ``_removed``, the positions of the lines that went (null: none), and ``_lines``, how many there were."""
    lines = _lines(docs, text, site)
    wide = spread_lines(lines, min_sites)
    keyed = lines.select(F.struct("_a", "_b", "_n").alias("_key"), "doc_id", "_t", "_pos")
    gone = (
        join_split(keyed, wide.select(F.struct("_a", "_b", "_n").alias("_to"), "_first"), "_key", "_to", hot=_hot(wide))
        .where(F.struct("doc_id", "_t", "_pos") != F.col("_first"))
        .groupBy(F.col("doc_id").alias("of"), F.col("_t").alias("of_text"))
        .agg(F.collect_set("_pos").alias("removed"))
    )
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))  # so that no name of a column can clash
    old = F.col(f"doc.`{text}`")
    parts = F.split(old, "\n", -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("removed", i)), "\n")
    made = {text: F.when(F.col("removed").isNull(), old).otherwise(kept)}
    joined = whole.join(gone, (F.col("doc.doc_id") == F.col("of")) & (F.xxhash64(old) == F.col("of_text")), "left")
    rest = [made.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns]
    return joined.select(*rest, F.col("removed").alias(free_name(docs, "_removed")), F.size(parts).alias(free_name(docs, "_lines")))


def edit_documents(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with the texts edited and ``n_chars``, where there is one, made that of the new text; no row goes."""
    out = dedup_lines(docs, min_sites=min_sites)
    made = {"n_chars": F.length("text").cast("bigint")} if "n_chars" in docs.columns else {}
    return out.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in docs.columns])
