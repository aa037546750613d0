"""Benchmark decontamination: which words of which documents stand in passages of benchmark items.

An item's windows are its runs of ``size`` consecutive words; an item of fewer words is one window. A document contains a window
where the same words stand in the same order, and every word inside is hit. This is a set join with containment 1, filtered by
prefixes: a window's shingles are its runs of five words (all of a shorter window), ordered by how rarely they stand in
the documents, and since all of them are needed, the rarest alone is a sufficient prefix. A shingle that no document has
rules its windows out.

One pass over the texts counts the shingles of items, one takes the places of prefix shingles with the words around them. Both
leave out at once what a bit field of fixed size shows no item has, so nothing that grows with documents or items is broadcast.
Places are joined with windows by shingle; bounds by length and position (the window must begin and end inside the document) come
before the words are compared, in the slice of the document that has the window's size. A shingle that stands very often is dealt
over several tasks. The hit words are the union of the matches, counted in order of place within each document.

A null or empty text has no words. Items with the same id are one item (their texts are windows of both); an item without an id
is named by the empty string, and one without words matches nothing. Repeated rows and ids of documents are told row by row.
A very long text is read whole. Empty tables give an empty result or no hit. Only ids and texts are read, so other columns of any name
change nothing. One document's matches and item ids meet in one task; they are bounded by its own words and the items in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snipscan.llm.asciiwords import split_words
from snipscan.llm.bitfield import bit_field, may_hold
from snipscan.llm.common import discard, materialize, small_batches
from snipscan.llm.skew import hot_keys, join_split

SIZE, SHINGLE = 10, 5
_PLACES = "array<struct<at: int, shingle: bigint, before: int, around: string>>"


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` words, from their crc32; equal hashes are compared word by word later."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ each[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def windows(items: DataFrame, key: str = "item_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(item, window): the distinct windows of each item, words joined by one space; item is the id as text."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        rows = [split_words(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
        return pa.array([[b" ".join(w[i : i + size]).decode(errors="replace") for i in range(max(1, len(w) - size + 1))] if w else [] for w in rows], pa.list_(pa.string()))

    return items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.explode(cut.asNondeterministic()(text)).alias("window")).distinct()


def window_shingles(found: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(window, n, k, at, shingle): each place of a distinct window's shingles of k words, its n words counted."""

    @F.arrow_udf("struct<n: int, k: int, shingles: array<bigint>>")
    def cut(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            w = t.encode().split(b" ")
            k = min(shingle, len(w))
            rows.append({"n": len(w), "k": k, "shingles": shingle_hashes(w, k).view(np.int64).tolist()})
        return pa.array(rows, pa.struct([("n", pa.int32()), ("k", pa.int32()), ("shingles", pa.list_(pa.int64()))]))

    each = found.select("window").distinct().select("window", cut.asNondeterministic()("window").alias("s"))
    return each.select("window", "s.n", "s.k", F.posexplode("s.shingles").alias("at", "shingle"))


class _Finder:
    """Where the shingles of a text may be an item's, by a bit field."""

    def __init__(self, field, sizes: list[int]):
        self.field, self.sizes = field, sizes

    def __call__(self, words: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, places, hashes) for each length of shingle."""
        for k in self.sizes:
            h = shingle_hashes(words, k)
            at = np.flatnonzero(may_hold(self.field.value, h))
            if len(at):
                yield k, at, h[at].view(np.int64)


def count_shingles(docs: DataFrame, finder: _Finder, text: str = "text") -> DataFrame:
    """(shingle, count) of what the field lets pass in the documents, summed before and after the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for t in batch.column(0).cast(pa.binary()).to_pylist() if t for _, _, h in finder(split_words(t))]
            values, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.record_batch([pa.array(values), pa.array(counts, pa.int64())], ["shingle", "count"])

    return docs.select(text).mapInArrow(count, "shingle bigint, count bigint").groupBy("shingle").agg(F.sum("count").alias("count"))


def prefixes(shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, n, k, at, shingle): the rarest shingle of each window all of whose shingles stand in some document."""
    known = join_split(shingles, counts.select(F.col("shingle").alias("of"), "count"), "shingle", "of", "left", hot=hot_keys(shingles, "shingle"))
    rarest = known.groupBy("window", "n", "k").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "shingle", "at")).alias("p"))
    return rarest.where("p.count > 0").select("window", "n", "k", "p.at", "p.shingle")


def _places(finder: _Finder, size: int):
    """A column of how many words a text has, and the places of shingles with the words of all windows that may hold them."""

    def told(text: bytes) -> dict:
        words, out = split_words(text), []
        for k, at, hashes in finder(words):
            for i, h in zip(at.tolist(), hashes.tolist(), strict=True):
                lo = max(0, i - max(0, size - k))
                out.append({"at": i, "shingle": h, "before": i - lo, "around": b" ".join(words[lo : i + max(size, k)]).decode(errors="replace")})
        return {"n_words": len(words), "places": out}

    @F.arrow_udf(f"struct<n_words: bigint, places: {_PLACES}>")
    def places(texts: pa.Array) -> pa.Array:
        place = pa.struct([("at", pa.int32()), ("shingle", pa.int64()), ("before", pa.int32()), ("around", pa.string())])
        return pa.array([told(t or b"") for t in texts.cast(pa.binary()).to_pylist()], pa.struct([("n_words", pa.int64()), ("places", pa.list_(place))]))

    return places.asNondeterministic()  # so that it isn't merged into its uses


def matches(places: DataFrame, prefix: DataFrame) -> DataFrame:
    """(row, start, n, window): where a window stands in a document, each once."""
    near = places.select("row", "n_words", "at", "shingle", "before", "around")
    p = prefix.select(F.col("shingle").alias("of"), "window", "n", F.col("at").alias("offset"))
    both = join_split(near, p, "shingle", "of", hot=hot_keys(near, "shingle"))
    start = F.col("at") - F.col("offset")
    bounds = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    words = F.slice(F.split("around", " "), F.col("before") - F.col("offset") + 1, F.col("n"))
    found = both.where(bounds & (F.col("offset") <= F.col("before")))
    return found.where(F.array_join(words, " ") == F.col("window")).select("row", start.alias("start"), "n", "window")


def hit_words(found: DataFrame) -> DataFrame:
    """(row, n_hit): the words inside the union of a document's matches."""
    spans = found.groupBy("row", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    reached = F.coalesce(F.max("end").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = spans.select("row", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reached)).alias("fresh"))
    return fresh.groupBy("row").agg(F.sum("fresh").cast("bigint").alias("n_hit"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated): a row for each document."""
    spark = docs.sparkSession
    small_batches(spark)
    of_items = materialize(windows(items, item_key, item_text, size), "item-windows")
    shingles = materialize(window_shingles(of_items), "window-shingles")
    sizes = sorted(r.k for r in shingles.select("k").distinct().collect())
    counts = count_shingles(docs, _Finder(spark.sparkContext.broadcast(bit_field(shingles.select("shingle"))), sizes), text)
    prefix = materialize(prefixes(shingles, counts), "prefixes")
    finder = _Finder(spark.sparkContext.broadcast(bit_field(prefix.select("shingle"))), sizes)
    told = docs.select(F.col(key).alias("id"), _places(finder, size)(text).alias("w")).select("id", "w.n_words", "w.places")
    rows = materialize(told.withColumn("row", F.monotonically_increasing_id()), "document-places")
    places = rows.select("row", "n_words", F.explode("places").alias("p")).select("row", "n_words", "p.*")
    found = materialize(matches(places, prefix), "matches")
    pairs = found.select("row", "window").distinct()
    of = of_items.select("item", F.col("window").alias("of"))
    each = join_split(pairs, of, "window", "of", hot=hot_keys(found, "window")).groupBy("row", "item").agg(F.lit(1).alias("_one"))
    which = each.groupBy("row").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    out = rows.select("id", "n_words", "row").join(hit_words(found).join(which, "row"), "row", "left")
    for spent in (shingles, prefix):
        discard(spent)
    n_hit, n_items = (F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_hit", "n_items"))
    return out.select(F.col("id").alias(key), "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
