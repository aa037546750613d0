"""Document fingerprints: spot signatures.

Each common word is an anchor; with the next CHAIN content words (words that are no anchor) it forms a signature. The start
of a text is an anchor too, so that a text without common words has a signature. The fingerprint is the sorted set of the
signatures' hashes. Two fingerprints are compared by their Jaccard likeness; sets whose sizes alone rule out a likeness are
in length partitions far apart and aren't intersected.

Null texts count as empty. An empty text, or one of fewer content words than a chain needs, has the signatures of what
words it has; without a word the set is empty, and two empty sets have likeness 1. A very long text is read whole. Rows without
an id come first, ties of a document id are ordered by text; rows of one id, or of none, lie in one window group, which
spills where it is large. Repeated rows follow one another. An empty table gives an empty result. Only doc_id and text are
read, so other columns of any name change nothing. Everything is DataFrame functions.
"""

from __future__ import annotations

import json
from math import isqrt, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snipscan.llm.buckets import EPSILON, by_counts, crowded, link_buckets
from snipscan.llm.common import discard, materialize
from snipscan.llm.skew import hot_keys, join_split

#: Common words of English, German, French and Spanish. Fixed values.
ANCHORS = """a an and are as at be by for from has he in is it its of on or that the this to was were will with
als auch auf aus bei das dem den der des die ein eine einen er es für ist mit nicht sich sie und von wie zu
au aux avec ce dans de des du elle en est et il la le les mais ne par pas pour que qui se sur un une
al como con del el ella en es la las lo los más no o para pero por que se su un una y"""
CHAIN = 2
#: Rows of a window group: the table is cut by id into groups of about so many rows.
GROUP_ROWS = 2_000
TAU = 0.8


def anchors() -> list[str]:
    return sorted(set(ANCHORS.split()))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the array ``out``: the sorted distinct 32-bit hashes of the text's signatures."""
    common = anchors()
    words, spots, content = f"{out}_w", f"{out}_s", f"{out}_c"
    df = df.withColumn(words, tokens(F.col(text)))
    df = df.withColumn(spots, F.filter(F.transform(words, lambda w, i: F.when(w.isin(common), i)), lambda i: i.isNotNull()))
    df = df.withColumn(content, F.filter(words, lambda w: ~w.isin(common)))

    def signature(anchor: Column, before: Column) -> Column:
        chain = F.concat_ws(" ", anchor, *[F.get(F.col(content), before + k) for k in range(CHAIN)])
        return (F.conv(F.substring(F.md5(chain), 1, 8), 16, 10).cast("bigint") - 2**31).cast("int")

    chained = F.transform(F.filter(F.transform(spots, lambda i, j: F.struct(i.alias("i"), (i - j).alias("b"))), lambda s: s["b"] + (CHAIN - 1) < F.size(content)), lambda s: signature(F.get(F.col(words), s["i"]), s["b"]))
    opening = F.when(F.size(words) > 0, F.array(signature(F.lit("^"), F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return df.withColumn(out, F.array_sort(F.array_distinct(F.concat(opening, chained)))).drop(words, spots, content)


def length_partition(size: Column, tau: float = TAU) -> Column:
    """Sets of a likeness of ``tau`` or more lie in the same partition or in neighbouring ones."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(-log(tau))).cast("int")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature arrays; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def pruned_likeness(a: Column, b: Column, tau: float = TAU) -> Column:
    """Jaccard where it can reach ``tau``; 0 where the sets' length partitions rule that out."""
    far = F.abs(length_partition(F.size(a), tau) - length_partition(F.size(b), tau)) > 1
    small = F.least(F.size(a), F.size(b)) < F.lit(tau) * F.greatest(F.size(a), F.size(b))
    like = likeness(a, b)
    return F.when(far | small, 0.0).when(like >= tau, like).otherwise(0.0)


def with_next(df: DataFrame, order: str, carry: list[str], ties: str) -> DataFrame:
    """``df`` with ``_next_<c>`` for each carried column: that of the next row by ``order``, nulls first, after the last row that of the first.

    Ids cut the table into groups, found by approximate percentiles; the row that opens a group is sent to the group before
    it as well, so each group sees the row that follows it. No group holds the whole table.
    """
    first, rows, nulls = df.agg(F.min(order), F.count(order), F.count_if(F.col(order).isNull())).first()
    if not rows + nulls:
        return df.select("*", *[F.col(c).alias(f"_next_{c}") for c in carry])
    groups = max(1, min(100_000, rows // GROUP_ROWS))
    cuts = df.agg(F.percentile_approx(order, [k / groups for k in range(1, groups)], 1_000_000)).first()[0] if groups > 1 else []
    cuts = sorted({*cuts} - {first})
    group, opens = _group(F.col(order), cuts)
    is_first = F.col(order).isNull() if nulls else F.col(order) == first
    place = lambda g, guest, wrap: F.struct(g.cast("int").alias("g"), F.lit(guest).alias("guest"), F.lit(wrap).alias("wrap"))
    places = F.array(place(group, 0, 0), F.when(opens, place(group - 1, 1, 0)), F.when(is_first, place(F.lit(len(cuts)), 1, 1)))
    dealt = df.select("*", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("_at"))
    window = Window.partitionBy("_at.g").orderBy(F.col("_at.wrap"), F.col(order).asc_nulls_first(), F.col("_at.guest"), F.col(ties).asc_nulls_first())
    return dealt.select("*", *[F.lead(c).over(window).alias(f"_next_{c}") for c in carry]).where("_at.guest = 0").drop("_at")


def _group(value: Column, cuts: list[int]) -> tuple[Column, Column]:
    """(number of cuts at or below the value, 0 for null; whether the value is a cut), by search in blocks of about a root of the cuts."""
    if not cuts:
        return F.lit(0), F.lit(False)
    side = isqrt(len(cuts)) + 1
    blocks = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    heads = F.from_json(F.lit(json.dumps([b[0] for b in blocks])), "array<bigint>")
    inner = F.get(F.from_json(F.lit(json.dumps(blocks)), "array<array<bigint>>"), F.size(F.filter(heads, lambda c: c <= value)) - 1)
    group = (F.size(F.filter(heads, lambda c: c <= value)) - 1) * side + F.size(F.filter(inner, lambda c: c <= value))
    return F.when(value.isNull() | (value < cuts[0]), 0).otherwise(group), F.coalesce(F.array_contains(inner, value), F.lit(False))


def edited_text(text: Column, following: Column) -> Column:
    """The last quarter of the text's code points replaced by as many from the start of the following text, or all of it."""
    n = F.length(text)
    k = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, _text, _edited and the signature arrays _own, _changed, _next__own of each document."""
    own = with_signatures(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")), "_text", "_own")
    linked = with_next(own, "doc_id", ["_text", "_own"], "_text")
    return with_signatures(linked.withColumn("_edited", edited_text(F.col("_text"), F.col("_next__text"))).drop("_next__text"), "_edited", "_changed")


def fingerprint_text(signatures: Column) -> Column:
    """The fingerprint as text: the sorted signature hashes."""
    return F.array_join(signatures, ",")


def near_classes(docs: DataFrame, tau: float = TAU, leaders: int = 3) -> DataFrame:
    """(doc_id, class_id) for each row of ``docs``: the smallest id of the documents whose fingerprints are alike by ``tau`` or more, directly or through others; null if none of them has an id.

    Equal fingerprints are one. Sets meet if they share one of their first hashes, as many as two sets of likeness ``tau``
    can't differ in, within a length partition or two neighbouring ones; a pair is verified by its pruned Jaccard. Empty
    fingerprints are alike.
    """
    signed = with_signatures(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")), "_text", "sig")
    own = materialize(signed.select("doc_id", "sig", F.unhex(F.md5(F.array_join("sig", ","))).alias("own_rep")), "fingerprints")
    grouped = own.groupBy("sig", F.col("own_rep").alias("rep")).agg(F.min("doc_id").alias("low"))
    sets = materialize(grouped.select("rep", "sig", F.size("sig").alias("n"), "low"), "fingerprint-sets")
    first = F.slice("sig", 1, (F.col("n") - F.ceil(F.col("n") * F.lit(tau) - EPSILON) + 1).cast("int"))
    part = length_partition(F.col("n"), tau)
    keys = sets.where("n > 0").select("rep", "n", part.alias("p"), F.explode(first).alias("h")).select("rep", "n", F.explode(F.array(F.struct("p", "h"), F.struct((F.col("p") + 1).alias("p"), "h"))).alias("key"))
    met = crowded(keys.select(F.xxhash64("key.p", "key.h").alias("key"), "rep", "n"))

    def verify(pairs: DataFrame) -> DataFrame:
        left, right = (sets.select(F.col("rep").alias(f"r{x}"), F.col("sig").alias(f"s{x}")) for x in "ab")
        with_a = join_split(pairs.select("a", "b"), left, "a", "ra", hot=hot_keys(pairs, "a")).select("a", "b", "sa")
        both = join_split(with_a, right, "b", "rb", hot=hot_keys(pairs, "b"))
        return materialize(both.where(pruned_likeness(F.col("sa"), F.col("sb"), tau) >= tau).select("a", "b"), "links")

    items = lambda some: sets.join(some, "rep").select("rep", "class", F.col("sig").cast("array<bigint>").alias("items"))
    classes = link_buckets(met, verify, tau, leaders, items, by_counts)
    named = materialize(sets.join(classes, F.col("rep") == F.col("id"), "left").select("rep", "low", F.coalesce("class", "rep").alias("class")), "fingerprint-classes")
    names = named.groupBy(F.col("class").alias("_class")).agg(F.min("low").alias("class_id"))
    out = materialize(join_split(named.select("rep", "class"), names, "class", "_class", hot=hot_keys(named, "class")).select("rep", "class_id"), "fingerprint-names")
    for done in (sets, met, classes, named):
        discard(done)
    return join_split(own.select("doc_id", "own_rep"), out, "own_rep", "rep", hot=hot_keys(own, "own_rep")).select("doc_id", "class_id")
