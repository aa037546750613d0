"""Links among sets that meet in buckets, without a bucket's pairs.

In a first round every member of a bucket is compared with one leader: the member with the most company in all its buckets,
so that few different pairs arise and the original of many copies leads them; verified links give classes. Buckets that
still hold several classes are compared again with a few other leaders, drawn anew for each bucket. A last pass is exact:
the sets of buckets that hold several classes even then are joined by their rarest items, as many as two like sets can't
differ in, and every pair of different classes that sizes and places in that order allow is verified. So two like sets that
share a bucket are always in one class; the leaders only spare the last pass its work.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipscan.llm.bitfield import bit_field, may_be_in, may_hold
from snipscan.llm.common import discard, materialize, small_batches
from snipscan.llm.components import connected_components
from snipscan.llm.skew import hot_keys, join_split

EPSILON = 1e-9  # for bounds whose product with a decimal share isn't exact


def crowded(members: DataFrame, sift: bool = False) -> DataFrame:
    """The members (key, rep, n) of buckets of two or more, with the bucket's leader ``lead``. ``sift``: members of other buckets are left out by a field of bits before they are shuffled (an Arrow function)."""
    sizes = materialize(members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    some = members.where(may_be_in(sizes.select("key"))(F.col("key"))) if sift else members
    shared = materialize(some.join(sizes, "key").select("key", "rep", "n", "size"), "bucket-sizes")
    company = shared.groupBy("rep").agg(F.sum("size").alias("company"))
    rank = F.struct((-F.col("company")).alias("c"), F.xxhash64("rep").alias("o"), "rep", "n")
    leads = shared.select("key", "rep", "n").join(company, "rep").groupBy("key").agg(F.min(rank).alias("lead"))
    met = materialize(shared.join(leads, "key").select("key", "rep", "n", "lead"), "bucket-members")
    discard(sizes)
    discard(shared)
    return met


def _fits(n: str | Column, m: str | Column, share: float) -> Column:
    """Whether sizes allow a likeness of ``share``."""
    return F.least(n, m) >= F.lit(share) * F.greatest(n, m) - EPSILON


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("rep", "lead.rep").alias("a"), F.greatest("rep", "lead.rep").alias("b")).distinct()


def _met_again(placed: DataFrame, share: float, leaders: int) -> DataFrame:
    """(rep, lead) of the second round: each member (key, rep, n, class) of a bucket of several classes with those of ``leaders`` leaders, drawn anew for each bucket, that it is compared with.

    A member has at most ``leaders`` rows for a bucket, however large this is; a leader that class or size rules out makes none.
    """
    orders = [F.min(F.struct(F.xxhash64("rep", "key", F.lit(r)).alias("o"), F.col("rep").alias("rep"), F.col("n").alias("n"), F.col("class").alias("class"))).alias(f"l{r}") for r in range(leaders)]
    split = placed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), *orders).where("low <> high").select("key", F.array(*[f"l{r}" for r in range(leaders)]).alias("leads"))
    other = F.filter("leads", lambda lead: (lead["class"] != F.col("class")) & _fits("n", lead["n"], share))
    return placed.join(split, "key").select("rep", F.explode(other).alias("lead"))


Verify = Callable[[DataFrame], DataFrame]
First = Callable[[DataFrame, float], tuple[DataFrame, list[DataFrame]]]


def link_buckets(met: DataFrame, verify: Verify, share: float, leaders: int, items: Verify, first_items: First) -> DataFrame:
    """(id, class) of the reps that have a link. ``met`` is what ``crowded`` gives; ``verify`` writes the like pairs (a, b) of a written table.

    ``items`` gives (rep, class, items) for a table (rep, class): arrays of different numbers, n of them. Pairs that ``verify``
    keeps have a Jaccard likeness of these of at least ``share``. ``first_items`` is ``by_counts`` or ``by_sifted_counts``.
    """
    first = materialize(_pairs(met.where((F.col("rep") != F.col("lead.rep")) & _fits("n", "lead.n", share))), "pairs-1")
    links = verify(first)
    classes = connected_components(links)
    second = materialize(_pairs(_met_again(_placed(met, classes), share, leaders)).join(first, ["a", "b"], "left_anti"), "pairs-2")
    written = [first, links, second]
    if second.limit(1).count():
        more = verify(second)
        written.append(more)
        classes = _joined(classes, more)
    third = _unlinked(met, classes, items, first_items, share)
    if third is not None:
        last = verify(third)
        written += [third, last]
        classes = _joined(classes, last)
    for done in written:
        discard(done)
    return classes


def _joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` after more links: only the classes that these join are worked on, not the links within classes. The table ``classes`` goes."""
    if not links.limit(1).count():
        return classes
    named = lambda side: classes.select(F.col("id").alias(f"id_{side}"), F.col("class").alias(f"class_{side}"))
    both = links.join(named("a"), F.col("a") == F.col("id_a"), "left").join(named("b"), F.col("b") == F.col("id_b"), "left")
    between = materialize(both.select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b")).distinct(), "class-links")
    merged = connected_components(between)
    # what was alone until now is in no class yet
    every = classes.unionByName(merged.select("id", F.col("id").alias("class")).join(classes.select("id"), "id", "left_anti"))
    every = materialize(every, "classes")
    to = merged.select(F.col("id").alias("was"), F.col("class").alias("now"))
    moved = materialize(join_split(every, to, "class", "was", "left", hot=hot_keys(every, "class")).select("id", F.coalesce("now", "class").alias("class")), "classes")
    for done in (classes, between, merged, every):
        discard(done)
    return moved


def _placed(met: DataFrame, classes: DataFrame) -> DataFrame:
    return met.join(classes, F.col("rep") == F.col("id"), "left").select("key", "rep", "n", F.coalesce("class", "rep").alias("class"))


def _unlinked(met: DataFrame, classes: DataFrame, items: Verify, first_items: First, share: float) -> DataFrame | None:
    """None if no bucket holds several classes, else all pairs (a, b) of different classes that may reach ``share``, among the members of buckets of several classes.

    Of two like sets of n <= m items, n + m - least and more are shared, and so is one of the first items by rarity of both;
    the first that is shared stands where enough follow it in both. Of the smaller set fewer items come first than of the larger.
    """
    placed = _placed(met, classes)
    split = placed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key")
    left = materialize(placed.join(split, "key").select("rep", "class").distinct(), "unlinked")
    if not left.limit(1).count():
        discard(left)
        return None
    sets = materialize(items(left).select("rep", "class", "items", F.monotonically_increasing_id().alias("nr")), "unlinked-sets")
    place = F.col("place")
    short = place <= F.col("n") - F.ceil(F.lit(2 * share / (1 + share)) * F.col("n") - EPSILON)
    told, spent = first_items(sets, share)
    rows = materialize(told.withColumn("short", short), "first-items")
    common = rows.groupBy("item").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max("short").alias("any")).where("low <> high and any").select("item")
    near = materialize(rows.join(common, "item"), "shared-items")
    # pairs of classes first, so that a class's own pairs never arise
    x = near.where("short").select("item", F.col("class").alias("cx"), F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("place").alias("px"))
    y = near.select(F.col("item").alias("_item"), F.col("class").alias("_class"), F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("place").alias("py"))
    met_classes = x.select("item", "cx").distinct().join(near.select("item", F.col("class").alias("cy")).distinct(), "item").where("cx <> cy")
    least = F.lit(share / (1 + share)) * (F.col("nx") + F.col("ny")) - EPSILON
    fits = (F.col("nx") <= F.col("ny")) & _fits("nx", "ny", share) & (F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= least)
    both = met_classes.join(x, ["item", "cx"]).join(y, (F.col("item") == F.col("_item")) & (F.col("cy") == F.col("_class")) & fits)
    pairs = materialize(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "unlinked-pairs")
    for done in (left, sets, rows, near, *spent):
        discard(done)
    return pairs


def by_counts(sets: DataFrame, share: float) -> tuple[DataFrame, list[DataFrame]]:
    """(rep, class, n, place, item): the first items of each set by rarity, as many as a larger set of a like pair must share one of; and written tables that go when it is read. DataFrame functions only."""
    items = materialize(sets.select("rep", "class", F.size("items").alias("n"), F.explode("items").alias("item")), "items")
    counts = items.groupBy(F.col("item").alias("_item")).agg(F.count("*").alias("times"))
    often = join_split(items, counts, "item", "_item", hot=hot_keys(items, "item")).groupBy("rep", "class", "n").agg(F.array_sort(F.collect_list(F.struct("times", "item"))).alias("all"))
    most = (F.col("n") - F.ceil(F.lit(share) * F.col("n") - EPSILON) + 1).cast("int")
    return often.select("rep", "class", "n", F.posexplode(F.slice("all", 1, most)).alias("place", "_i")).select("rep", "class", "n", "place", "_i.item"), [items]


def by_sifted_counts(sets: DataFrame, share: float) -> tuple[DataFrame, list[DataFrame]]:
    """As ``by_counts``, but items of one set only aren't told: they come first, and no other set shares them.

    A field of bits leaves most of them out before the exact counts are joined, and sets are known by their number ``nr`` meanwhile.
    """
    small_batches(sets.sparkSession)
    counts = materialize(sets.select(F.explode("items").alias("_item")).groupBy("_item").agg(F.count("*").alias("times")).where("times > 1"), "item-counts")
    field = sets.sparkSession.sparkContext.broadcast(bit_field(counts.select("_item")))

    @F.arrow_udf("array<bigint>")
    def shared(column: pa.Array) -> pa.Array:
        x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        keep = may_hold(field.value, x)
        ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(keep)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate((np.zeros(1, np.int64), upto[ends])).astype(np.int32)), pa.array(x[keep]))

    items = materialize(sets.select("nr", F.explode(shared("items")).alias("item")), "items")
    of = sets.select(F.col("nr").alias("_nr"), "rep", "class", F.size("items").alias("n"))
    found = join_split(items, counts, "item", "_item", hot=hot_keys(items, "item")).groupBy("nr").agg(F.array_sort(F.collect_list(F.struct("times", "item"))).alias("all"))
    most = (F.col("n") - F.ceil(F.lit(share) * F.col("n") - EPSILON) + 1).cast("int")
    alone = F.col("n") - F.size("all")
    first = found.join(of, F.col("nr") == F.col("_nr")).where(most > alone).select("rep", "class", "n", alone.alias("alone"), F.posexplode(F.slice("all", F.lit(1), most - alone)).alias("k", "_i"))
    return first.select("rep", "class", "n", (F.col("alone") + F.col("k")).alias("place"), F.col("_i.item").alias("item")), [counts, items]
