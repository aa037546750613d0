"""Connected components of a table of links, by joins and aggregates; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipscan.llm.common import discard, materialize
from snipscan.llm.skew import hot_keys, join_split

MAX_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` has columns a, b. Returns (id, class) for each id in a link; the class is its component's smallest id.

    Each round takes the smallest label among an id and its neighbours, then the label of that label. A round's labels are a
    written table, so the plan doesn't grow. The links of an id that has very many, and the members of a very large class, are
    dealt over several tasks.
    """
    pairs = links.select("a", "b").where("a <> b")
    both = materialize(pairs.union(pairs.select("b", "a")).distinct(), "links")
    hubs = hot_keys(both, "b")
    hubs = hubs and materialize(hubs, "hubs")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("class")), "labels")
    for _ in range(MAX_ROUNDS):
        near = join_split(both, labels, "b", "id", hot=hubs).groupBy(F.col("a").alias("of")).agg(F.min("class").alias("near"))
        step = labels.join(near, F.col("id") == F.col("of"), "left").select("id", F.col("class").alias("was"), F.least("class", "near").alias("to"))
        jump = labels.select(F.col("id").alias("at"), F.col("class").alias("further"))
        written = None
        if hubs:  # large enough for a large class
            written = step = materialize(step, "step")
        new = materialize(join_split(step, jump, "to", "at", "left", hot=written and hot_keys(written, "to")).select("id", "was", F.least("to", "further").alias("class")), "labels")
        if written:
            discard(written)
        moved = new.where("class <> was").limit(1).count()
        discard(labels)
        labels = new.select("id", "class")
        if not moved:
            discard(both)
            if hubs:
                discard(hubs)
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
