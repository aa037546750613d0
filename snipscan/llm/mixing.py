"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The targets share all words by weight; a target stops at CAP times its source's words and the excess is shared anew. The
documents of a source are dealt into blocks by a hash. A source's quota is a number of block draws: whole passes over its
blocks, then blocks in a permuted order up to the remainder, the last of them in part (or,
where it is one document, the one that comes nearest). A binary tree over the output shards
splits the quotas: at each node the left half's share of every source is drawn from the multivariate hypergeometric
distribution with a generator seeded by the node, so any shard can be computed alone, and the shards' ranges of draws are
disjoint. Within a shard the documents are ordered by a hash.

Null and empty texts have size 0 and are taken 0 words. A null source is a source of its own, last in order. Equal rows
share a block; each counts, and the mix takes each as often as the others. A very long document is taken whole or not at all;
ties are broken by hashes of the rows. Results depend on the rows alone, not on how they lie. An empty table gives an empty
result. Columns of any name are carried along in a struct, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snipscan.llm.common import materialize

#: Weights by the source's place in code-point order, repeating.
WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 17
SHARD_WORDS = 4_000_000
#: Blocks of a source: at least, at most, and documents of the table for each.
BLOCKS_LOW, BLOCKS_HIGH, BLOCK_DOCS = 1_024, 65_536, 256
#: Blocks of all sources; beyond, each source has fewer. A block is drawn CAP + 1 times at most, and the generator of the hypergeometric distribution takes sums of under 10**9.
BLOCKS = 200_000_000
#: Sources are a dimension: their totals, a hundred bytes each, go to the driver. More than this is an error.
MAX_SOURCES = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> dict[str | None, float]:
    """The words that each source should give."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_ = float(sum(sizes.values())), list(order)
    target = dict.fromkeys(order, 0.0)
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        gone = set(over)
        open_ = [s for s in open_ if s not in gone]
    return target


def split_quotas(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first draw, number of draws) of each source in one shard: the walk from the root to its leaf."""
    start, have = np.zeros(len(quotas), np.int64), quotas.astype(np.int64)
    lo, hi = 0, shards
    while hi - lo > 1:
        mid = (lo + hi + 1) // 2
        take = int(have.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, take, method="marginals")
        if shard < mid:
            have, hi = left, mid
        else:
            start, have, lo = start + left, have - left, mid
    return start, have


def _uniform(*columns: Column) -> Column:
    return (F.xxhash64(*columns).cast("double") / F.lit(2.0**64)) + 0.5


def blocks_of_source(rows: int, sources: int, total: int = BLOCKS) -> int:
    """Blocks that each source is dealt into."""
    return max(1, min(BLOCKS_HIGH, max(BLOCKS_LOW, rows // BLOCK_DOCS), int(total / (1.2 * max(1, sources)))))


def with_draws(docs: DataFrame, seed: int = SEED, shard_words: int = SHARD_WORDS, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all) as the struct doc, and size, source_size, target and draws: an array of (pass, shard), one for each time the mix takes the row."""
    spark = docs.sparkSession
    rows, sources = docs.agg(F.count("*"), F.approx_count_distinct("source") + 1).first()
    blocks = blocks_of_source(rows, sources)
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    identity = [F.col("doc_id"), F.xxhash64("text")]
    row = F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns])  # so that no name of a column can clash
    sized = docs.select(row.alias("doc"), "doc_id", "text", "source").select("doc", *[e.alias(k) for k, e in {"_size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint"), "_key": key, "_block": F.pmod(F.xxhash64(*identity, F.lit(seed)), F.lit(blocks)).cast("int"), "_u": _uniform(*identity, F.lit(seed + 1))}.items()])
    table = materialize(sized.groupBy("_key", "_block").agg(F.sum("_size").alias("words"), F.count("*").alias("n")), "blocks")
    totals = table.groupBy("_key").agg(F.sum("words").alias("words"), F.count("*").alias("blocks")).limit(MAX_SOURCES + 1).toPandas().sort_values("_key", kind="stable")
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {(k[1:] if k else None): int(w) for k, w in zip(totals["_key"], totals["words"], strict=True)}
    target = source_targets(sizes)
    plan = pd.DataFrame({"_key": totals["_key"], "_source_size": totals["words"].astype("int64"), "blocks": totals["blocks"].astype("int64")})
    plan["_target"] = [target[k[1:] if k else None] for k in plan["_key"]]
    words = plan["_source_size"].clip(lower=1)
    plan["passes"] = np.minimum(CAP, (plan["_target"] / words + 1e-12).astype("int64"))
    plan["rest"] = np.maximum(0.0, plan["_target"] - plan["passes"] * plan["_source_size"])
    plan.loc[plan["passes"] >= CAP, "rest"] = 0.0
    plan["source"] = np.arange(len(plan))
    sources = F.broadcast(spark.createDataFrame(plan, "_key string, _source_size bigint, blocks bigint, _target double, passes bigint, rest double, source bigint"))

    order = Window.partitionBy("_key").orderBy(F.xxhash64("_key", "_block", F.lit(seed + 2)), "_block")
    ranked = table.join(sources, "_key").withColumns({"rank": F.row_number().over(order) - 1, "upto": F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    whole = Window.partitionBy("_key")
    fits = F.col("upto") <= F.col("rest")
    ranked = ranked.withColumns({"full": F.sum(fits.cast("bigint")).over(whole), "gap": F.col("rest") - F.coalesce(F.max(F.when(fits, F.col("upto"))).over(whole), F.lit(0))})
    # the block after the last that fits is taken in part; where it is one document, which can't be, a better one changes places with it
    alone = F.max((F.col("rank") == F.col("full")) & (F.col("n") == 1)).over(whole)
    best = F.min(F.when((F.col("rank") >= F.col("full")) & (F.col("n") == 1), F.struct(F.abs(F.col("words") - F.col("gap")).alias("off"), F.col("rank").alias("rank")))).over(whole)
    ranked = ranked.withColumns({"alone": alone, "best": best})
    place = F.when(~F.col("alone"), F.col("rank")).when(F.col("rank") == F.col("best.rank"), F.col("full")).when(F.col("rank") == F.col("full"), F.col("best.rank")).otherwise(F.col("rank"))
    part = (
        F.when(fits, 1.0)
        .when(F.col("place") != F.col("full"), 0.0)
        .when(F.col("alone"), (F.col("best.off") < F.col("gap")).cast("double"))
        .otherwise(F.least(F.lit(1.0), F.col("gap") / F.greatest(F.col("words"), F.lit(1))))
    )
    ranked = ranked.withColumn("place", place).select("_key", "_block", "source", F.col("place").alias("rank"), "passes", "blocks", part.alias("part"))
    ranked = materialize(ranked, "ranked-blocks")
    quotas = ranked.groupBy("source").agg((F.max("passes") * F.max("blocks") + F.count_if(F.col("part") > 0)).alias("q")).toPandas().set_index("source")["q"]
    quota = np.zeros(len(plan), np.int64)
    quota[quotas.index.to_numpy(np.int64)] = quotas.to_numpy(np.int64)
    shards = int(max(1, min(ceil(sum(target.values()) / shard_words), quota.sum() // 16)))

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                first, n = split_quotas(quota, shards, int(shard), seed)
                live = np.flatnonzero(n)
                yield pd.DataFrame({"shard": np.int64(shard), "source": live, "first": first[live], "n": n[live]})

    dealt = spark.range(shards).mapInPandas(leaves, "shard bigint, source bigint, first bigint, n bigint").select("shard", "source", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("draw"))
    per = F.broadcast(spark.createDataFrame(plan[["source", "blocks"]], "of bigint, per bigint"))
    dealt = dealt.join(per, F.col("source") == F.col("of")).select("shard", "source", F.expr("draw div per").alias("pass"), (F.col("draw") % F.col("per")).alias("rank"))
    draws = dealt.join(ranked, ["source", "rank"]).groupBy("_key", "_block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", F.when(F.col("pass") < F.col("passes"), 1.0).otherwise(F.col("part")).alias("part")))).alias("_drawn"))
    taken = F.filter("_drawn", lambda d: F.col("_u") < d["part"])
    out = sized.join(sources.select("_key", "_source_size", "_target"), "_key").join(draws, ["_key", "_block"], "left")
    none = F.array().cast("array<struct<pass:bigint,shard:bigint>>")
    found = F.when(F.col("_drawn").isNull(), none).otherwise(F.transform(taken, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"))))
    return out.select("doc", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), found.alias("draws"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix: a row for each time a document is taken, in the columns of ``docs``; shards lie together and are shuffled within."""
    rows = with_draws(docs, seed).select("doc", F.explode("draws").alias("draw"))
    spread = rows.repartition("draw.shard").sortWithinPartitions(F.col("draw.shard"), F.xxhash64("draw.shard", "draw.pass", "doc.doc_id", F.lit(seed)))
    return spread.select("doc.*")
