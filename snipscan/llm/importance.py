"""Importance resampling towards a target: documents whose words look like those of the target texts are drawn more often.

A word is a run of letters and digits of ASCII or of characters beyond it, A-Z in lower case; a feature is a run of ``run`` words
joined by one space, and its bucket is the crc32 of its UTF-8 bytes modulo ``buckets``. Equal texts are grouped by their full text
first: their features are hashed, counted and weighted once, and their counts enter the sums times the number of copies. A
bucket's gain is the floor of 1000 times the logarithm of its smoothed share in the target over that in the documents, and a
text's weight is the sum of its features' gains. Weights are joined back to documents by the text's SHA-256, and only then does
each document get its own noise (Gumbel, from a hash of seed and id) so that copies are drawn apart. The highest scores of the
documents with enough words are ranked by a sort over ranges; the driver sees one count for each range and one gain for each
bucket, whatever the number of documents.

A null or empty text has no feature and weight 0. A null id is hashed as the empty string and comes after ids in a tie; repeated
rows have the same score and stand one after the other in any order. A very long text is read whole. No
documents give no rows; an empty target leaves every bucket its smoothed share. Of the documents only the id and the text are
read, so other columns of any name change nothing.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipscan.llm.asciiwords import split_words
from snipscan.llm.common import discard, materialize, small_batches
from snipscan.llm.skew import hot_keys, join_split

RUN, BUCKETS, SEED, MIN_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Features whose buckets a worker remembers at most.
CACHE = 500_000
_FEATURES = "struct<n_words: bigint, n_features: bigint, buckets: array<int>, counts: array<bigint>>"


def _features(run: int, buckets: int):
    """A column of the features of a text: how many words and features, and how often each bucket stands."""
    known: dict[bytes, int] = {}

    def told(text: bytes) -> tuple[int, int, list[int], list[int]]:
        words = split_words(text)
        features = words if run == 1 else [b" ".join(words[i : i + run]) for i in range(len(words) - run + 1)]
        if len(known) > CACHE:
            known.clear()
        per = Counter()
        for feature, count in Counter(features).items():
            bucket = known.get(feature)
            if bucket is None:
                bucket = known[feature] = zlib.crc32(feature) % buckets
            per[bucket] += count
        return len(words), len(features), list(per), list(per.values())

    @F.arrow_udf(_FEATURES)
    def features(texts: pa.Array) -> pa.Array:
        rows = [told(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["n_words", "n_features", "buckets", "counts"])

    return features.asNondeterministic()  # so that it isn't merged into its uses


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def distinct_features(docs: DataFrame, text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(digest, copies, n_words, n_features, buckets, counts): a row for each full text, null being the empty one."""
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).groupBy("t").agg(F.count("*").alias("copies"))
    return texts.select(digest(F.col("t")).alias("digest"), "copies", _features(run, buckets)("t").alias("f")).select("digest", "copies", "f.*")


def bucket_sums(features: DataFrame) -> DataFrame:
    """(bucket, total): how often each bucket stands in all texts, copies counted; at most as many rows as there are buckets."""
    per = features.select("copies", F.explode(F.arrays_zip("buckets", "counts")).alias("b"))
    return per.groupBy(F.col("b.buckets").alias("bucket")).agg(F.sum(F.col("b.counts") * F.col("copies")).alias("total"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, from the sums of the documents and of the target, at most a row for each bucket."""
    s, t = ({r.bucket: r.total for r in sums.toLocalIterator()} for sums in (source, target))
    all_s, all_t = (float(sum(x.values()) + buckets) for x in (s, t))
    return np.array([math.floor(1000 * math.log((t.get(b, 0) + 1.0) * all_s / ((s.get(b, 0) + 1.0) * all_t))) for b in range(buckets)], np.int64)


def _weigher(gain: np.ndarray):
    @F.arrow_udf("bigint")
    def weigh(buckets: pa.Array, counts: pa.Array) -> pa.Array:
        lengths = buckets.value_lengths().to_numpy(zero_copy_only=False)
        each = gain[buckets.flatten().to_numpy(zero_copy_only=False)] * counts.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(each)))
        return pa.array(upto[ends] - upto[ends - lengths], pa.int64())

    return weigh


def weigh_documents(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, weight): a row for each document, as a written table."""
    small_batches(docs.sparkSession)
    features = materialize(distinct_features(docs, text, run, buckets), "text-features")
    gain = gains(bucket_sums(features), bucket_sums(distinct_features(target, target_text, run, buckets)), buckets)
    weights = features.select(F.col("digest").alias("of"), "n_words", "n_features", _weigher(gain)("buckets", "counts").alias("weight"))
    rows = materialize(docs.select(F.col(key).alias("id"), digest(F.col(text)).alias("digest")), "text-digests")
    out = materialize(join_split(rows, weights, "digest", "of", hot=hot_keys(rows, "digest")).select("id", "n_words", "n_features", "weight"), "weights")
    for spent in (features, rows):
        discard(spent)
    return out


def noise(key: Column, seed: int = SEED) -> Column:
    """The Gumbel noise of an id, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(2.0**32)))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", run: int = RUN, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_features, weight, score, rank): a row for each document, the drawn ones with their rank by falling score."""
    weighed = weigh_documents(docs, target, key, text, target_text, run, buckets)
    scored = weighed.select("id", "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score"), (F.col("n_words") >= min_words).alias("fit"))
    scored = scored.withColumn("at", F.monotonically_increasing_id())  # of a written table, so the same in each run of a task
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("id"), F.asc("at")]
    ranges = scored.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ranges = materialize(ranges.select("id", "n_features", "weight", "score", "fit", F.shiftright("place", 33).cast("int").alias("part"), F.col("place").bitwiseAND(2**33 - 1).alias("place")), "score-ranges")
    discard(weighed)
    sizes = {r.part: (r.n, r.m) for r in ranges.groupBy("part").agg(F.count("*").alias("n"), F.count_if("fit").alias("m")).toLocalIterator()}
    drawn = percent * sum(m for _, m in sizes.values()) // 100
    before, offsets = 0, []
    for k in range(max(sizes, default=-1) + 1):
        offsets.append(before)
        before += sizes.get(k, (0, 0))[0]
    start = F.get(F.array(*[F.lit(o).cast("bigint") for o in offsets or [0]]), F.col("part"))
    rank = start + F.col("place") + 1
    return ranges.select(F.col("id").alias(key), "n_features", "weight", "score", F.when(F.col("fit") & (rank <= drawn), rank).alias("rank"))
