"""Token counts kept up by deltas: totals by source, language and tokenizer version.

A change is a signed row: an insert adds a document and its tokens, a delete takes both away, a revised count takes the old
tokens away and adds the new ones. The totals are sums, so a batch of changes is folded into a handful of rows before it
meets the state. A batch has an id; a commit writes a new snapshot, then a line in the log that names it. A batch whose id
is in the log is not folded in again, so a redelivery changes nothing, and a snapshot without a log line never counts.

Null sources and languages are groups of their own; null and empty texts have 0 tokens. Repeated rows count as often as
they stand, and of batches that are ready at once any may come first. A very long text is tokenised whole. Groups whose documents
and tokens come to zero vanish. An empty batch only leaves its line in the log. Of the documents only doc_id, source, lang and
text are read, so other columns of any name change nothing.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipscan.llm import tokens
from snipscan.llm.common import discard, materialize, shared_dir, small_batches

KEYS = ["source", "lang", "tokenizer_version"]
_TOTALS = "source string, lang string, tokenizer_version string, n_docs bigint, n_tokens bigint"
_LOG = "batch_id string, number bigint, snapshot string"
#: Races with other writers that a commit loses before it gives up.
TRIES = 100


def token_counts(docs: DataFrame, version: str = "word_bpe_49k", tokenizer: str | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer_version, tokens of each document."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(x) // 4 for x in tokens.cache(tokenizer).encode(texts.to_pylist())], pa.int64())

    return docs.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), count.asNondeterministic()("text").alias("tokens"))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("bigint").alias("n_docs"), F.col("tokens").alias("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("bigint").alias("n_docs"), (-F.col("tokens")).alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows that lead from the counts ``old`` to ``new``; both have a row for each document and version."""
    was = old.select(F.col("doc_id").alias("_id"), *[F.col(k).alias(f"_{k}") for k in KEYS], F.col("tokens").alias("_was"))
    both = was.join(new, (F.col("_id") == F.col("doc_id")) & (F.col("_tokenizer_version") == F.col("tokenizer_version")), "full")
    same = F.col("_source").eqNullSafe(F.col("source")) & F.col("_lang").eqNullSafe(F.col("lang")) & (F.col("_was") == F.col("tokens"))
    minus = F.struct(*[F.col(f"_{k}").alias(k) for k in KEYS], F.lit(-1).cast("bigint").alias("n_docs"), (-F.col("_was")).alias("n_tokens"))
    plus = F.struct(*KEYS, F.lit(1).cast("bigint").alias("n_docs"), F.col("tokens").alias("n_tokens"))
    signed = F.array(F.when(F.col("_was").isNotNull(), minus), F.when(F.col("tokens").isNotNull(), plus))
    return both.where(~F.coalesce(same, F.lit(False))).select(F.explode(F.filter(signed, lambda x: x.isNotNull())).alias("d")).select("d.*")


class Rollup:
    """The totals under one folder, which driver and executors share.

    ``log`` holds one small file for each commit, named by its number. It is created exclusively, so of two writers that
    saw the same last number one starts again, and then finds the other's batch. A file that a lost writer left empty or
    unfinished counts as no commit, and its number is passed over: numbers in use are those of the folder's listing, whatever
    the files hold. A snapshot that no log line came to name is deleted by its writer, and one that a lost writer left by ``vacuum``.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/token-rollup-{uuid.uuid4().hex}"
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if path is None:
            self._files.deleteOnExit(root)

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _log(self) -> DataFrame:
        """(batch_id, number, snapshot): the commits."""
        self._files.mkdirs(self._place("log"))
        return self.spark.read.text(f"{self.path}/log", wholetext=True).select(F.from_json("value", _LOG).alias("c")).select("c.*").where("snapshot is not null")

    def _used(self) -> int:
        """The highest number in the name of a file of the log, finished or not; -1 if there is none."""
        names = (status.getPath().getName() for status in self._files.listStatus(self._place("log")))
        return max((int(n.split(".")[0]) for n in names if n.split(".")[0].isdigit()), default=-1)

    def _last(self, batch_id: str | None = None) -> tuple[str | None, bool]:
        """(snapshot of the last commit or None, whether a batch of this id is in the log)."""
        last, seen = self._log().agg(F.max(F.struct("number", "snapshot")), F.max(F.col("batch_id") == F.lit(batch_id))).first()
        return last and last.snapshot, bool(seen)

    def _at(self, snapshot: str | None) -> DataFrame:
        if snapshot is None:
            return self.spark.createDataFrame([], _TOTALS)
        return self.spark.read.schema(_TOTALS).parquet(f"{self.path}/{snapshot}")

    def totals(self) -> DataFrame:
        """The state after the last commit."""
        return self._at(self._last()[0])

    def _create(self, number: int, line: str) -> bool:
        """Write the log's file of this number; False if there is one."""
        path = self._place(f"log/{number:012d}.json")
        try:
            out = self._files.create(path, False)
        except Py4JJavaError:
            if self._files.exists(path):
                return False
            raise
        out.write(bytearray(line, "utf-8"))
        out.close()
        return True

    def commit(self, batch_id: str, delta: DataFrame) -> bool:
        """Fold in a batch of signed rows; False if a batch of this id was committed before. Gives up after TRIES lost races."""
        sums = [F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")]
        folded = None
        try:
            for _ in range(TRIES):
                self._files.mkdirs(self._place("log"))
                number = self._used() + 1  # before the log is read: who takes the number later is seen as lost
                before, seen = self._last(batch_id)
                if seen:
                    return False
                folded = folded or materialize(delta.groupBy(*KEYS).agg(*sums), "rollup-delta")
                snapshot = f"snapshot-{number}-{uuid.uuid4().hex}"
                new = self._at(before).unionByName(folded).groupBy(*KEYS).agg(*sums)
                new.where("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{self.path}/{snapshot}")
                if self._create(number, json.dumps({"batch_id": batch_id, "number": number, "snapshot": snapshot})):
                    return True
                self._files.delete(self._place(snapshot), True)
        finally:
            if folded is not None:
                discard(folded)
        raise RuntimeError(f"batch {batch_id} lost {TRIES} races for the log")

    def vacuum(self, keep: int = 2) -> int:
        """Delete snapshots but those of the last ``keep`` commits (readers may still hold one); how many went. Not while a commit runs: its snapshot isn't in the log yet."""
        named = {r.snapshot for r in self._log().orderBy(F.desc("number")).limit(max(1, keep)).collect()}
        names = [status.getPath().getName() for status in self._files.listStatus(self._place(""))]
        spent = [n for n in names if n.startswith("snapshot-") and n not in named]
        for name in spent:
            self._files.delete(self._place(name), True)
        return len(spent)
