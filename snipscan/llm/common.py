"""What several operators share: the shared folder, written tables, bounded samples, batch sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark hands to Python at once; texts are wide, so few.
ARROW_ROWS = 512
ARROW_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, so that a worker holds a few MB of text at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode a new temporary one."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return context.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there, and a lost executor costs nothing.

    A result may read the table at any later time, so it stays until the application ends, or ``discard`` takes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until ``df`` has no column of the name: a caller's column is never taken."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def bounded_sample(df: DataFrame, keys: list[str], bound: int, seed: int) -> DataFrame:
    """At most ``bound`` rows, those with the smallest hashes of ``keys``: the same rows on each run, however the data lie.

    A count picks a hash cut-off that leaves about 1.2 x bound rows, so that the final top-k moves no more than these.
    """
    rank = F.xxhash64(*[F.col(k).cast("string") for k in keys], F.lit(seed))
    rows = df.count()
    if rows > 2 * bound:
        share = 1.2 * bound / rows
        df = df.where(rank < F.lit(int(-(2**63) + share * 2**64)))
    return df.orderBy(rank, *[F.col(k) for k in keys]).limit(bound)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
