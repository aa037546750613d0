"""Joins of a table that grows with one whose key is unique, where one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one row in HOT and more than SPLIT_ROWS of them, so there are under HOT hot keys however large the table.
HOT, SPLIT_ROWS = 1_000, 100_000
#: Tasks that share a hot key.
SALTS = 32


def hot_keys(left: DataFrame, key: str) -> DataFrame | None:
    """The hot values of a column of a written table, under HOT rows; None if the table is too small to have one."""
    rows = left.count()
    if rows <= SPLIT_ROWS:
        return None
    return left.groupBy(F.col(key).alias("_hot")).count().where(F.col("count") > max(SPLIT_ROWS, rows // HOT)).select("_hot", F.lit(True).alias("_is_hot"))


def join_split(left: DataFrame, right: DataFrame, key: str, to: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key`` = ``to``, which is unique in ``right``.

    Rows of a hot key are dealt over SALTS by a hash of the whole row, and the row of ``right`` is copied to each of them.
    ``hot`` is what ``hot_keys(left, key)`` gave.
    """
    if hot is None:
        return left.join(right, F.col(key) == F.col(to), how)
    hot, all_of = F.broadcast(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))
    salt = F.when(F.col("_is_hot"), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = left.join(hot, F.col(key) == F.col("_hot"), "left").select(*left.columns, salt.alias("_salt"))
    copies = right.join(hot, F.col(to) == F.col("_hot"), "left").select(*right.columns, F.explode(F.when(F.col("_is_hot"), all_of).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return dealt.join(copies, (F.col(key) == F.col(to)) & (F.col("_salt") == F.col("_copy")), how).drop("_salt", "_copy")
