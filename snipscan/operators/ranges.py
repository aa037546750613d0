"""Running sums, positions and pages over a whole table, in two levels: by ranges of the order, then within each range.

The cuts between ranges are approximate quantiles of the order; any cuts give the same result, they only say how evenly
the rows are dealt. A range's total is summed before the shuffle, the running sum over ranges has a row for each range (without groups the driver takes it), and
windows run within ranges, so no task sees more than a range. Rows that are equal in the order lie in one range; rows
without an order come first, as in a window.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate
from math import ceil, floor, ulp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PARTS = 256


def cuts(rows: DataFrame, order: str, parts: int = PARTS) -> list[float]:
    """At most ``parts`` - 1 rising numbers that part the rows by ``order``, a number or a time, into even ranges."""
    shares = [F.lit(k / parts) for k in range(1, parts)]
    found = rows.agg(F.percentile_approx(_number(F.col(order)), F.array(*shares), 1_000).alias("c")).first().c
    return sorted(set(found or []))


def _number(order: Column) -> Column:
    return order.cast("double")


def range_of(order: Column, at: list[float]) -> Column:
    """The range of a row: how many cuts its order exceeds; -1 without an order."""
    n = F.size(F.filter(F.array(*map(F.lit, at)), lambda c: c < _number(order))) if at else F.lit(0)
    return F.when(order.isNotNull(), n).otherwise(-1)


def with_running_sum(rows: DataFrame, order: str, weight: Column, *keys: str, before: str = "_before", total: str = "_total", parts: int = PARTS) -> DataFrame:
    """``rows`` with the sum of ``weight`` over the rows before each in its group, and over the whole group."""
    dealt = rows.withColumns({"_range": range_of(F.col(order), cuts(rows, order, parts)), "_weight": weight})
    by = [*keys, "_range"]
    sums = dealt.groupBy(*by).agg(F.sum("_weight").alias("_sum"))
    within = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("_inside", F.coalesce(F.sum("_weight").over(within), F.lit(0)))
    rest = [F.col(f"`{c}`") for c in rows.columns]
    if not keys:  # a number for each range
        found = {r["_range"]: r["_sum"] or 0 for r in sums.collect()}
        upto = [0, *accumulate(found.get(k, 0) for k in range(-1, max(found, default=0) + 1))]
        return inside.select(*rest, (F.get(F.array(*map(F.lit, upto)), F.col("_range") + 1) + F.col("_inside")).alias(before), F.lit(upto[-1]).alias(total))
    group = Window.partitionBy(*keys)
    earlier = F.coalesce(F.sum("_sum").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(k).alias(f"_of_{k}") for k in by], earlier.alias("_earlier"), F.sum("_sum").over(group).alias(total))
    same = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"_of_{k}")), by, F.lit(True))
    return inside.join(sums, same).select(*rest, (F.col("_earlier") + F.col("_inside")).alias(before), F.col(total))


class Index:
    """How many rows each range of an order holds, so that a page is read from its ranges alone.

    ``counts`` has at most PARTS + 1 numbers on the driver; the first is that of rows without an order.
    """

    def __init__(self, rows: DataFrame, order: str, parts: int = PARTS):
        self.rows, self.order, self.at = rows, order, cuts(rows, order, parts)
        found = {r.k: r["count"] for r in rows.groupBy(range_of(F.col(order), self.at).alias("k")).count().collect()}
        self.counts = [found.get(k, 0) for k in range(-1, len(self.at) + 1)]

    def __len__(self) -> int:
        return sum(self.counts)

    def page(self, first: int, count: int) -> DataFrame:
        """The rows at positions [first, first + count) in the order, with ``position``; rows that tie are in any order. Filters by the order reach the scan."""
        first, stop = max(0, first), min(first + count, len(self))
        before, held = 0, []
        for k, n in enumerate(self.counts, -1):
            if n and before < stop and before + n > first:
                held.append((k, before))
            before += n
        if not held:
            return self.rows.withColumn("position", F.lit(0).cast("bigint")).where(F.lit(False))
        x, low, high = F.col(self.order), held[0][0], held[-1][0]
        whole = self.rows.schema[self.order].dataType.typeName() in ("byte", "short", "integer", "long")
        inside = F.lit(True)
        if low > 0:
            c = self.at[low - 1]
            inside = _number(x) > c
            if whole:  # a bound on the bare column is pushed down; it is looser by what a double may be off
                inside = inside & (x >= F.lit(floor(c - ulp(c))))
        if high < len(self.at):
            c = self.at[max(high, 0)]
            inside = inside & ((_number(x) <= c) if high >= 0 else x.isNull())
            if whole and high >= 0:
                inside = inside & (x <= F.lit(ceil(c + ulp(c))))
        if low < 0:
            inside = inside | x.isNull()
        k = range_of(x, self.at)
        earlier = F.coalesce(*[F.when(F.col("_range") == r, F.lit(b)) for r, b in held])
        nth = F.row_number().over(Window.partitionBy("_range").orderBy(self.order))
        placed = self.rows.where(inside).withColumn("_range", k).withColumn("position", (earlier + nth - 1).cast("bigint")).drop("_range")
        return placed.where((F.col("position") >= first) & (F.col("position") < stop))

    def latest(self, back: int, count: int) -> DataFrame:
        """The ``count`` rows that end ``back`` rows before the last."""
        stop = max(0, len(self) - back)
        return self.page(max(0, stop - count), min(count, stop))
