"""Fields of bits that show which 64-bit hashes a table surely lacks, to leave rows out before a shuffle.

A field has a bit for each value of a hash's first bits, SPARE bits for each hash but at most 2**27 (16 MB), so it can be
broadcast whatever the table's size. A hash whose bit isn't set isn't in the table; one whose bit is set may be, and the join that
follows decides. With more hashes than a field has room for it lets more rows pass, and never drops one that counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each hash, and log2 of the fewest and most bits.
SPARE, LOG_BITS = 16, (15, 27)


def bit_field(hashes: DataFrame) -> np.ndarray:
    """The field of a written table's only column, a bigint."""
    (name,) = hashes.columns
    log = min(LOG_BITS[1], max(LOG_BITS[0], (SPARE * hashes.count()).bit_length()))
    top = F.shiftrightunsigned(name, 64 - log)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(top, F.lit(64)).cast("int"))
    bits = hashes.groupBy(F.shiftright(top, 6).cast("int").alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()  # at most as many rows as the field has words
    out = np.zeros(1 << (log - 6), np.int64)
    out[bits.column("word").to_numpy()] = bits.column("bits").to_numpy()
    return out.view(np.uint64)


def may_hold(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each 64-bit hash may be in the table, from the field's bits."""
    top = hashes.view(np.uint64) >> np.uint64(64 - 6 - (len(field).bit_length() - 1))
    return (field[top >> np.uint64(6)] >> (top & np.uint64(63)) & np.uint64(1)).astype(bool)


def may_be_in(hashes: DataFrame):
    """A condition on a bigint column: whether it may be among the hashes of a written table."""
    field = hashes.sparkSession.sparkContext.broadcast(bit_field(hashes))

    @F.arrow_udf("boolean")
    def held(column: pa.Array) -> pa.Array:
        return pa.array(may_hold(field.value, column.to_numpy(zero_copy_only=False).astype(np.int64)))

    def condition(column: Column) -> Column:
        return held(column)

    return condition
