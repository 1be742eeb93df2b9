"""A filter of bounded size that keeps most foreign rows out of a later exact join.

The hashes of the wanted keys set bits in a bitmap of ``FILTER_BITS`` bits (1 MB), whatever
their number; the bitmap goes to all tasks. Where there are too many keys for it, more rows pass,
and the exact join that follows still decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS, CELL_BITS = 1 << 23, 1 << 15


def marked(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """``rows`` with a column ``maybe``: false only if no key of ``wanted`` equals its key."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    cells = wanted.select(place(wanted_key).alias("p")).groupBy(F.floor(F.col("p") / CELL_BITS).alias("cell")).agg(
        F.bitmap_construct_agg(F.pmod("p", F.lit(CELL_BITS))).alias("bits")
    )
    at = f"cast(pmod(place, {CELL_BITS}) as int)"
    byte = f"cast(conv(hex(substring(bits, {at} div 8 + 1, 1)), 16, 10) as int)"
    placed = rows.withColumn("place", place(key))
    # Never null, and said so: else a filter on the outcome would compute the key once more, below the join.
    cell = F.coalesce(F.floor(F.col("place") / CELL_BITS), F.lit(-1))
    found = placed.join(F.broadcast(cells), cell == F.col("cell"), "left")
    return found.withColumn("maybe", F.expr(f"bits is not null and {byte} & shiftleft(1, {at} % 8) != 0")).drop("place", "cell", "bits")


def among(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Rows whose key may be among the wanted keys."""
    return marked(rows, key, wanted, wanted_key).where("maybe").drop("maybe")
