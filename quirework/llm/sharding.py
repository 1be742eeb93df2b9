"""Sampled splitters: range-partition records into shards of near equal bytes.

A size-weighted sample of keys gives quantile splitters for many small ranges (several
per shard). Exact counts and bytes of the ranges replace the estimates: a range over its
share (a repeated key may hold a third of all rows) is subdivided by a hash of the id, and
where one id repeats so often that this is still too much, by the place of a row in the stored records.
Ranges then follow one another, and the running byte position of a record names its shard.

Only ids, sizes and hashes move; texts stay in the scan. No task holds more than one
range, and the number of ranges grows with the rows.

Defined results: a null text counts as empty (size 1); null ids sort first; repeated rows
are separate records; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.settle import settle

RANGES_PER_SHARD = 64
ROWS_PER_RANGE = 500_000
SAMPLES_PER_RANGE = 32


def records(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: id, size in bytes plus one, checksum and sort key.
    Equal texts have equal keys, so they lie side by side in the shard order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return documents.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )


def range_of(key: Column, splitters: list[int]) -> Column:
    """Number of splitters at or below the key, by binary search over a constant array."""
    if not splitters:
        return F.lit(0)
    steps = len(splitters).bit_length()
    padded = splitters + [2**63 - 1] * (2**steps - len(splitters))
    table = F.lit(padded)
    return F.aggregate(
        F.lit([2**b for b in reversed(range(steps))]), F.lit(0),
        lambda low, step: F.when(F.get(table, low + step - 1) <= key, low + step).otherwise(low),
    )


def splitters_of(recs: DataFrame, total: int, n_ranges: int) -> list[int]:
    """Quantiles of a sample that draws a record with a chance in proportion to its size.
    The draw hashes the id, so that a repeated task draws the same rows."""
    wanted = SAMPLES_PER_RANGE * n_ranges
    draw = F.pmod(F.xxhash64("doc_id", "key", F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = recs.where(draw < F.col("size") * F.lit(wanted / total))
    cuts = [i / n_ranges for i in range(1, n_ranges)]
    got = sample.agg(F.percentile_approx("key", cuts, 20 * n_ranges).alias("cuts")).first()["cuts"]
    return sorted(set(got or []))


PART = ["range_no", "part_no", "piece_no"]


def parted(recs: DataFrame, total: int, n_ranges: int) -> DataFrame:
    """Stored records with the columns ``PART``: their range and its subdivisions. No part has more
    than about twice the share of a range, but for one that is a single large record."""
    share = 2.0 * total / n_ranges
    shares = F.greatest(F.lit(1), F.ceil(F.sum("size") / share)).cast("int").alias("n_parts")
    ranged = recs.withColumn("row_no", F.monotonically_increasing_id()).withColumn("range_no", range_of(F.col("key"), splitters_of(recs, total, n_ranges)))
    # Both tables go to all tasks: at most one row a range, and three for two ranges.
    by_id = ranged.join(F.broadcast(ranged.groupBy("range_no").agg(shares)), "range_no").withColumn(
        "part_no", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("n_parts")).cast("int")).drop("n_parts")
    # Ids that differ fill a part to its share, by and large; twice that is one id again and again.
    pieces = by_id.groupBy("range_no", "part_no").agg(F.greatest(F.lit(1), F.floor(F.sum("size") / share)).cast("int").alias("n_pieces"))
    return by_id.join(F.broadcast(pieces), ["range_no", "part_no"]).withColumn(
        "piece_no", F.pmod(F.xxhash64("row_no"), F.col("n_pieces")).cast("int")).drop("n_pieces", "row_no")


def assign(recs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Adds ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard)."""
    recs = settle(recs)
    whole = recs.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    if not whole["n"]:
        return recs.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    n, total = whole["n"], whole["bytes"]
    n_ranges = n_shards * max(RANGES_PER_SHARD, math.ceil(n / n_shards / ROWS_PER_RANGE))
    ranged = settle(parted(recs, total, n_ranges))
    # One row per range: a bounded multiple of the number of shards.
    in_order = Window.orderBy(*PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(*PART).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
        .select(
            *PART, F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("rank_0"),
            F.coalesce(F.sum("bytes").over(in_order), F.lit(0)).alias("byte_0"),
        )
    )
    inside = Window.partitionBy(*PART).orderBy("key", "doc_id", "size")
    middle = F.col("byte_0") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    placed = settle(
        ranged.join(starts, PART).select(
            *recs.columns,
            F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / total)).cast("int").alias("shard"),
            (F.col("rank_0") + F.row_number().over(inside) - 1).alias("rank"),
        )
    )
    first = placed.groupBy("shard").agg(F.min("rank").alias("rank_0"))
    return placed.join(first, "shard").select(*recs.columns, "shard", (F.col("rank") - F.col("rank_0")).alias("slot"))
