"""Exact dedup: one row of every set of equal texts stays.

Texts are equal when they are identical after their white space (0x20 and 0x09 to 0x0D) is
deleted. Rows are grouped by a 128-bit content hash of that normalised text. Bytes are
compared inside the groups: texts whose hash stands more than once are grouped again by
(hash, text), with partial aggregation in the map tasks, so a text that makes up a third of
all rows leaves each task once. A hash that holds two different texts is a collision; its
rows are told apart by their texts from then on, all others by the hash alone.

The choice of the row that stays moves no texts. A row has a number made of the scan task
that stored it and its place there; first the best row of each (group, task) is taken, then
the best of each group, and the result goes back over (group, task), so that no key holds
more rows than one scan task had.

Defined results: a null text counts as empty, and all texts without any character but white
space are equal; of equal texts the row with the most code points stays, then the smallest
id, then the first stored; a null id is larger than any other and may stay only where no
row of the same length has an id; of rows that repeat id and text exactly one stays; an
empty table gives no rows; further columns are ignored unless named in ``more``, which must
not hold names of the columns that are added here (put them into one struct).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.settle import discard, settle
from . import bitmap

SPACES = " \t\n\x0b\x0c\r"
PART_BITS = 33  # of a row number, below the number of its scan task


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def content_hash(text: Column) -> Column:
    """128 bits of the text."""
    return F.unhex(F.md5(text.cast("binary")))


def collisions(texts: DataFrame) -> DataFrame:
    """The hashes of (hash, text) that stand for more than one text, found on whole texts."""
    often = settle(texts.groupBy("hash").count().where("count > 1").select("hash"))
    distinct = bitmap.among(texts, "hash", often, "hash").groupBy("hash", "text").agg(F.lit(1).alias("one"))
    found = settle(distinct.groupBy("hash").count().where("count > 1").select("hash"))
    discard(often)
    return found


def groups(documents: DataFrame, *more: str, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Rows (doc_id, more columns, n_chars, text_sha256, keep_id, group_size, kept), one for
    every row of ``documents``."""
    text = normalised(F.col("text"))
    texts = documents.select(hashed(text).alias("hash"), text.alias("text"))
    clashes = collisions(texts)
    prepared = documents.select(
        "doc_id", *more, F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), text.alias("text"), hashed(text).alias("hash"),
    )
    # Where the filter lets a foreign hash pass, its rows are told apart by their equal texts too.
    told = bitmap.marked(prepared, "hash", clashes, "hash").withColumn("content", F.when(F.col("maybe"), F.col("text")).otherwise(F.lit("")))
    rows = settle(told.select(
        "doc_id", *more, "n_chars", "hash", "content", F.sha2("text", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row"),
    )).withColumn("part", F.shiftright("row", PART_BITS))
    rank = F.struct((-F.col("n_chars")).alias("shortness"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    of_part = rows.groupBy("hash", "content", "part").agg(F.min(rank).alias("best"), F.count("*").alias("n"))
    of_all = of_part.groupBy("hash", "content").agg(F.min("best").alias("winner"), F.sum("n").alias("group_size")).where("group_size > 1")
    shared = of_part.select("hash", "content", "part").join(of_all, ["hash", "content"])
    out = rows.join(shared, ["hash", "content", "part"], "left").select(
        "doc_id", *more, "n_chars", "text_sha256",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("winner.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("winner.row") == F.col("row"), F.lit(True)).alias("kept"),
    )
    discard(clashes)
    return out
