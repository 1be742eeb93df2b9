r"""Homomorphic multiset hash of a document's paragraphs.

Every paragraph (a line) has a wide vector; a fingerprint is the sum of the vectors of all
paragraphs, lane by lane, modulo 2^32. Order does not matter, and a paragraph is
inserted or deleted by adding or subtracting its vector (:func:`combined`). The lanes:

* 16 lanes: the words of the paragraph's SHA-512. Equal sums mean equal
  multisets of paragraphs (up to collisions).
* 64 lanes: how many clauses of the paragraph have bit i set in their 64-bit
  hash, and one lane with the number of clauses. Differences of these lanes estimate how
  many clauses differ (:func:`likeness`), which equality lanes cannot tell. A text of Spark
  has less than 2^31 bytes and so fewer clauses; only sums of several texts can wrap.

Defined results: a null text counts as empty, one empty paragraph without clauses; two texts
without clauses are alike (1.0) if their fingerprints are equal, else 0.0; repeated rows
are separate rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bitmap

EQUALITY, LIKENESS = 16, 64
CLAUSE = r"\n|(?<=[.!?;:,])"
# A chunk has 2^9 ids, a group of chunks 2^19; three rounds of groups use up all bits of an id.
CHUNK_BITS, GROUP_BITS, ROUNDS = 9, 19, 3
_NO_ID = -(2**54) - 1  # below the chunk of every id
_LANES = EQUALITY + LIKENESS + 1
_MODULUS = 2**32


def pieces(text: Column) -> Column:
    """The paragraphs (kind 0) and non-blank clauses (kind 1) of a text, in one array."""
    tagged = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("piece"))
    clauses = F.filter(F.split(text, CLAUSE, -1), lambda s: F.length(F.trim(s)) > 0)
    return F.concat(F.transform(F.split(text, "\n", -1), tagged(0)), F.transform(clauses, tagged(1)))


def lane_sums(digest: str = "digest", bits: str = "bits") -> list[Column]:
    """Aggregates over exploded pieces: a SHA-512 in hex or a 64-bit hash each, else null."""
    words = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(EQUALITY)]
    ones = [F.shiftrightunsigned(bits, i).bitwiseAND(F.lit(1)) for i in range(LIKENESS)]
    sums = [F.sum(w) for w in words] + [F.sum(o) for o in ones] + [F.count(bits)]
    return [F.pmod(F.coalesce(s, F.lit(0)), F.lit(_MODULUS)).alias(f"lane_{i}") for i, s in enumerate(sums)]


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Insert (sign 1) or delete (sign -1) the paragraphs of ``b``."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(_MODULUS)))


def text_form(lanes: Column) -> Column:
    """Lanes in hex, eight digits each."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of the clause multisets. A lane difference, as a sum of
    signs, has the number of differing clauses as its mean square."""
    count = lambda x: F.get(x, F.lit(_LANES - 1)).cast("double")
    lanes = lambda x: F.slice(x, EQUALITY + 1, LIKENESS)
    centred = lambda x: F.pmod(x + _MODULUS // 2, F.lit(_MODULUS)) - _MODULUS // 2
    shift = centred(F.get(a, F.lit(_LANES - 1)) - F.get(b, F.lit(_LANES - 1)))
    squares = F.zip_with(lanes(a), lanes(b), lambda x, y: F.pow(2 * centred(x - y) - shift, F.lit(2)))
    differing = F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / LIKENESS
    both = count(a) + count(b)
    return (
        F.when(a == b, 1.0).when(both == 0, 0.0)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (both - differing) / (both + differing))))
    )


def _chunk(doc_id: Column) -> Column:
    return F.coalesce(F.shiftright(doc_id.cast("long"), CHUNK_BITS), F.lit(_NO_ID))


def _above(chunks: DataFrame) -> DataFrame:
    """Rows (chunk, above) of distinct chunks: the next higher one; for the highest the lowest.

    Chunks that share all but their last ``GROUP_BITS`` bits are compared with each other, then
    the lowest and highest of such groups in the same way. So no task holds more than 2^``GROUP_BITS``
    narrow rows of a group, also where ids are so sparse that every document is a chunk of its own.
    """
    level, found = chunks.select(F.col("chunk").alias("at"), F.col("chunk").alias("low"), F.col("chunk").alias("high")), []
    for _ in range(ROUNDS):
        level = level.withColumn("group", F.shiftright("at", GROUP_BITS))
        w = Window.partitionBy("group").orderBy("at")
        found.append(level.select(F.col("high").alias("chunk"), F.lead("low").over(w).alias("above")).where("above IS NOT NULL"))
        level = level.groupBy("group").agg(F.min("low").alias("low"), F.max("high").alias("high")).withColumnRenamed("group", "at")
    # Two rows at most are left: the ids below zero and the others.
    w = Window.orderBy("at")
    out = level.select(F.col("high").alias("chunk"), F.coalesce(F.lead("low").over(w), F.first("low").over(w)).alias("above"))
    for steps in found:
        out = out.unionByName(steps)
    return out


def _with_next(documents: DataFrame) -> DataFrame:
    """Each document with the text of the next smaller id (after the smallest: the largest).

    Ids are cut into chunks of 2^``CHUNK_BITS``; the largest id of a chunk is copied into the
    next higher chunk (that of the highest into the lowest), so a window never spans more.
    """
    docs = documents.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), _chunk(F.col("doc_id")).alias("chunk"))
    largest = documents.select("doc_id", _chunk(F.col("doc_id")).alias("chunk")).groupBy("chunk").agg(F.max("doc_id").alias("top"))
    tops = largest.join(_above(largest), "chunk").select(F.col("chunk").alias("top_chunk"), "top", "above")
    # Only rows that may be a top move for the copies; the exact join decides.
    maybe = bitmap.among(docs, "doc_id", tops, "top")
    copies = maybe.join(tops, (maybe.chunk == tops.top_chunk) & maybe.doc_id.eqNullSafe(tops.top)).select("doc_id", "text", F.col("above").alias("chunk"))
    spread = docs.withColumn("edge", F.lit(0)).unionByName(copies.withColumn("edge", F.lit(1)))
    w = Window.partitionBy("chunk").orderBy("edge", F.col("doc_id").desc_nulls_last(), F.desc("text"))
    return spread.select("*", F.lead("text").over(w).alias("next_text"), F.row_number().over(w).alias("place"))


def fingerprints(documents: DataFrame) -> DataFrame:
    """Documents (doc_id, text) with the fingerprints of text, edited text and next document."""
    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = _with_next(documents).withColumn("edited", F.coalesce(edited, F.lit("")))
    keys = ["chunk", "place", "edge", "doc_id", "n_chars", "edited_sha256", "version"]
    versions = F.explode(F.when(F.col("edge") == 1, F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("body")))).otherwise(
        F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("body")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("body")))))
    exploded = (
        rows.select("chunk", "place", "edge", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), versions.alias("v"))
        .select(*keys[:-1], "v.version", F.explode(pieces(F.col("v.body"))).alias("p"))
        .select(
            *keys, F.when(F.col("p.kind") == 0, F.sha2(F.col("p.piece"), 512)).alias("digest"),
            F.when(F.col("p.kind") == 1, F.xxhash64(F.trim("p.piece"))).alias("bits"),
        )
    )
    lanes = [f"lane_{i}" for i in range(_LANES)]
    summed = exploded.groupBy(*keys).agg(*lane_sums()).select(*keys, F.array(*lanes).alias("lanes"))
    w = Window.partitionBy("chunk").orderBy("place", "version")
    return (
        summed.select("*", F.lead("lanes", 1).over(w).alias("edited_lanes"), F.lead("lanes", 2).over(w).alias("next_lanes"))
        .where("version = 0 AND edge = 0").select("doc_id", "n_chars", "edited_sha256", "lanes", "edited_lanes", "next_lanes")
    )
