"""Corpus pipeline: documents in, packed training sequences out.

Each stage works on all rows that its predecessor kept and returns the columns of
documents, the last one its sequences. ``run`` writes every stage to the shared folder and
reads it again, so a lost executor costs at most the stage at hand.

1. toxicity: documents that score as toxic go (model fitted on ``labels``).
2. ngram_join: of each group of near duplicates the document with the smallest id stays.
3. substring_dedup: passages that an earlier document holds are cut from texts.
4. privacy: personal data and terms that disclose it are masked.
5. packing: documents are packed into sequences of several lengths; a row is a piece with its text.

Texts that no stage changes stay as they are. A null text stays null where nothing is to be
changed or becomes empty; rows that repeat an id and a text count once after stage 2; empty
tables stay empty; further columns are carried through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import bitmap, ngram_join, packing, privacy, substring_dedup, toxicity
from quirework.operators.settle import discard, settle


def carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, so that no name can clash."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.lit(None).cast("string").alias("no_other")).alias("others"))


def restored(rows: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` again; ``n_chars`` follows the text."""
    def column(c: str):
        if c in ("doc_id", "text"):
            return F.col("doc_id" if c == "doc_id" else text).alias(c)
        if c == "n_chars":
            return F.length(text).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"others.`{c}`").alias(c)

    return rows.select(*[column(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = toxicity.score(carried(docs), model).where(F.col("score") < toxicity.THRESHOLD)
    return restored(kept, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = ngram_join.join(docs.select("doc_id", "text")).groupBy("doc_id").agg(
        F.min("component_id").alias("component_id"), F.count("*").alias("n")
    )
    odd = settle(classes.where("component_id <> doc_id OR n > 1"))
    rows = bitmap.marked(carried(docs), "doc_id", odd, "doc_id")
    unsure = rows.where("maybe").join(odd.where("component_id <> doc_id").select("doc_id"), "doc_id", "left_anti")
    return restored(rows.where("not maybe").unionByName(unsure.dropDuplicates(["doc_id", "text"])), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return restored(substring_dedup.remove_repeats(carried(docs), "others", spaced=True), docs, "kept")


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = privacy.find(carried(docs), "others")
    masked = privacy.sanitised(F.col("text"), F.col("base"), F.col("terms"), F.col("told"))
    return restored(found.select("doc_id", "others", masked.alias("text")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.sequences(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("privacy", mask_private),
    ("packing", pack),
]

#: The toxicity model is fitted and the packing is sequential: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, settle(stage(spark, docs, sf_dir))
        discard(before)
    return docs


QUERIES = {"pipeline": run}
