"""Catalog reads: document statistics, lists, counts and look-ups over stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def document_statistics(blocks: DataFrame, pages: DataFrame, images: DataFrame | None = None,
                        tables: DataFrame | None = None) -> DataFrame:
    """Pages, words, images, tables, headings, paragraphs and lists per document."""
    b = blocks.groupBy("doc_id").agg(
        F.sum(F.expr(f"size({tx.sql_words('text')})")).alias("word_count"),
        *[F.expr(f"count_if(block_type = '{t}')").alias(n)
          for t, n in (("HEADING", "headings_count"), ("PARAGRAPH", "paragraphs_count"), ("LIST", "lists_count"))],
    )
    df = pages.groupBy("doc_id").agg(F.count("*").alias("page_count")).join(b, "doc_id", "left")
    for side, name in ((images, "images_count"), (tables, "tables_count")):
        if side is None:
            df = df.withColumn(name, F.lit(0).cast("long"))
        else:
            df = df.join(side.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left")
    return df.fillna(0)


def document_detail(documents: DataFrame, metadata: DataFrame) -> DataFrame:
    return documents.join(metadata, "doc_id", "left")


def pages_of(pages: DataFrame, doc_id) -> DataFrame:
    return pages.where(F.col("doc_id") == doc_id).orderBy("page_number")


def blocks_of(blocks: DataFrame, doc_id, page_number: int | None = None) -> DataFrame:
    """Blocks of a document, or of one page of it, in reading order."""
    df = blocks.where(F.col("doc_id") == doc_id)
    if page_number is not None:
        df = df.where(F.col("page_number") == page_number)
    return df.orderBy("page_number", "reading_order")


def finalized_versions(versions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Finalized versions with their approval version; ``position`` 1 is the latest of the upload."""
    w = Window.partitionBy("upload_id").orderBy(F.desc("approval_version"))
    return versions.where("status = 'FINALIZED'").join(
        snapshots.select("snapshot_id", "approval_version"), "snapshot_id"
    ).withColumn("position", F.row_number().over(w))


def latest_versions(versions: DataFrame, snapshots: DataFrame) -> DataFrame:
    return finalized_versions(versions, snapshots).where("position = 1")


def version_counts(versions: DataFrame, entities: DataFrame, relationships: DataFrame, evidence: DataFrame) -> DataFrame:
    ev = evidence.select("entity_id").join(entities.select("entity_id", "version_id"), "entity_id")
    df = versions.select("version_id")
    for side, name in ((entities, "entity_count"), (relationships, "relationship_count"), (ev, "evidence_count")):
        df = df.join(side.groupBy("version_id").agg(F.count("*").alias(name)), "version_id", "left")
    return df.fillna(0)


def _filters(df: DataFrame, **equal) -> DataFrame:
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def list_page(df: DataFrame, order: list[Column | str], offset: int = 0, limit: int = 100, **equal) -> DataFrame:
    """One page of a filtered list; ``limit`` is bounded as in the list calls."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    return _filters(df, **equal).orderBy(*order).offset(offset).limit(limit)


def list_entities(entities: DataFrame, version_id: str, entity_type=None, stable_id=None, offset=0, limit=100) -> DataFrame:
    return list_page(entities, ["title", "entity_id"], offset, limit, version_id=version_id, entity_type=entity_type,
                     stable_id=stable_id)


def list_relationships(rels: DataFrame, version_id: str, source=None, target=None, kind=None, offset=0, limit=100) -> DataFrame:
    return list_page(rels, ["source_entity_id", "target_entity_id", "relationship_type"], offset, limit,
                     version_id=version_id, source_entity_id=source, target_entity_id=target, relationship_type=kind)


def counts(df: DataFrame, **equal) -> DataFrame:
    return _filters(df, **equal).groupBy(*[k for k in equal]).agg(F.count("*").alias("n"))


def evidence_of_entity(evidence: DataFrame, entity_id) -> DataFrame:
    return evidence.where(F.col("entity_id") == entity_id).orderBy(F.asc_nulls_first("page_number"), "evidence_id")


def neighbors(rels: DataFrame) -> DataFrame:
    """Incoming and outgoing relationships of every entity as rows."""
    return rels.select(
        "version_id", "relationship_type", "confidence",
        F.expr(
            "inline(array(named_struct('entity_id', source_entity_id, 'other_id', target_entity_id, 'direction', 'outgoing'), "
            "named_struct('entity_id', target_entity_id, 'other_id', source_entity_id, 'direction', 'incoming')))"
        ),
    )


def search_nodes(nodes: DataFrame, term: str) -> DataFrame:
    needle = F.lit(term.lower())
    return nodes.where(F.contains(F.lower("title"), needle) | F.contains(F.lower("category"), needle))


def layer(blocks: DataFrame, name: str) -> DataFrame:
    """Blocks of the native or the OCR layer; merged blocks belong to both."""
    return blocks.where(F.col("provenance").isin(name, "MERGED"))


def blocks_per_page(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id", "page_number").agg(F.count("*").alias("n"))
