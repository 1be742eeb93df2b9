"""Registered queries: the way from documents to prompts in one chain.

Text lines are classified, ordered and nested, academic nodes are corrected by overrides and
compiled into one knowledge version per document; requests name a document and maybe a
version, are checked, resolved to a version, and searched in that version only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as ct
from ..operators import checks as ck
from ..operators import context as cx
from ..operators import knowledge as kn
from ..operators import search as se
from ..sources import standin as src
from .pipeline import stage
from .queries_review import entities as compiled
from .queries_review import snapshots
from .queries_review import versions as compiled_graph
from .queries_search import image_rects, tables_
from .queries_structure import tree


def documents(s, d):
    return src.table(s, d, "documents").selectExpr("doc_id AS document_id", "concat('u', doc_id) AS upload_id")


def versions(s, d):
    """One version per document; those of every fifth document are not finished."""
    return src.table(s, d, "documents").selectExpr(
        "concat('v', doc_id) AS version_id", "concat('u', doc_id) AS upload_id", "1 AS approval_version",
        "IF(doc_id % 5 = 0, 'BUILDING', 'FINALIZED') AS status")


def requests(s, d):
    """One request per document: odd ones name their version, some a foreign one, some ask too much."""
    return src.table(s, d, "documents").selectExpr(
        "doc_id AS query_id", "doc_id AS document_id", "' Title THE Definition-'||(doc_id % 10) AS query",
        "CASE WHEN doc_id % 11 = 0 THEN concat('v', doc_id + 1) WHEN doc_id % 2 = 1 THEN concat('v', doc_id) END AS version_id",
        "IF(doc_id % 17 = 0, 500, 5) AS top_k", "IF(doc_id % 3 = 0, 3, 1) AS depth", "CAST(NULL AS array<string>) AS entity_types",
        "IF(doc_id % 4 = 0, array('CONTAINS'), NULL) AS relationship_types", "'LEXICAL' AS strategy")


def scoped(s, d):
    """Accepted requests with the version they search."""
    def build():
        found = se.resolve_scope(se.accepted(requests(s, d)), documents(s, d), versions(s, d)).where("scope_error IS NULL")
        return se.normalize_queries(found.withColumn("version_id", F.col("resolved_version_id")).drop("resolved_version_id", "scope_error"))
    return stage(s, d, "chain_requests", build)


def entities(s, d):
    """Knowledge entities, one per version and stable id; the smallest node stands for doubles."""
    def build():
        rest = ["doc_id", "node_id", "entity_type", "title", "content", "stable_id", "target_block_id", "provenance"]
        one = compiled(s, d).groupBy("version_id", "entity_id").agg(F.min_by(F.struct(*rest), "node_id").alias("e"))
        return one.select("version_id", "entity_id", "e.*")
    return stage(s, d, "chain_entities", build)


def relationships(s, d):
    return stage(s, d, "chain_relationships", lambda: kn.relationships(compiled_graph(s, d)[1], entities(s, d)))


def evidence(s, d):
    return stage(s, d, "chain_evidence", lambda: kn.evidence(entities(s, d), tree(s, d)).withColumnRenamed("doc_id", "document_id"))


def hits(s, d):
    return stage(s, d, "chain_hits", lambda: se.lexical_match(scoped(s, d), entities(s, d)))


def found(s, d):
    c, r = se.expand(scoped(s, d), hits(s, d), entities(s, d), relationships(s, d))
    c = stage(s, d, "chain_candidates", lambda: c)
    ev = se.evidence_of(c, evidence(s, d).drop("version_id"))
    ps = stage(s, d, "chain_passages", lambda: se.passages(ev, se.locate(evidence(s, d), tree(s, d)), tree(s, d)))
    return c, stage(s, d, "chain_rels", lambda: r), ev, ps


def ranked(s, d):
    def build():
        c, r, ev, ps = found(s, d)
        return se.rank(se.score(scoped(s, d), c, r, ev, ps, entities(s, d)), se.largest_top_k(scoped(s, d)))
    return stage(s, d, "chain_ranked", build)


def sources(s, d):
    return stage(s, d, "chain_sources", lambda: cx.pack_context(ranked(s, d), found(s, d)[3]))


def constraints(s, d):
    """Keys, references and value rules of the knowledge tables; some parents are left out to be missed."""
    out = ck.duplicates(compiled(s, d), ["version_id", "stable_id"], "entity_unique")
    parts = [
        ck.duplicates(relationships(s, d), ["version_id", "source_entity_id", "target_entity_id", "relationship_type"], "relationship_unique"),
        ck.duplicates(snapshots(s, d), ["snapshot_id"], "snapshot_unique"),
        ck.duplicates(snapshots(s, d), ["doc_id", "approval_version"], "approval_unique"),
        ck.missing(evidence(s, d), entities(s, d).where("entity_type <> 'EXAMPLE'"), {"entity_id": "entity_id"}, "evidence_entity"),
        ck.missing(tree(s, d), src.pages(s, d).where("page_number % 7 <> 0"), {"doc_id": "doc_id", "page_number": "page_number"}, "block_page"),
        ck.violations(entities(s, d).withColumn("title", F.expr("IF(length(title) > 42, repeat(title, 9), title)")), "node_id", ck.ENTITY_RULES),
    ]
    for p in parts:
        out = out.unionByName(p)
    return out


QUERIES = {
    "knowledge_constraints": constraints,
    "classified_statistics": lambda s, d: ct.document_statistics(tree(s, d), src.pages(s, d), image_rects(s, d), tables_(s, d)),
    "chain_scope": lambda s, d: scoped(s, d).select("query_id", "version_id"),
    "search_on_knowledge": lambda s, d: hits(s, d).select("query_id", "version_id", "entity_id", "match_reason"),
    "scoped_search": lambda s, d: ranked(s, d).select(
        "query_id", "rank", "version_id", "entity_id", "hop", F.round("total_score", 9).alias("total_score"), "total_candidates"),
    "chain_context": lambda s, d: sources(s, d).select("query_id", "citation_id", "entity_id", "block_id", "provenance"),
    "chain_prompts": lambda s, d: cx.prompts(scoped(s, d), sources(s, d)),
}
