"""Registered queries: academic graph, overlay, review, knowledge build."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import academic as ac
from ..operators import graph as gr
from ..operators import knowledge as kn
from ..operators import overlay as ov
from ..operators import review as rv
from ..sources import standin as src
from .pipeline import stage
from .queries_structure import edges, scores, tree, validation

r9 = lambda df, *names: df.withColumns({n: F.round(n, 9) for n in names})


def anchored(s, d):
    return stage(s, d, "anchored", lambda: ac.anchors(ac.annotations(tree(s, d))))


def nodes(s, d):
    return stage(s, d, "ac_nodes", lambda: ac.nodes(anchored(s, d)))


def links(s, d):
    return stage(s, d, "ac_edges", lambda: ac.contains_edges(anchored(s, d)))


def ovr(s, d, moves=False):
    return stage(s, d, f"overrides_{moves}", lambda: src.overrides(s, d, nodes(s, d), moves))


def _reviewed(s, d):
    """Documents that have corrections, with their pipeline status."""
    return ovr(s, d).select("doc_id").distinct().withColumn(
        "status", F.expr("IF(doc_id % 10 = 9, 'needs_ocr', 'processed')"))


def graph(s, d):
    docs = _reviewed(s, d).select("doc_id")
    return nodes(s, d).join(docs, "doc_id", "left_semi"), links(s, d).join(docs, "doc_id", "left_semi")


def status(s, d, moves=False):
    def build():
        n, e = graph(s, d)
        return ov.override_status(n, e, ovr(s, d, moves))
    return stage(s, d, f"override_status_{moves}", build)


def resolved(s, d, moves=False):
    n, e = graph(s, d)
    st = status(s, d, moves)
    all_nodes = ov.resolved_nodes(n, st)
    kept, es = ov.drop_rejected(all_nodes, ov.resolved_edges(e, st))
    return stage(s, d, f"resolved_nodes_{moves}", lambda: kept), stage(s, d, f"resolved_edges_{moves}", lambda: es)


def summary(s, d):
    def build():
        n, e = graph(s, d)
        rn, re_ = resolved(s, d)
        return ov.overlay_summary(n, e, status(s, d), rn, re_, _reviewed(s, d))
    return stage(s, d, "overlay_summary", build)


def readiness(s, d):
    rn, re_ = resolved(s, d)
    return rv.readiness_checks(rn, re_, summary(s, d), _reviewed(s, d))


def replayed(s, d, moves=False):
    acts = ovr(s, d, moves).withColumn("ord", F.struct("created_at", "override_id"))
    return stage(s, d, f"replayed_{moves}", lambda: rv.replay_actions(acts))


def academic_quality(s, d):
    pages = tree(s, d).groupBy("doc_id").agg(F.max("page_number").alias("page_count"))
    return ac.academic_quality(nodes(s, d), links(s, d), pages)


def report(s, d):
    t = tree(s, d)
    aq = stage(s, d, "academic_quality", lambda: academic_quality(s, d))
    return ac.pipeline_report(t, edges(s, d), anchored(s, d), validation(s, d), scores(s, d), aq)


def academic_features(s, d):
    return ac.features(tree(s, d)).select(
        "doc_id", "block_id", "heading_depth", "typography_scale", "indentation_level", "enclosing_section_title",
        "has_math", F.array_join("indicators", ",").alias("indicators"))


def cycles(s, d):
    """Every supplier's parts, pointing a little ahead and now and then back: cycles, and edges between them."""
    e = src.table(s, d, "lineitem").selectExpr(
        "l_suppkey AS doc_id", "l_partkey % 97 AS source_node_id",
        "l_partkey % 97 + IF(l_orderkey % 19 = 0, -(l_orderkey % 7), 1 + l_orderkey % 13) AS target_node_id")
    return gr.cyclic_documents(e)


def audit(s, d):
    return stage(s, d, "audit_rows", lambda: rv.audit_rows(replayed(s, d, True), *graph(s, d)))


def details(s, d):
    return stage(s, d, "node_details", lambda: rv.node_details(graph(s, d)[0], *resolved(s, d, True), status(s, d, True)))


def snapshots(s, d):
    """Two earlier approvals of every third reviewed document."""
    base = summary(s, d).where("doc_id % 3 = 0").select("doc_id", "resolved_graph_fingerprint")
    return base.select(
        "doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("approval_version"), "resolved_graph_fingerprint",
    ).withColumn("snapshot_id", F.expr("concat('s', doc_id, '_', approval_version)"))


def headers(s, d):
    return rv.new_snapshots(_reviewed(s, d), summary(s, d), snapshots(s, d), rv.revisions(replayed(s, d)))


def next_snapshots(s, d):
    return headers(s, d).drop("snapshot_id")


def invalidation(s, d):
    approved = _reviewed(s, d).withColumn("review_state", F.lit("APPROVED"))
    return rv.rerun_invalidation(approved, snapshots(s, d), summary(s, d), resolved(s, d)[0])


def versions(s, d):
    n = resolved(s, d)[0].withColumn("version_id", F.expr("concat('v', doc_id)"))
    return n, resolved(s, d)[1].withColumn("version_id", F.expr("concat('v', doc_id)"))


def entities(s, d):
    return kn.entities(versions(s, d)[0])


def kn_candidates(s, d):
    docs = _reviewed(s, d).withColumn("review_state", F.expr("IF(doc_id % 2 = 0, 'APPROVED', 'NEEDS_REVIEW')"))
    done = snapshots(s, d).where("doc_id % 12 = 0 AND approval_version = 1").withColumn("status", F.lit("FINALIZED"))
    return kn.candidates(snapshots(s, d), docs, done).select("doc_id", "approval_version", "snapshot_id")


QUERIES = {
    "academic_features": academic_features,
    "academic_annotations": lambda s, d: anchored(s, d).select(
        "doc_id", "block_id", "academic_type", "ann_confidence", "provenance"),
    "anchor_keys": lambda s, d: anchored(s, d).select("doc_id", "block_id", "academic_type", "section_path", "ordinal", "anchor_key"),
    "anchor_collisions": lambda s, d: ac.anchor_collisions(anchored(s, d).withColumn("anchor_key", F.col("section_path"))),
    "academic_nodes": lambda s, d: nodes(s, d).drop("ann_ord", "seq", "page_number"),
    "academic_edges": lambda s, d: links(s, d).drop("ann_ord", "seq"),
    "academic_quality": lambda s, d: r9(academic_quality(s, d), "coverage", "orphan_ratio", "density", "academic_score"),
    "academic_warnings": lambda s, d: ac.academic_notes(academic_quality(s, d)),
    "document_report": lambda s, d: r9(report(s, d).drop("overall_quality", "academic_score", "consistency_score"), "average_confidence"),
    "graph_fingerprint": lambda s, d: ac.graph_fingerprint(nodes(s, d), links(s, d)),
    "containment_cycles": cycles,
    "override_conflicts": lambda s, d: ov.conflict_groups(ov.active_overrides(ovr(s, d))),
    "override_status": lambda s, d: status(s, d).select("doc_id", "override_id", "outcome", "error", "node_id"),
    "overlay_nodes": lambda s, d: resolved(s, d)[0].select(
        "doc_id", "node_id", "category", "title", "anchor_key", "review_state", "original_category", "original_title", "override_count"),
    "overlay_edges": lambda s, d: resolved(s, d)[1].select(
        "doc_id", "source_node_id", "target_node_id", "edge_type", "confidence"),
    "overlay_status": lambda s, d: summary(s, d).drop("base_graph_fingerprint"),
    "overlay_reparent": lambda s, d: status(s, d, True).where("action_type = 'REPARENT_NODE'").select(
        "doc_id", "override_id", "outcome", "error", "node_id", "new_parent"),
    "overlay_reparent_edges": lambda s, d: resolved(s, d, True)[1].select(
        "doc_id", "source_node_id", "target_node_id", "edge_type", "confidence"),
    "action_replay": lambda s, d: replayed(s, d).select("doc_id", "override_id", "accepted", "new_version"),
    "audit_page": lambda s, d: rv.page_of(audit(s, d), ["ord"], 1, 5).select(
        "doc_id", "position", "action_type", "node_id", "previous_state", "new_state"),
    "reconciliation": lambda s, d: ov.reconciliation(status(s, d)),
    "readiness": readiness,
    "review_summary": lambda s, d: rv.review_summary(graph(s, d)[0], resolved(s, d)[0], summary(s, d), readiness(s, d)),
    "resolved_graph_page": lambda s, d: rv.resolved_graph_page(*resolved(s, d), orphan=False, offset=1, limit=3)[0].select(
        "doc_id", "position", "node_id", "category"),
    "resolved_graph_page_edges": lambda s, d: rv.resolved_graph_page(*resolved(s, d), orphan=False, offset=1, limit=3)[1].select(
        "doc_id", "source_node_id", "target_node_id", "edge_type"),
    "resolved_graph_filtered": lambda s, d: rv.resolved_graph_page(
        *resolved(s, d), review_state="UNREVIEWED", low_confidence=False, offset=0, limit=2)[0].select("doc_id", "position", "node_id", "total_count"),
    "snapshot_nodes": lambda s, d: rv.snapshot_items(headers(s, d), *resolved(s, d))[0].select("snapshot_id", "approval_version", "node_id", "category", "title"),
    "snapshot_edges": lambda s, d: rv.snapshot_items(headers(s, d), *resolved(s, d))[1].select(
        "snapshot_id", "approval_version", "source_node_id", "target_node_id", "edge_type"),
    "snapshot_by_version": lambda s, d: rv.snapshot_at(snapshots(s, d), "v1"),
    "finalized_rows": lambda s, d: kn.finalized(
        kn_candidates(s, d).withColumn("version_id", F.concat(F.lit("v"), "snapshot_id"))).drop("doc_id"),
    "audit_rows": lambda s, d: audit(s, d).select("doc_id", "override_id", "action_type", "node_id", "previous_state", "new_state"),
    "node_detail": lambda s, d: details(s, d).select(
        "doc_id", "node_id", "category", "title", "review_state", "parent_id", "child_count", "original_category", "original_title",
        "override_count", "deleted"),
    "node_original_parents": lambda s, d: rv.original_parents(graph(s, d)[1], status(s, d, True)),
    "node_overrides": lambda s, d: rv.node_overrides(resolved(s, d, True)[0], status(s, d, True)).drop("action_type"),
    "node_audit": lambda s, d: rv.node_audit(details(s, d), audit(s, d)).select("doc_id", "node_id", "position", "override_id", "previous_state"),
    "next_snapshots": next_snapshots,
    "latest_snapshots": lambda s, d: rv.snapshot_at(snapshots(s, d)),
    "rerun_invalidation": invalidation,
    "new_base_graphs": lambda s, d: rv.new_base_graphs(
        src.table(s, d, "documents").selectExpr("doc_id", "n_chars AS extraction_timestamp"),
        src.table(s, d, "documents").selectExpr("doc_id", "n_chars + IF(doc_id % 7 = 0, 1, 0) AS extraction_timestamp")),
    "kn_candidates": kn_candidates,
    "kn_entities": lambda s, d: entities(s, d).select("version_id", "node_id", "entity_type", "title", "content", "stable_id"),
    "kn_evidence": lambda s, d: kn.evidence(entities(s, d), tree(s, d).where("seq % 35 <> 0")).select(
        "version_id", "source_node_id", "source_anchor_key", "page_number", "section_title", "text_reference", "provenance",
        "x0", "y0", "x1", "y1"),
    "kn_relationships": lambda s, d: kn.relationships(versions(s, d)[1].withColumn("metadata", F.expr(
        "CASE WHEN edge_type <> 'CONTAINS' THEN '{\"is_human_confirmed\":true,\"by\":{\"is_inferred\":true}}' WHEN doc_id % 2 = 0 THEN '{\"is_inferred\":true}' END"
    )), entities(s, d)).select("version_id", "relationship_type", "confidence", "is_inferred", "is_human_confirmed"),
}
