"""Registered queries: search, context, catalog, jobs, checks, OCR tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as asm
from ..operators import catalog as ct
from ..operators import checks as ck
from ..operators import context as cx
from ..operators import jobs as jb
from ..operators import ocr
from ..operators import search as se
from ..sources import files as fl
from ..sources import standin as src
from ..operators.settle import new_path
from .pipeline import stage
from .queries_review import nodes

r9 = lambda df, *names: df.withColumns({n: F.round(n, 9) for n in names})


def ent(s, d):
    return src.entities(s, d)


def rel(s, d):
    return stage(s, d, "relationships", lambda: src.relationships(s, d))


def qry(s, d):
    return stage(s, d, "requests", lambda: se.with_options(se.normalize_queries(se.accepted(src.search_requests(s, d)))))


def hits(s, d):
    return stage(s, d, "lexical_hits", lambda: se.lexical_match(qry(s, d), ent(s, d)))


def expanded(s, d):
    def cands():
        c, r = se.expand(qry(s, d), hits(s, d), ent(s, d), rel(s, d))
        stage(s, d, "rel_candidates", lambda: r)
        return c
    c = stage(s, d, "candidates", cands)
    return c, stage(s, d, "rel_candidates", lambda: se.expand(qry(s, d), hits(s, d), ent(s, d), rel(s, d))[1])


def evd(s, d):
    return src.evidence(s, d)


def located(s, d):
    return stage(s, d, "located", lambda: se.locate(evd(s, d), src.blocks(s, d)))


def found(s, d):
    c, _ = expanded(s, d)
    ev = se.wanted(se.evidence_of(c, evd(s, d).drop("version_id")), qry(s, d), "include_evidence")
    read = se.wanted(ev, qry(s, d), "include_passages")
    ps = stage(s, d, "passages", lambda: se.passages(read, located(s, d), src.blocks(s, d)))
    return ev, ps


def found_whole(s, d):
    """Evidence and passages of all candidates of every request, whatever its options leave out."""
    def cands():
        every = se.normalize_queries(se.accepted(src.search_requests(s, d)).drop(*se.OPTIONS))
        return se.expand(every, hits(s, d), ent(s, d), rel(s, d))[0]
    ev = se.evidence_of(stage(s, d, "whole_candidates", cands), evd(s, d).drop("version_id"))
    return ev, stage(s, d, "whole_passages", lambda: se.passages(ev, located(s, d), src.blocks(s, d)))


def search_provenance(s, d):
    """The versions of the parts, approved and built from a document each."""
    vs = ent(s, d).groupBy("version_id").agg((F.max("p_partkey") % 5 + 1).alias("approval_version"), F.min("p_partkey").alias("document_id"))
    out = se.provenance(qry(s, d), ranked(s, d), vs.where("approval_version <> 3"), ent(s, d))
    return out.withColumn("query_terms", F.array_join("query_terms", " "))


def scored(s, d):
    c, r = expanded(s, d)
    ev, ps = found(s, d)
    return se.score(qry(s, d), c, r, ev, ps, ent(s, d))


def ranked(s, d):
    return stage(s, d, "ranked", lambda: se.rank(scored(s, d), se.largest_top_k(qry(s, d))))


def packaged(s, d):
    return se.package_counts(ranked(s, d), expanded(s, d)[1], *found(s, d))


def package_rows(s, d, name, *columns):
    rows = se.package(ranked(s, d), expanded(s, d)[1], *found(s, d))[name]
    return rows.select("query_id", "rank", "entity_id", *columns)


def sources(s, d, limit=cx.MAX_CHARS):
    return stage(s, d, f"context_sources_{limit}", lambda: cx.pack_context(ranked(s, d), found(s, d)[1], limit))


def scope_queries(s, d):
    q = src.table(s, d, "part").selectExpr(
        "p_partkey AS query_id", "p_partkey % 30 AS document_id",
        "IF(p_partkey % 2 = 0, concat('s', p_partkey % 120), NULL) AS version_id")
    docs = src.table(s, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS document_id", "concat('u', n_nationkey % 9) AS upload_id")
    vers = src.table(s, d, "supplier").selectExpr(
        "concat('s', s_suppkey) AS version_id", "concat('u', s_suppkey % 7) AS upload_id",
        "IF(s_suppkey % 3 = 0, 'BUILDING', 'FINALIZED') AS status", "s_suppkey AS approval_version")
    return se.resolve_scope(q, docs, vers).select("query_id", "document_id", "scope_error", "resolved_version_id")


def requests(s, d):
    q = src.table(s, d, "part").selectExpr(
        "p_partkey AS query_id", "CASE p_partkey % 7 WHEN 0 THEN '  ' WHEN 1 THEN repeat('x', 3000) ELSE p_name END AS query",
        "CAST(p_partkey % 120 AS INT) AS top_k", "CAST(p_partkey % 5 AS INT) AS depth", "IF(p_partkey % 6 = 0, 'VECTOR', 'LEXICAL') AS strategy")
    return se.validate_requests(q).select("query_id", "reject_reason")


def norm_queries(s, d):
    return qry(s, d).select("query_id", "normalized", F.array_join("terms", ",").alias("terms"))


def versions(s, d):
    v = src.table(s, d, "supplier").selectExpr(
        "concat('v', s_suppkey) AS version_id", "concat('sn', s_suppkey) AS snapshot_id", "concat('u', s_nationkey) AS upload_id",
        "IF(s_suppkey % 3 = 0, 'BUILDING', 'FINALIZED') AS status")
    snaps = src.table(s, d, "supplier").selectExpr("concat('sn', s_suppkey) AS snapshot_id", "s_suppkey AS approval_version")
    return v, snaps


def version_counts(s, d):
    key = "concat('v', p_partkey % 20)"
    e = src.table(s, d, "part").selectExpr("p_partkey AS entity_id", f"{key} AS version_id")
    r = src.table(s, d, "lineitem").selectExpr("concat('v', l_partkey % 19) AS version_id")
    ev = src.table(s, d, "lineitem").selectExpr("l_partkey AS entity_id")
    return ct.version_counts(versions(s, d)[0], e, r, ev)


def violations(s, d):
    r = rel(s, d).withColumn("confidence", F.expr("confidence * 1.2D"))
    ev = evd(s, d).withColumn("x0", F.expr("IF(CAST(entity_id AS BIGINT) % 50 = 1, NULL, x0)"))
    dup = src.table(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber")
    out = ck.violations(ev, "evidence_id", ck.EVIDENCE_RULES)
    out = out.unionByName(ck.violations(r.withColumn("k", F.concat_ws(">", "source_entity_id", "target_entity_id")), "k", ck.RELATION_RULES))
    out = out.unionByName(ck.duplicates(dup, ["l_orderkey", "l_linenumber"], "unique_line"))
    few = ent(s, d).where("p_partkey % 10 <> 0")
    return out.unionByName(ck.missing(rel(s, d), few, {"target_entity_id": "entity_id"}, "target_exists"))


def immutability(s, d):
    now = ent(s, d).drop("p_partkey")
    later = ent(s, d).withColumn("title", F.expr("IF(p_partkey % 9 = 0, concat(title, '!'), title)")).where("p_partkey % 8 <> 0").drop("p_partkey")
    return ck.changed_rows(now, later, ["entity_id"])


def screened(s, d):
    return ocr.screen_pages(src.pages(s, d), src.blocks(s, d).where("page_number % 5 <> 0"), "AUTO", 400)


def ocr_layout(s, d):
    return stage(s, d, "ocr_layout", lambda: ocr.words_to_blocks(src.words(s, d), src.pages(s, d)))


def native(s, d):
    return src.two_column_blocks(s, d)


def recognised(s, d):
    """A second layer for the two-column blocks: boxes moved by five points, other confidences."""
    return src.two_column_blocks(s, d).withColumns({
        "block_id": F.expr("concat('o', block_id)"), "y0": F.expr("y0 + 5"), "y1": F.expr("y1 + 5"),
        "confidence": F.expr("1D - 0.1D * (length(text) % 7)"), "provenance": F.lit("OCR"),
        "reading_order": F.expr("reading_order + 1")})


def merged(s, d):
    return stage(s, d, "merged_layers", lambda: ocr.merge_layers(native(s, d), recognised(s, d)))


def page_conf(s, d):
    scr = src.pages(s, d).select("doc_id", "page_number", F.expr("page_number % 2 = 1 AS needs_ocr"))
    return ocr.page_confidence(merged(s, d), scr)


def spans(s, d):
    """Lines as one-line text boxes, cut into two spans with alternating fonts."""
    return src.blocks(s, d).selectExpr(
        "doc_id", "page_number", "reading_order AS block_ord", "x0 AS bx0", "y0 AS by0", "x1 AS bx1", "y1 AS by1",
        "inline(array(named_struct('line_ord', 0, 'span_ord', 0, 'text', left(text, 5), 'size', font_size, 'font', 'Times', 'flags', 0), "
        "named_struct('line_ord', 0, 'span_ord', 1, 'text', substring(text, 6), 'size', font_size + 1, 'font', "
        "IF(seq % 3 = 0, 'Arial-Bold', 'Times'), 'flags', IF(seq % 4 = 0, 2, 0)), "
        "named_struct('line_ord', 1, 'span_ord', 0, 'text', CAST(seq AS STRING), 'size', font_size, 'font', 'Arial-Bold', 'flags', 16 * CAST(seq % 2 AS INT))))")


def tables_(s, d):
    return src.pages(s, d).selectExpr("doc_id", "page_number", "45D AS x0", "100D AS y0", "400D AS x1", "200D AS y1")


def image_rects(s, d):
    return src.pages(s, d).selectExpr(
        "doc_id", "page_number", "inline(array(named_struct('image_ord', 0, 'x0', 50D, 'y0', 40D, 'x1', 300D, 'y1', 90D), "
        "named_struct('image_ord', 1, 'x0', 50D, 'y0', 40D, 'x1', 300D, 'y1', 90D), named_struct('image_ord', 2, 'x0', 50D, 'y0', 200D, 'x1', 90D, 'y1', 250D)))")


def captions(s, d):
    blk = src.blocks(s, d).withColumn("block_type", F.expr("IF(seq % 3 = 0, 'CAPTION', block_type)"))
    return asm.image_captions(asm.register_images(image_rects(s, d)), blk).select("doc_id", "page_number", "image_ord", "width", "height", "caption")


def page_work(s, d):
    pg = src.table(s, d, "pages").selectExpr("page_id", "CAST(html AS BINARY) AS content", "'Rect(0, 0, 595, 440)' AS rect")
    cache = fl.page_hash(pg.where("page_id % 3 = 0")).select("page_hash").distinct()
    return fl.page_work(pg, cache)[0].select("page_hash")


def stored_blocks(s, d):
    """Blocks and pages through their stored tables, page sizes attached on the way back."""
    at = new_path(s)
    fl.write_table(src.blocks(s, d).drop("page_width", "page_height"), f"{at}/blocks", buckets=16)
    fl.write_table(src.pages(s, d), f"{at}/pages", buckets=16)
    rows = fl.attach_pages(fl.read_table(s, f"{at}/blocks"), fl.read_table(s, f"{at}/pages"))
    return rows.select("doc_id", "block_id", "page_number", "page_width", "page_height")


def appended_labels(s, d):
    """Half of the labels, then all of them with repeats: each is stored once."""
    at, rows = new_path(s), src.table(s, d, "labels").select("doc_id", "quality")
    fl.append_only(rows.where("doc_id % 2 = 0"), None, at, ["doc_id"])
    fl.append_only(rows.unionByName(rows), s.read.parquet(at), at, ["doc_id"])
    return s.read.schema(rows.schema).parquet(at)


def uploads(s, d):
    f = src.table(s, d, "documents").selectExpr(
        "doc_id", "CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'a.txt' ELSE concat('F', doc_id, '.PDF') END AS file_name",
        "IF(doc_id % 10 = 3, 'text/plain', 'application/pdf') AS mime_type",
        "CAST(IF(doc_id % 4 = 2, text, concat('%PDF-', text)) AS BINARY) AS content",
        "IF(doc_id % 11 = 5, 0L, IF(doc_id % 13 = 6, 200000000L, CAST(n_chars AS BIGINT))) AS length")
    return fl.screen_uploads(f).select("doc_id", "accepted", "reject_reason")


def stored_json(s, rows, size):
    """``rows`` (with ``n``) as JSON files of one array each, ``size`` rows at most, and where they lie."""
    at, columns = new_path(s), [c for c in rows.columns if c != "n"]
    files = rows.groupBy((F.col("n") / size).cast("long").alias("part")).agg(F.to_json(F.collect_list(F.struct(*columns))).alias("value"))
    files.repartition("part").write.partitionBy("part").text(at)
    return at


def read_back_uploads(s, d):
    """Upload records through their JSON files."""
    up = src.table(s, d, "documents").selectExpr(
        "doc_id AS n", "concat('u', doc_id) AS upload_id", "concat(source, '.pdf') AS original_filename", "concat(doc_id, '_', lang) AS stored_filename",
        "n_chars AS size_bytes", "IF(doc_id % 10 = 3, NULL, 'application/pdf') AS mime_type", "'2024' AS uploaded_at", "IF(doc_id % 4 = 0, 'uploaded', 'processed') AS status")
    return fl.read_uploads(s, stored_json(s, up, 500)).drop("part")


def read_back_jobs(s, d):
    """The last states of jobs through their JSON files; those without an id or a state are no jobs."""
    jobs = jb.latest(src.job_events(s, d)).selectExpr(
        "job_id AS n", "IF(job_id % 7 = 0, NULL, CAST(job_id AS STRING)) AS job_id", "concat('u', job_id % 10) AS upload_id", "IF(job_id % 11 = 0, NULL, status) AS status",
        "progress", "current_stage", "CAST(created_at AS STRING) AS created_at", "error", "document_id")
    return fl.read_jobs(s, stored_json(s, jobs, 500)).select("job_id", "upload_id", "status", "progress", "current_stage", "error", "document_id")


def jobs_by_upload(s, d):
    return jb.active_conflicts(jb.latest(src.job_events(s, d)).withColumn("upload_id", F.expr("job_id % 10")))


QUERIES = {
    "query_normalize": norm_queries,
    "request_validation": requests,
    "search_scope": scope_queries,
    "lexical_match": lambda s, d: hits(s, d).select(
        "query_id", "entity_id", "match_score", "match_reason", F.array_join("matched_terms", ",").alias("matched_terms")),
    "graph_expand": lambda s, d: expanded(s, d)[0].select("query_id", "entity_id", "hop", "match_reason"),
    "graph_relationships": lambda s, d: expanded(s, d)[1],
    "evidence": lambda s, d: found_whole(s, d)[0].select("query_id", "entity_id", "evidence_id", "is_stale"),
    "evidence_blocks": lambda s, d: located(s, d),
    "passages": lambda s, d: found_whole(s, d)[1].select(
        "query_id", "entity_id", "block_id", "section_title", "previous_text", "next_text"),
    "search_scores": lambda s, d: r9(scored(s, d), "total_score").select(
        "query_id", "entity_id", "title_score", "content_score", "type_score", "evidence_score", "passage_score", "confidence_score", "total_score"),
    "search_ranked_topk": lambda s, d: r9(ranked(s, d), "total_score").select(
        "query_id", "rank", "entity_id", "total_score", "match_reason", "hop", "total_candidates", "has_more"),
    "search_package": packaged,
    "search_provenance": search_provenance,
    "package_outgoing": lambda s, d: package_rows(s, d, "outgoing", "target_entity_id", "relationship_type"),
    "package_incoming": lambda s, d: package_rows(s, d, "incoming", "source_entity_id", "relationship_type"),
    "package_evidence": lambda s, d: package_rows(s, d, "evidence", "evidence_id", "is_stale"),
    "package_passages": lambda s, d: package_rows(s, d, "passages", "block_id", "section_title"),
    "stored_blocks": stored_blocks,
    "appended_labels": appended_labels,
    "context_packing": lambda s, d: sources(s, d).select("query_id", "citation_id", "entity_id", "block_id", "provenance"),
    "context_packing_small": lambda s, d: sources(s, d, 600).select("query_id", "citation_id", "entity_id", "block_id", "provenance"),
    "prompts": lambda s, d: cx.prompts(se.accepted(src.search_requests(s, d)), sources(s, d)),
    "doc_statistics": lambda s, d: ct.document_statistics(src.blocks(s, d), src.pages(s, d)),
    "doc_detail": lambda s, d: ct.document_detail(
        src.table(s, d, "documents").select("doc_id", "lang", "source"), src.table(s, d, "labels").select("doc_id", "quality")),
    "catalog_pages": lambda s, d: ct.pages_of(src.pages(s, d), 7),
    "catalog_page_blocks": lambda s, d: ct.blocks_of(src.blocks(s, d), 7, 1).select("block_id", "reading_order", "text"),
    "catalog_versions": lambda s, d: ct.finalized_versions(*versions(s, d)).select("version_id", "upload_id", "approval_version", "position"),
    "catalog_latest_version": lambda s, d: ct.latest_versions(*versions(s, d)).select("version_id", "upload_id"),
    "catalog_counts": version_counts,
    "catalog_entities": lambda s, d: ct.list_entities(ent(s, d), "v1", entity_type="PROMO", offset=5, limit=20).select("entity_id", "title"),
    "catalog_entity_count": lambda s, d: ct.counts(ent(s, d), version_id="v1", entity_type="PROMO"),
    "catalog_relationships": lambda s, d: ct.list_relationships(rel(s, d), "v1", kind="PROVES", offset=3, limit=50).select(
        "source_entity_id", "target_entity_id", "relationship_type"),
    "catalog_evidence": lambda s, d: ct.evidence_of_entity(evd(s, d), "21").select("evidence_id", "page_number"),
    "neighbors": lambda s, d: ct.neighbors(rel(s, d)),
    "node_text_search": lambda s, d: ct.search_nodes(nodes(s, d), "the").select("doc_id", "node_id", "category"),
    "layer_filter": lambda s, d: ct.layer(src.blocks(s, d).withColumn("provenance", F.expr(
        "CASE seq % 3 WHEN 0 THEN 'NATIVE' WHEN 1 THEN 'OCR' ELSE 'MERGED' END")), "OCR").select("doc_id", "block_id"),
    "page_block_counts": lambda s, d: ct.blocks_per_page(src.blocks(s, d)),
    "job_transitions": lambda s, d: jb.transitions(src.job_events(s, d)).select("job_id", "event_id", "previous", "status", "valid"),
    "active_job_guard": jobs_by_upload,
    "job_latest": lambda s, d: r9(jb.latest(src.job_events(s, d)), "duration_s").select(
        "job_id", "status", "current_stage", "progress", "error", "document_id", "events", "duration_s"),
    "constraint_violations": violations,
    "immutability_diff": immutability,
    "ocr_screen": screened,
    "ocr_blocks": lambda s, d: r9(ocr_layout(s, d), "x0", "x1", "y0", "y1", "font_size", "ocr_confidence").select(
        "doc_id", "page_number", "block_num", "seq", "text", "x0", "y0", "x1", "y1", "font_size", "ocr_confidence"),
    "ocr_classify": lambda s, d: r9(ocr.classified_words(ocr_layout(s, d)), "confidence").select(
        "doc_id", "block_num", "block_type", "heading_level", "confidence"),
    "ocr_merge_candidates": lambda s, d: ocr.overlap_candidates(native(s, d), recognised(s, d)),
    "ocr_merge": lambda s, d: ocr.renumber(merged(s, d)).select("doc_id", "block_id", "page_number", "reading_order", "provenance"),
    "ocr_page_confidence": page_conf,
    "ocr_confidence": lambda s, d: ocr.document_confidence(page_conf(s, d)),
    "ocr_word_statistics": lambda s, d: ocr.word_statistics(src.words(s, d)),
    "ocr_status": lambda s, d: ocr.ocr_status(src.pages(s, d).withColumn("outcome", F.expr(
        "CASE (doc_id + page_number) % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' ELSE 'skipped' END"))),
    "span_blocks": lambda s, d: r9(asm.spans_to_blocks(spans(s, d)), "font_size").select(
        "doc_id", "page_number", "block_ord", "text", "font_size", "font_family", "bold", "italic"),
    "outside_tables": lambda s, d: asm.outside_tables(src.blocks(s, d), tables_(s, d)).select("doc_id", "block_id"),
    "image_captions": captions,
    "page_cache_work": page_work,
    "upload_screen": uploads,
    "stored_uploads": read_back_uploads,
    "stored_jobs": read_back_jobs,
}
