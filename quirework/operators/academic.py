"""Academic annotations, their stable anchors, the academic graph and its quality."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .ordered import CHUNK_ROWS, running
from .settle import dealt

_P, _W = tx.portable, tx.WORD
# Prefixes that name the role of a block.
INDICATORS = {
    "starts_with_definition": _P(r"^(?i:Definition|Def\.)\s+\d+"),
    "starts_with_theorem": _P(r"^(?i:Theorem|Thm\.)\s+\d+"),
    "starts_with_proof": rf"^(?i:Proof(?![{_W}])|Pf\.(?=[{_W}]))",
    "starts_with_example": _P(r"^(?i:Example|Ex\.)\s+\d+"),
    "starts_with_exercise": _P(r"^(?i:Exercise|Exer\.)\s+\d+"),
    "starts_with_objective": rf"^(?i:Learning Objectives?|Objectives?)(?![{_W}])",
    "starts_with_summary": rf"^(?i:Summary|Key Takeaways?)(?![{_W}])",
}
MATH = _P(
    rf"[∀-⋿]|(?<![{_W}])[xXyYzZ](?![{_W}])|[+\-*/=<>()]\s*[0-9]+|(?<![{_W}])\d+(?![{_W}])\s*[+\-*/=]"
)
CATEGORIES = (
    "UNIT", "CHAPTER", "SECTION", "TOPIC", "CONCEPT", "DEFINITION", "THEOREM", "PROOF", "FORMULA",
    "ALGORITHM", "EXAMPLE", "EXERCISE", "LEARNING_OBJECTIVE", "SUMMARY", "REVIEW_QUESTION", "REFERENCE",
    "DIAGRAM", "APPENDIX",
)
CURRICULUM, EXPOSITORY, PEDAGOGICAL = (
    "CURRICULUM_CLASSIFICATION_MODULE", "EXPOSITORY_CLASSIFICATION_MODULE", "PEDAGOGICAL_CLASSIFICATION_MODULE",
)


def _has(t: str, name: str) -> str:
    return tx.sql_rlike(t, INDICATORS[name])


def features(h: DataFrame) -> DataFrame:
    """Per block: depth, type scale, indent, enclosing section, math flag, prefix indicators."""
    df = h.withColumn("t", F.expr(tx.sql_strip("coalesce(text, '')")))
    marks = ", ".join(f"IF({_has('t', n)}, '{n}', NULL)" for n in INDICATORS)
    return df.withColumns(
        {
            "heading_depth": F.col("depth"),
            "typography_scale": F.expr("coalesce(nullif(font_size, 0D), 10D) / 10"),
            "indentation_level": F.expr("IF(x0 > 50, CAST(floor((x0 - 50) / 15) AS INT), 0)"),
            "enclosing_section_title": F.expr(
                "IF(block_type = 'HEADING', text, try_element_at(filter(path, x -> x.level IS NOT NULL), -1).title)"
            ),
            "has_math": F.expr(tx.sql_rlike("t", MATH)),
            "indicators": F.expr(f"array_compact(array({marks}))"),
        }
    )


def _curriculum(kind: str, depth: str, t: str) -> str:
    low = f"lower({t})"
    return (
        f"CASE WHEN {kind} = 'HEADING' THEN CASE WHEN {depth} = 0 THEN 'UNIT' WHEN {depth} = 1 THEN 'CHAPTER' "
        f"WHEN {depth} >= 3 THEN 'TOPIC' ELSE 'SECTION' END "
        f"WHEN startswith({low}, 'chapter ') OR startswith({low}, 'chap. ') THEN 'CHAPTER' "
        f"WHEN startswith({low}, 'unit ') THEN 'UNIT' END"
    )


def _expository(kind: str, t: str) -> str:
    return (
        f"CASE WHEN {_has(t, 'starts_with_definition')} THEN 'DEFINITION' WHEN {_has(t, 'starts_with_theorem')} "
        f"THEN 'THEOREM' WHEN {_has(t, 'starts_with_proof')} THEN 'PROOF' WHEN {_has(t, 'starts_with_example')} "
        f"THEN 'EXAMPLE' WHEN {kind} = 'EQUATION' AND {tx.sql_rlike(t, MATH)} THEN 'FORMULA' END"
    )


def _pedagogical(t: str) -> str:
    return (
        f"CASE WHEN {_has(t, 'starts_with_objective')} THEN 'LEARNING_OBJECTIVE' "
        f"WHEN {_has(t, 'starts_with_summary')} THEN 'SUMMARY' WHEN {_has(t, 'starts_with_exercise')} "
        "THEN 'EXERCISE' END"
    )


def annotations(h: DataFrame) -> DataFrame:
    """Up to three academic types per block, one row each, with the block's nearest annotated ancestor.

    An ancestor is annotated when one of the same rules fits it; the path carries what the
    rules need, so no join is made.
    """
    df = h.withColumn("t", F.expr(tx.sql_strip("coalesce(text, '')")))
    row = lambda rank, kind, conf, mod: (
        f"IF(({kind}) IS NULL, NULL, named_struct('ann_ord', {rank}, 'academic_type', {kind}, "
        f"'ann_confidence', {conf}, 'provenance', '{mod}'))"
    )
    cur, exp, ped = _curriculum("block_type", "depth", "t"), _expository("block_type", "t"), _pedagogical("t")
    items = ", ".join(
        (
            row(1, cur, "IF(block_type = 'HEADING', 0.95D, 0.90D)", CURRICULUM),
            row(2, exp, f"IF(({exp}) = 'FORMULA', 0.90D, 0.85D)", EXPOSITORY),
            row(3, ped, "0.85D", PEDAGOGICAL),
        )
    )
    xt = tx.sql_strip("coalesce(x.title, '')")
    fits = (
        f"x.kind = 'HEADING' OR ({_curriculum('x.kind', '0', xt)}) IS NOT NULL OR ({_expository('x.kind', xt)}) IS NOT NULL "
        f"OR ({_pedagogical(xt)}) IS NOT NULL"
    )
    # Slug of each heading above the block.
    title = "lower(x.title)"
    slug = (
        f"CASE WHEN coalesce(x.title, '') = '' THEN 'root' ELSE "
        f"btrim(regexp_replace(regexp_replace({tx.sql_strip(title)}, r'[^a-z0-9{tx.BLANK_CLASS}\\-]', ''), "
        f"r'[{tx.BLANK_CLASS}\\-]+', '-'), '-') END"
    )
    heads = "filter(path, x -> x.kind = 'HEADING')"
    return df.select(
        "doc_id", "block_id", "seq", *(["doc_rows"] if "doc_rows" in h.columns else []), "text", "page_number",
        F.expr(f"IF(size({heads}) = 0, 'root', array_join(transform({heads}, x -> {slug}), '/'))").alias("section_path"),
        F.expr(f"try_element_at(filter(path, x -> {fits}), -1).id").alias("parent_annotated"),
        F.expr(f"inline(array_compact(array({items})))"),
    )


def text_hash(c: str = "text") -> str:
    return f"CASE WHEN coalesce({c}, '') = '' THEN '' ELSE sha2(regexp_replace(lower({c}), r'[^{_W}]+', ''), 256) END"


def anchors(ann: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds ordinal and anchor key; a type belongs to one module, so ``seq`` orders a group."""
    keys = ["doc_id", "section_path", "academic_type"]
    df = running(ann, {"_n": ("sum", F.lit(1))}, rows=rows, doc=keys, before=True).drop("chunk")
    df = df.withColumn("ordinal", F.expr("CAST(coalesce(_n, 0) AS INT)")).drop("_n")
    raw = f"concat(CAST(doc_id AS STRING), ':', section_path, ':', academic_type, ':', {text_hash()}, ':', ordinal)"
    return df.withColumn("anchor_key", F.expr(f"sha2({raw}, 256)"))


def anchor_collisions(anchored: DataFrame) -> DataFrame:
    return anchored.groupBy("doc_id", "anchor_key").agg(
        F.count("*").alias("n"), F.min("block_id").alias("first_block"), F.max("block_id").alias("last_block")
    ).where("n > 1")


def nodes(anchored: DataFrame) -> DataFrame:
    """One node per annotation; a block with several annotations keeps its last anchor on all of them."""
    last = anchored.groupBy("doc_id", "block_id").agg(F.max_by("anchor_key", "ann_ord").alias("anchor_key"))
    title = "IF(length(text) > 40, concat(left(text, 40), '...'), text)"
    return anchored.drop("anchor_key").join(last, ["doc_id", "block_id"]).select(
        "doc_id",
        F.concat(F.lit("an_"), "block_id").alias("node_id"),
        F.col("academic_type").alias("category"),
        F.expr(f"coalesce(nullif({title}, ''), academic_type)").alias("title"),
        F.col("block_id").alias("target_block_id"),
        "anchor_key",
        F.lit("UNREVIEWED").alias("review_state"),
        "provenance", "ann_ord", "seq", "page_number",
    )


def contains_edges(anchored: DataFrame) -> DataFrame:
    """CONTAINS from the nearest annotated ancestor, one per annotation of the child."""
    return anchored.where("parent_annotated IS NOT NULL").select(
        "doc_id",
        F.concat(F.lit("an_"), "parent_annotated").alias("source_node_id"),
        F.concat(F.lit("an_"), "block_id").alias("target_node_id"),
        F.lit("CONTAINS").alias("edge_type"),
        F.col("ann_confidence").alias("confidence"),
        "ann_ord", "seq",
    )


CONTAINERS = "('CHAPTER', 'SECTION')"
NOT_CONTENT = "('CHAPTER', 'SECTION', 'UNIT')"


def academic_quality(ns: DataFrame, es: DataFrame, pages: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """Coverage, orphan ratio, density and score per document."""
    content = ns.where(f"category NOT IN {NOT_CONTENT}")
    edges = es.where("edge_type = 'CONTAINS'").select("doc_id", "source_node_id", "target_node_id").distinct()
    covered = (
        edges.join(content.select("doc_id", F.col("node_id").alias("target_node_id")), ["doc_id", "target_node_id"], "left_semi")
        .select("doc_id", F.col("source_node_id").alias("node_id")).distinct()
        .join(ns.where(f"category IN {CONTAINERS}").select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi")
        .groupBy("doc_id").agg(F.count("*").alias("covered"))
    )
    orphans = content.join(
        edges.select("doc_id", F.col("target_node_id").alias("node_id")), ["doc_id", "node_id"], "left_anti"
    ).groupBy("doc_id").agg(F.count("*").alias("orphan_count"))
    base = ns.groupBy("doc_id").agg(
        F.count("*").alias("node_count"),
        F.expr(f"count_if(category IN {CONTAINERS})").alias("containers"),
        F.expr(f"count_if(category NOT IN {NOT_CONTENT})").alias("content"),
    )
    df = base.join(covered, "doc_id", "left").join(orphans, "doc_id", "left").join(pages, "doc_id", "left")
    cyc = cycles.select("doc_id", F.lit(True).alias("cycle_detected")) if cycles is not None else None
    df = df.join(cyc, "doc_id", "left") if cyc is not None else df.withColumn("cycle_detected", F.lit(False))
    df = df.fillna(0, ["covered", "orphan_count"]).fillna(1, ["page_count"]).fillna(False, ["cycle_detected"])
    df = df.withColumns(
        {
            "coverage": F.expr("IF(containers > 0, covered / containers, 1D)"),
            "orphan_ratio": F.expr("IF(content > 0, orphan_count / content, 0D)"),
            "density": F.expr("content / page_count"),
        }
    )
    return df.withColumn(
        "academic_score",
        F.expr("greatest(0D, least(1D, coverage * (1 - orphan_ratio) * IF(cycle_detected, 0D, 1D)))"),
    )


def academic_notes(aq: DataFrame) -> DataFrame:
    rules = (
        ("coverage < 0.5", "warning", "ACADEMIC_COVERAGE_LOW", "WARNING"),
        ("orphan_count > 0", "warning", "ORPHAN_ACADEMIC_NODES", "INFO"),
        ("cycle_detected", "warning", "CYCLIC_ACADEMIC_RELATIONS", "CRITICAL"),
        ("cycle_detected OR orphan_ratio > 0.3", "recommendation", "MANUAL_CURRICULUM_REVIEW", "WARNING"),
    )
    items = ", ".join(
        f"IF({c}, named_struct('kind', '{k}', 'code', '{x}', 'severity', '{s}'), NULL)" for c, k, x, s in rules
    )
    return aq.select("doc_id", F.expr(f"inline(array_compact(array({items})))"))


def pipeline_report(h: DataFrame, edges: DataFrame, ann: DataFrame, validation: DataFrame, scores: DataFrame,
                    aq: DataFrame) -> DataFrame:
    """Per document: annotation counts and average confidence, section and root counts, edge histogram.

    Counted annotations: features (1.0), the final classification, reading order, hierarchy,
    the reading graph (0.98), the two or three quality annotations and the academic ones.
    """
    blocks = h.groupBy("doc_id").agg(
        F.count("*").alias("total_nodes"),
        F.sum("semantic_conf").alias("_sem"), F.sum("order_confidence").alias("_ord"),
        F.expr("count_if(block_type = 'HEADING')").alias("total_sections"),
        F.expr("count_if(parent_block_id IS NULL)").alias("root_count"),
    )
    e = edges.groupBy("doc_id").agg(
        F.count("*").alias("total_edges"),
        *[F.expr(f"count_if(edge_type = '{t}')").alias(t.lower())
          for t in ("PARENT_CHILD", "SIBLING", "READING_FLOW", "CAPTION_ASSOCIATION")],
    )
    a = ann.groupBy("doc_id").agg(F.count("*").alias("academic_annotations"), F.sum("ann_confidence").alias("_ann"))
    q = scores.select("doc_id", "overall_quality")
    v = validation.select("doc_id", "consistency_score", "max_depth", "orphan_count")
    s = aq.select("doc_id", "academic_score")
    df = blocks
    for side in (e, a, q, v, s):
        df = df.join(dealt(side), "doc_id", "left")
    counts = [c for c in ("total_edges", "parent_child", "sibling", "reading_flow", "caption_association",
                          "academic_annotations")]
    df = df.fillna(0, counts).fillna(0.0, ["_ann"]).fillna(1.0, ["academic_score"])
    # Per block: feature 1.0, hierarchy 0.90; per document: graph 0.98 and three quality rows.
    total = "total_nodes * 1.9D + _sem + _ord + _ann + 0.98D + consistency_score + overall_quality + academic_score"
    return df.withColumn("annotation_count", F.expr("total_nodes * 4 + academic_annotations + 4")).withColumn(
        "average_confidence", F.expr(f"({total}) / annotation_count")
    ).drop("_sem", "_ord", "_ann")


def _digest_lines(batches):
    """Sorted lines in, one digest per document out; only the running digest is kept."""
    doc, part, digest = None, None, None
    for batch in batches:
        out = []
        for d, p, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if digest is None or d != doc:
                if digest is not None:
                    out.append((doc, _closed(digest, part)))
                doc, part, digest = d, None, hashlib.sha256()
            if p and not part:
                digest.update(b"\n---\n")
            elif part == p:
                digest.update(b"\n")
            digest.update(line.encode())
            part = p
        yield _digest_batch(out, batch.schema.field(0).type)
    if digest is not None:
        yield _digest_batch([(doc, _closed(digest, part))], batch.schema.field(0).type)


def _closed(digest, part: int) -> str:
    if not part:
        digest.update(b"\n---\n")
    return digest.hexdigest()


def _digest_batch(rows: list, doc_type: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([d for d, _ in rows], doc_type), pa.array([f for _, f in rows], pa.string())], ["doc_id", "fingerprint"]
    )


def graph_fingerprint(ns: DataFrame, es: DataFrame) -> DataFrame:
    """One digest per document of its nodes, containment, titles and other edges.

    The sorted lines of a document are streamed through one SHA-256, so memory does not grow
    with the document and the digest is the same rule at every size.
    """
    ids = ns.groupBy("doc_id", "node_id").agg(
        F.expr("coalesce(max_by(anchor_key, struct(seq, ann_ord)), '')").alias("_a")
    )
    # With several containment edges the last one counts.
    parent = es.where("edge_type = 'CONTAINS'").groupBy("doc_id", F.col("target_node_id").alias("node_id")).agg(
        F.max_by("source_node_id", F.struct("ann_ord", "seq")).alias("_p")
    )
    pa = parent.join(ids.select("doc_id", F.col("node_id").alias("_p"), F.col("_a").alias("_pa")), ["doc_id", "_p"], "left")
    n = ns.join(pa.select("doc_id", "node_id", "_pa"), ["doc_id", "node_id"], "left")
    lines = n.select(
        "doc_id", F.lit(0).alias("part"),
        F.concat_ws(":", F.coalesce("anchor_key", "node_id"), "category", F.coalesce("_pa", F.lit("")), "title").alias("line"),
    )
    other = es.where("edge_type <> 'CONTAINS'")
    a = lambda side: ids.select("doc_id", F.col("node_id").alias(f"{side}_node_id"), F.col("_a").alias(f"_{side}"))
    e = other.join(a("source"), ["doc_id", "source_node_id"], "left").join(a("target"), ["doc_id", "target_node_id"], "left")
    lines = lines.unionByName(
        e.select(
            "doc_id", F.lit(1).alias("part"),
            F.concat_ws("->", F.coalesce("_source", "source_node_id"), "edge_type", F.coalesce("_target", "target_node_id"))
            .alias("line"),
        )
    )
    ordered = lines.repartition("doc_id").sortWithinPartitions("doc_id", "part", "line")
    return ordered.select("doc_id", "part", "line").mapInArrow(
        _digest_lines, f"doc_id {dict(lines.dtypes)['doc_id']}, fingerprint string"
    )
