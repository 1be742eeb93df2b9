"""Registered queries: hierarchy, reading graph, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchy as hi
from ..operators import quality as q
from ..sources import standin as src
from .pipeline import classified, stage, structured

KEY = ["doc_id", "block_id"]


def labelled(s, d):
    return stage(s, d, "classified", lambda: classified(src.rich_blocks(s, d)))


def tree(s, d):
    return stage(s, d, "structured", lambda: structured(labelled(s, d)))


def edges(s, d):
    return hi.reading_edges(tree(s, d))


def validation(s, d):
    return stage(s, d, "validation", lambda: hi.validate(tree(s, d)))


def scores(s, d):
    """Every score is stored by itself, so that the blocks of a corpus are not read, sorted and shuffled for all of them at once."""
    t = tree(s, d)
    score = lambda name, build: stage(s, d, f"score_{name}", build)
    return q.overall(
        score("ocr", lambda: q.ocr_score(t)), score("layout", lambda: q.layout_score(t)), score("semantic", lambda: q.semantic_score(t)),
        q.hierarchy_score(validation(s, d)), score("reading", lambda: q.reading_score(t, hi.reading_edges(t))),
    )


def r9(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


def breadcrumbs(s, d):
    b = hi.breadcrumbs(tree(s, d))
    return b.withColumn("breadcrumb", F.array_join("breadcrumb", " > "))


def two_column_overlaps(s, d):
    return r9(q.overlap_pairs(src.two_column_blocks(s, d)), "overlap")


def upside_down(s, d):
    """Every third document has its page coordinates shifted so that the flow jumps upwards."""
    return tree(s, d).withColumns(
        {
            "y0": F.expr("IF(doc_id % 3 = 0, (y0 * 7) % 400, y0)"),
            "y1": F.expr("IF(doc_id % 3 = 0, (y0 * 7) % 400 + 12, y1)"),
        }
    )


SCORES = ("ocr_quality", "layout_quality", "semantic_quality", "hierarchy_quality", "reading_quality",
          "overall_quality", "r_garbage", "r_spacing", "r_unknown")

QUERIES = {
    "classified_blocks": lambda s, d: labelled(s, d).select(*KEY, "seq", "block_type", "heading_level"),
    "heading_parents": lambda s, d: tree(s, d).where("block_type = 'HEADING'").select(*KEY, "parent_block_id"),
    "list_nesting": lambda s, d: tree(s, d).where("block_type <> 'HEADING'").select(*KEY, "parent_block_id"),
    "caption_targets": lambda s, d: tree(s, d).where("block_type = 'CAPTION'").select(*KEY, "caption_target_id"),
    "hierarchy_depth": lambda s, d: tree(s, d).select(*KEY, "depth", "chapter_id", "section_id"),
    "subtree_sizes": lambda s, d: hi.hierarchy_rows(tree(s, d)).select(
        *KEY, "subtree_size", "first_descendant", "last_descendant"),
    "hierarchy_rows": lambda s, d: hi.hierarchy_rows(tree(s, d)).select(
        *KEY, "parent_block_id", "relation_type", "child_count", "sibling_count"),
    "hierarchy_children": lambda s, d: hi.children(tree(s, d)),
    "reading_edges": lambda s, d: edges(s, d),
    "graph_navigation": lambda s, d: hi.navigation(edges(s, d)),
    "ancestors": lambda s, d: hi.closure(tree(s, d)),
    "breadcrumbs": breadcrumbs,
    "hierarchy_validation": lambda s, d: r9(hi.validate(tree(s, d)), "consistency_score"),
    "overlap_pairs": two_column_overlaps,
    "quality_ocr": lambda s, d: r9(q.ocr_score(tree(s, d)), "avg_confidence", "r_suspicious", "r_garbage", "ocr_quality"),
    "quality_layout": lambda s, d: r9(q.layout_score(src.two_column_blocks(s, d)), "r_spacing", "layout_quality"),
    "quality_spacing": lambda s, d: r9(q.spacing(tree(s, d)), "r_spacing"),
    "odd_blocks": lambda s, d: q.odd_blocks(src.rich_blocks(s, d).withColumn("y1", F.expr("IF(seq % 5 = 0, y0 + 3, y1)"))),
    "quality_semantic": lambda s, d: r9(q.semantic_score(tree(s, d)), "avg_semantic", "r_unknown", "semantic_quality"),
    "quality_hierarchy": lambda s, d: r9(q.hierarchy_score(hi.validate(tree(s, d))), "hierarchy_quality"),
    "quality_hierarchy_fallback": lambda s, d: r9(q.hierarchy_fallback(tree(s, d)), "hierarchy_quality"),
    "quality_reading": lambda s, d: r9(q.reading_score(upside_down(s, d), edges(s, d)), "reading_quality"),
    "quality_overall": lambda s, d: r9(scores(s, d).select(
        "doc_id", "ocr_quality", "layout_quality", "semantic_quality", "hierarchy_quality", "reading_quality",
        "overall_quality"), "ocr_quality", "layout_quality", "semantic_quality", "hierarchy_quality",
        "reading_quality", "overall_quality"),
    "quality_warnings": lambda s, d: q.quality_notes(r9(scores(s, d), *SCORES), q.odd_blocks(tree(s, d))),
}
