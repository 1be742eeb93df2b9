"""Registered queries: features, classification, order, first-pass assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as asm
from ..operators import classify as cl
from ..operators import features as ft
from ..operators import order as ro
from ..sources import standin as src

KEY = ["doc_id", "block_id"]
RATIOS = ["uppercase_ratio", "lowercase_ratio", "digit_ratio", "punctuation_ratio", "symbol_ratio",
          "avg_word_length", "text_density"]


def r9(*names):
    return [F.round(n, 9).alias(n) for n in names]


def typography(s, d):
    return ft.typography(src.blocks(s, d)).select(
        *KEY, "f_size", "f_family", "f_bold", "f_italic", "all_caps", "title_case", "starts_capital", "ends_punct")


def geometry(s, d):
    return ft.geometry(src.blocks(s, d)).select(
        *KEY, "width", "height", *r9("aspect_ratio", "page_position_y"), "margin_left", "margin_right", "alignment")


def layout(s, d):
    return ft.layout(ft.context(src.blocks(s, d))).select(
        *KEY, "space_above", "space_below", "is_at_top", "is_at_bottom", *r9("line_spacing"))


def statistics(s, d):
    return ft.statistics(src.blocks(s, d)).select(*KEY, "char_count", "word_count", *r9(*RATIOS))


def context(s, d):
    return ft.context(src.blocks(s, d)).select(
        *KEY, "prev_block_id", "next_block_id", "prev_text", "next_text", "prev_font_size", "next_font_size",
        "prev_block_type", "next_block_type")


def fingerprint_delta(s, d):
    """A third of the blocks changed since the last run; only those come back."""
    now = src.blocks(s, d)
    before = now.withColumn("text", F.expr("IF(seq % 3 = 0, concat(text, '!'), text)"))
    return ft.changed_blocks(now, ft.fingerprint(before)).select(*KEY)


def rich_features(s, d):
    return ft.extract(src.rich_blocks(s, d))


def dominant_font(s, d):
    return cl.dominant(rich_features(s, d), cl.SIZE_BY_CHARS | {"dominant_indent": cl.MARGINS["dominant_indent"]}).drop("max_seq")


def heading_scores(s, d):
    return cl.heading_scores(rich_features(s, d)).select(
        *KEY, "block_type", *r9(*[f"sig_{x}" for x in cl.SIGNALS], "weighted_sum", "c2_conf"))


def levelled(s, d):
    return cl.heading_levels(cl.heading_scores(rich_features(s, d)))


def heading_levels(s, d):
    return levelled(s, d).where("block_type = 'HEADING'").select(*KEY, "heading_level")


def c5(s, d):
    return cl.list_quote_note(levelled(s, d))


def c6(s, d):
    return cl.table_caption(c5(s, d))


def c7(s, d):
    return cl.code_formula(c6(s, d))


def annotations(s, d):
    return cl.annotate(c7(s, d)).select(
        *KEY, "block_type", *r9("semantic_conf"), "semantic_module", F.size("contributors").alias("n_contributors"))


def ordered(s, d):
    return ro.reading_order(src.two_column_blocks(s, d))


def first_pass(s, d):
    return asm.first_pass(src.two_column_blocks(s, d))


def first_order(s, d):
    return ro.first_pass_order(first_pass(s, d))


def first_pass_classify(s, d):
    return first_pass(s, d).select(
        *KEY, "block_type", F.round("class_confidence", 3).alias("class_confidence"), *r9("net_score"), "heading_level")


QUERIES = {
    "features_typography": typography,
    "features_geometry": geometry,
    "features_layout": layout,
    "features_statistics": statistics,
    "features_context": context,
    "feature_fingerprint_delta": fingerprint_delta,
    "dominant_font": dominant_font,
    "heading_scores": heading_scores,
    "heading_levels": heading_levels,
    "list_quote_note": lambda s, d: c5(s, d).select(*KEY, "block_type"),
    "table_caption": lambda s, d: c6(s, d).select(*KEY, "block_type"),
    "code_formula": lambda s, d: c7(s, d).select(*KEY, "block_type"),
    "semantic_annotations": annotations,
    "reading_order_pages": lambda s, d: ordered(s, d).select(*KEY, "seq", "column_index", "original_parser_order"),
    "reading_links": lambda s, d: ro.reading_links(ordered(s, d)).select(
        *KEY, "previous_block_id", "next_block_id", "order_confidence"),
    "first_pass_fonts": lambda s, d: asm.font_statistics(src.two_column_blocks(s, d)),
    "first_pass_classify": first_pass_classify,
    "first_pass_order": lambda s, d: first_order(s, d).select(*KEY, "reading_order", "previous_block_id", "next_block_id"),
    "first_pass_parents": lambda s, d: asm.first_pass_parents(first_order(s, d)).select(*KEY, "parent_block_id"),
    "needs_ocr": lambda s, d: asm.needs_ocr(src.blocks(s, d), src.pages(s, d)),
}
