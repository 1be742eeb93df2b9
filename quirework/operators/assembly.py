"""From parsed spans to first-pass layout blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.geometry import bands, band_of
from .classify import NUMBERING, heading_levels, with_dominant
from .ordered import CHUNK_ROWS, dense_position, running

PAGE = ("doc_id", "page_number")
BAND = 64.0


def spans_to_blocks(spans: DataFrame) -> DataFrame:
    """Join spans into lines and lines into blocks; average size, most frequent font, style flags."""
    block = [*PAGE, "block_ord"]
    styled = spans.withColumns(
        {
            "_bold": F.expr("(flags & 16) > 0 OR contains(lower(font), 'bold')"),
            "_italic": F.expr("(flags & 2) > 0 OR contains(lower(font), 'italic')"),
        }
    )
    # A line and a block are small by nature: what one text box of one page holds.
    lines = styled.groupBy(*block, "line_ord").agg(
        F.array_join(F.expr("transform(array_sort(collect_list(struct(span_ord, text))), s -> s.text)"), "").alias("line"),
        F.sum("size").alias("_sizes"), F.count("size").alias("_n"),
        F.bool_or("_bold").alias("bold"), F.bool_or("_italic").alias("italic"),
        F.first("bx0").alias("x0"), F.first("by0").alias("y0"), F.first("bx1").alias("x1"), F.first("by1").alias("y1"),
    )
    text = lines.groupBy(*block).agg(
        F.array_join(F.expr("transform(array_sort(collect_list(struct(line_ord, line))), s -> s.line)"), "\n").alias("text"),
        (F.sum("_sizes") / F.sum("_n")).alias("font_size"),
        F.bool_or("bold").alias("bold"), F.bool_or("italic").alias("italic"),
        *[F.first(c).alias(c) for c in ("x0", "y0", "x1", "y1")],
    )
    # Equal counts: the font whose name sorts first.
    fonts = styled.groupBy(*block, "font").count().groupBy(*block).agg(
        F.min_by("font", F.struct(-F.col("count"), F.col("font"))).alias("font_family")
    )
    return text.join(fonts, block).where(~tx.is_blank(F.col("text"))).withColumn("provenance", F.lit("NATIVE"))


def number_blocks(blocks: DataFrame) -> DataFrame:
    """Dense ``seq`` by (page, block_ord) and a reproducible block id."""
    out = dense_position(blocks, ["block_ord"])
    key = F.concat_ws(":", F.col("doc_id").cast("string"), "page_number", "block_ord")
    return out.withColumn("block_id", F.sha2(key, 256))


def outside_tables(blocks: DataFrame, tables: DataFrame, pad: float = 5.0, band: float = BAND) -> DataFrame:
    """Drop blocks that lie inside a table of their page, grown by ``pad`` points."""
    t = tables.select(
        *PAGE,
        (F.col("x0") - pad).alias("tx0"), (F.col("y0") - pad).alias("ty0"),
        (F.col("x1") + pad).alias("tx1"), (F.col("y1") + pad).alias("ty1"),
    )
    # A containing table covers the band of the block's top edge, so equality on it prunes the join.
    t = t.withColumn("_band", F.explode(bands(F.col("ty0"), F.col("ty1"), band)))
    b = blocks.withColumn("_band", band_of(F.col("y0"), band))
    inside = [b[c] == t[c] for c in (*PAGE, "_band")] + [
        b.x0 >= t.tx0, b.y0 >= t.ty0, b.x1 <= t.tx1, b.y1 <= t.ty1
    ]
    return b.join(t, inside, "left_anti").drop("_band")


def register_images(rects: DataFrame) -> DataFrame:
    """One image per distinct rectangle of a page, the first one found."""
    box = ["x0", "y0", "x1", "y1"]
    first = rects.groupBy(*PAGE, *box).agg(F.min("image_ord").alias("image_ord"))
    return first.withColumns({"width": F.col("x1") - F.col("x0"), "height": F.col("y1") - F.col("y0")})


def image_captions(images: DataFrame, blocks: DataFrame, reach: float = 30.0, band: float = BAND) -> DataFrame:
    """Caption of an image: the first CAPTION block, in parser order, at most ``reach`` below it."""
    i = images.withColumn("_band", F.explode(bands(F.col("y1"), F.col("y1") + reach, band)))
    c = blocks.where("block_type = 'CAPTION'").select(
        *PAGE, F.col("seq").alias("_seq"), F.col("text").alias("_text"), F.col("y0").alias("_cy"),
        band_of(F.col("y0"), band).alias("_band"),
    )
    hit = i.join(c, [*PAGE, "_band"]).where((F.col("_cy") - F.col("y1")).between(0, reach))
    best = hit.groupBy(*PAGE, "image_ord").agg(F.min_by("_text", "_seq").alias("caption"))
    return images.join(best, [*PAGE, "image_ord"], "left")


def needs_ocr(blocks: DataFrame, pages: DataFrame, per_page: int = 50) -> DataFrame:
    """Documents whose text is too short for their page count."""
    chars = blocks.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"))
    count = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"))
    return count.join(chars, "doc_id", "left").selectExpr(
        "doc_id", "page_count", "coalesce(chars, 0) AS chars",
        f"CASE WHEN coalesce(chars, 0) < {per_page} * page_count THEN 'needs_ocr' ELSE 'processed' END AS status",
    )


def font_statistics(blocks: DataFrame) -> DataFrame:
    """Dominant size by characters and dominant family by blocks; the first seen wins a tie."""
    named = blocks.where("text <> ''").selectExpr(
        "doc_id", "seq", "coalesce(font_size, 10D) AS s", "coalesce(font_family, 'Arial') AS f", "length(text) AS n"
    )
    per = named.groupBy("doc_id", "s", "f").agg(
        F.sum("n").alias("n"), F.count("*").alias("b"), F.min("seq").alias("first")
    )
    size = per.groupBy("doc_id", "s").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    fam = per.groupBy("doc_id", "f").agg(F.sum("b").alias("b"), F.min("first").alias("first"))
    return (
        size.groupBy("doc_id").agg(F.expr("max_by(s, struct(n, -first))").alias("dominant_size"))
        .join(fam.groupBy("doc_id").agg(F.expr("max_by(f, struct(b, -first))").alias("dominant_family")), "doc_id")
    )


@dataclass(frozen=True)
class FirstPassParams:
    size: float = 1.5
    bold: float = 1.0
    length: float = 0.8
    case: float = 0.6
    punctuation: float = 1.2
    numbering: float = 1.0
    spacing: float = 0.8
    neighbor: float = 1.0
    heading_at: float = 0.65
    unknown_below: float = 0.35
    body_margin: float = 0.75
    header_margin: float = 60.0
    footer_margin: float = 60.0


# Prefixes that mark list items and captions.
LIST_PREFIXES = ("\u2022", "-", "*", "o", "\u25aa", "1.", "2.", "3.", "a.", "b.", "c.", "i.", "ii.")
CAPTION_PREFIXES = ("figure ", "fig. ", "table ", "tab. ", "image ", "illustration ")


def dominant_so_far(blocks: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """(doc_id, page_number, dominant_size): the size of most characters on this page and those
    before it; of equal ones the first seen.

    The count of a size only grows, so the leader of a page is the largest of all counts reached
    so far: a running sum per size, then a running maximum per document, both in chunks of pages."""
    size = F.expr("coalesce(font_size, 10D)")
    per = blocks.groupBy(*PAGE, size.alias("s")).agg(F.sum(F.length("text")).alias("n"), F.min("seq").alias("first"))
    seen = per.groupBy("doc_id", "s").agg(F.min("first").alias("_first"))
    counted = running(per, {"so_far": ("sum", F.col("n"))}, rows=rows, doc=["doc_id", "s"], seq="page_number").drop("chunk")
    reached = counted.join(seen, ["doc_id", "s"]).groupBy(*PAGE).agg(F.max(F.struct("so_far", -F.col("_first"), "s")).alias("best"))
    return running(reached, {"lead": ("max", F.col("best"))}, rows=rows, seq="page_number").select(*PAGE, F.col("lead.s").alias("dominant_size"))


def page_heading_levels(scored: DataFrame) -> DataFrame:
    """Rank of the heading size on its page, largest first, at most 6."""
    w = Window.partitionBy(*PAGE, F.col("block_type") == "HEADING").orderBy(F.desc("s"))
    return scored.withColumn("heading_level", F.when(F.col("block_type") == "HEADING", F.least(F.dense_rank().over(w), F.lit(6))))


def first_pass(blocks: DataFrame, p: FirstPassParams = FirstPassParams(), rows: int = CHUNK_ROWS, by_page: bool = False) -> DataFrame:
    """Type and confidence from position, eight signals and prefixes; then heading levels.

    ``by_page`` is for pages that arrive one after the other: a page is judged by the sizes of the
    pages up to it, and its heading levels are its own."""
    if by_page:
        df = blocks.join(dominant_so_far(blocks, rows), [*PAGE])
    else:
        df = with_dominant(blocks, {"dominant_size": ("coalesce(font_size, 10D)", "length(text)")}, rows)
    w = Window.partitionBy(*PAGE).orderBy("seq")
    df = df.withColumns(
        {
            "t": F.expr(tx.sql_strip("text")), "s": F.expr("coalesce(font_size, 10D)"),
            "_py1": F.lag("y1").over(w), "_ny0": F.lead("y0").over(w),
            "_ps": F.expr("coalesce(font_size, 10D)"),
        }
    )
    df = df.withColumns({"_ns": F.lead("_ps").over(w), "_ps": F.lag("_ps").over(w)})
    n_lines = r"(1 + length(text) - length(replace(text, '\n', '')))"
    r = tx.sql_rlike
    has_letter, upper = r("t", r"\p{L}"), r("t", f"[{tx.UPPER}]") + " AND NOT " + r("t", rf"[{tx.LOWER}\p{{Lt}}]")
    lower = r("t", f"[{tx.LOWER}]") + " AND NOT " + r("t", rf"[{tx.UPPER}\p{{Lt}}]")
    d = "(s - dominant_size)"
    signs = f"length(regexp_replace(t, r'[{tx.ALNUM}{tx.BLANK_CLASS}]', ''))"
    score = {
        "size": f"CASE WHEN {d} > 4.5 THEN 1D WHEN {d} > 2 THEN 0.6D WHEN abs({d}) <= {p.body_margin} THEN -0.5D "
                f"WHEN {d} < -1 THEN -0.8D ELSE 0D END",
        "bold": "CASE WHEN coalesce(bold, false) THEN 0.8D ELSE -0.5D END",
        "length": f"CASE WHEN length(t) < 40 AND {n_lines} = 1 THEN 0.8D WHEN length(t) < 100 AND {n_lines} <= 2 "
                  f"THEN 0.4D WHEN length(t) > 200 OR {n_lines} > 3 THEN -1D ELSE 0D END",
        "case": f"CASE WHEN {has_letter} AND {upper} THEN 0.8D WHEN {has_letter} AND "
                f"{r('left(t, 1)', f'[{tx.UPPER}]')} AND NOT ({lower}) THEN 0.3D ELSE -0.2D END",
        "punctuation": f"CASE WHEN right(t, 1) IN ('.', '?', '!') THEN -0.6D WHEN {signs} / length(t) > 0.15D "
                       "THEN -0.5D ELSE 0.3D END",
        "numbering": f"CASE WHEN {r('t', NUMBERING)} THEN 1D ELSE 0D END",
        "spacing": "CASE WHEN y0 - _py1 > 25 THEN 0.5D WHEN y0 - _py1 > 15 THEN 0.25D ELSE 0D END "
                   "+ CASE WHEN _ny0 - y1 > 20 THEN 0.3D ELSE 0D END",
        "neighbor": "CASE WHEN s > _ps + 1.5D THEN 0.5D ELSE 0D END + CASE WHEN s > _ns + 1.5D THEN 0.5D ELSE 0D END",
    }
    net = " + ".join(f"({v}) * {getattr(p, k)}D" for k, v in score.items())
    df = df.withColumn("net_score", F.expr(f"CASE WHEN t = '' THEN 0D ELSE {net} END"))
    df = df.withColumn("_conf", F.expr("1D / (1D + exp(-greatest(-20D, least(20D, net_score))))"))
    starts = lambda c, items: "(" + " OR ".join(f"startswith({c}, '{x}')" for x in items) + ")"
    top, foot = f"y1 <= {p.header_margin}D", f"y0 >= coalesce(page_height, 842D) - {p.footer_margin}D"
    listed, captioned = starts("t", LIST_PREFIXES), starts("lower(t)", CAPTION_PREFIXES)
    kind = (
        f"CASE WHEN t = '' THEN 'UNKNOWN' WHEN {top} THEN 'HEADER' WHEN {foot} THEN 'FOOTER' "
        f"WHEN _conf >= {p.heading_at}D THEN 'HEADING' WHEN {listed} THEN 'LIST' WHEN {captioned} THEN 'CAPTION' "
        f"WHEN _conf < {p.unknown_below}D THEN 'PARAGRAPH' ELSE 'UNKNOWN' END"
    )
    conf = (
        f"CASE WHEN t = '' THEN 1D WHEN {top} OR {foot} THEN 0.95D WHEN _conf < {p.heading_at}D AND "
        f"({listed} OR {captioned}) THEN 0.9D ELSE round(_conf, 3) END"
    )
    df = df.withColumns({"block_type": F.expr(kind), "class_confidence": F.expr(conf)})
    df = page_heading_levels(df) if by_page else heading_levels(df, size="s", rows=rows)
    return df.drop("t", "s", "_py1", "_ny0", "_ps", "_ns", "_conf")


def first_pass_parents(ordered: DataFrame) -> DataFrame:
    """Parent on the page: the nearest earlier heading of a smaller level, else the last heading."""
    w = Window.partitionBy(*PAGE).orderBy("reading_order").rowsBetween(Window.unboundedPreceding, -1)
    last = {
        f"_h{k}": F.last(
            F.when((F.col("block_type") == "HEADING") & (F.col("heading_level") == k),
                   F.struct("reading_order", "block_id")), ignorenulls=True).over(w)
        for k in range(1, 7)
    }
    df = ordered.withColumns(last)
    pick = lambda limit: f"array_max(array_compact(array({', '.join(f'IF({k} < {limit}, _h{k}, NULL)' for k in range(1, 7))})))"
    rule = "CASE WHEN block_type = 'HEADING' THEN heading_level ELSE 7 END"
    return df.withColumn("parent_block_id", F.expr(f"{pick(f'({rule})')}.block_id")).drop(*last)
