"""Five document quality scores, their warnings and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.geometry import bands, band_of
from .ordered import CHUNK_ROWS, join_per_doc, near
from .settle import dealt

# What makes a word suspicious, wherever it stands in it, and what counts as a garbage character.
SUSPICIOUS = r"\p{Nd}[a-zA-Z]|[a-zA-Z]\p{Nd}|[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]{5}"
GARBAGE = r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\xFF"
BAND = 64.0


def ocr_score(blocks: DataFrame) -> DataFrame:
    words = tx.sql_words("text")
    rows = blocks.where("text <> ''").select(
        "doc_id",
        F.expr("coalesce(nullif(confidence, 0D), 1D)").alias("conf"),
        F.expr(f"size({words})").alias("words"),
        F.expr(f"IF({tx.sql_rlike('text', SUSPICIOUS)}, size(filter({words}, x -> {tx.sql_rlike('x', SUSPICIOUS)})), 0)").alias("odd"),
        F.expr(tx.sql_count("text", GARBAGE)).alias("bad"),
        F.length("text").alias("chars"),
    )
    return rows.groupBy("doc_id").agg(
        F.avg("conf").alias("avg_confidence"),
        F.expr("coalesce(sum(odd) / nullif(sum(words), 0), 0D)").alias("r_suspicious"),
        F.expr("coalesce(sum(bad) / nullif(sum(chars), 0), 0D)").alias("r_garbage"),
    ).withColumn(
        "ocr_quality",
        F.expr("greatest(0D, least(1D, avg_confidence * (1 - r_suspicious) * (1 - r_garbage)))"),
    )


def overlap_pairs(blocks: DataFrame, ratio: float = 0.15, band: float = BAND) -> DataFrame:
    """Pairs of blocks of a page whose intersection exceeds ``ratio`` of the smaller one.

    Blocks meet only inside a shared horizontal band, and a pair is kept in the one
    band that holds the top edge of the intersection, so pages of any length work.
    """
    box = blocks.select("doc_id", "page_number", "seq", "block_id", "x0", "y0", "x1", "y1").withColumn(
        "_band", F.explode(bands(F.col("y0"), F.col("y1"), band))
    )
    a, b = box.alias("a"), box.alias("b")
    c = F.col
    same = [c(f"a.{k}") == c(f"b.{k}") for k in ("doc_id", "page_number", "_band")]
    hit = [c("a.seq") < c("b.seq"), c("a.x0") < c("b.x1"), c("b.x0") < c("a.x1"),
           c("a.y0") < c("b.y1"), c("b.y0") < c("a.y1")]
    j = a.join(b, same + hit).where(c("a._band") == band_of(F.greatest(c("a.y0"), c("b.y0")), band))
    inter = (F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")) * (
        F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0"))
    size = lambda s: (c(f"{s}.x1") - c(f"{s}.x0")) * (c(f"{s}.y1") - c(f"{s}.y0"))
    return j.select(
        c("a.doc_id").alias("doc_id"), c("a.page_number").alias("page_number"),
        c("a.block_id").alias("block_a"), c("b.block_id").alias("block_b"),
        (inter / F.least(size("a"), size("b"))).alias("overlap"),
    ).where(c("overlap") > ratio)


def spacing(blocks: DataFrame) -> DataFrame:
    """Mean over pages of the spread of vertical gaps."""
    w = Window.partitionBy("doc_id", "page_number").orderBy("y0", "seq")
    gaps = blocks.select("doc_id", "page_number", (F.col("y0") - F.lag("y1").over(w)).alias("gap")).where("gap >= 0")
    page = gaps.groupBy("doc_id", "page_number").agg(
        F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd")
    ).where("n > 1")
    return page.groupBy("doc_id").agg(F.avg(F.expr("least(1D, sd / greatest(5D, mean))")).alias("r_spacing"))


def odd_blocks(blocks: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Blocks that look merged (tall and wordy) or split (short with few words)."""
    stats = blocks.groupBy("doc_id").agg(
        F.coalesce(F.avg(F.expr("IF(y1 - y0 > 0, y1 - y0, NULL)")), F.lit(15.0)).alias("avg_height"),
        F.max("seq").alias("max_seq"),
    )
    words = f"size({tx.sql_words('text')})"
    return join_per_doc(blocks.drop("chunk"), stats, rows=rows).select(
        "doc_id", "block_id",
        F.expr(
            f"CASE WHEN y1 - y0 > avg_height * 4 AND {words} > 60 THEN 'MERGED_LAYOUT_BLOCK' "
            f"WHEN y1 - y0 < avg_height * 0.6D AND {words} BETWEEN 1 AND 3 THEN 'SPLIT_LAYOUT_BLOCK' END"
        ).alias("code"),
    ).where("code IS NOT NULL")


def layout_score(blocks: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    base = blocks.groupBy("doc_id").agg(
        F.count("*").alias("blocks"), F.count_if(tx.is_blank(F.col("text"))).alias("empty_blocks")
    )
    pairs = overlap_pairs(blocks).groupBy("doc_id").agg(F.count("*").alias("overlapping_pairs"))
    odd = odd_blocks(blocks, rows).groupBy("doc_id").agg(F.count("*").alias("odd_blocks"))
    df = base
    for side in (pairs, odd, spacing(blocks)):
        df = df.join(dealt(side), "doc_id", "left")
    df = df.fillna(0, ["overlapping_pairs", "odd_blocks"]).fillna(0.0, ["r_spacing"])
    return df.withColumn(
        "layout_quality",
        F.expr(
            "1D - least(1D, 0.2D * empty_blocks / blocks + 0.3D * least(1D, overlapping_pairs / blocks) "
            "+ 0.2D * r_spacing + 0.3D * odd_blocks / blocks)"
        ),
    )


def semantic_score(annotated: DataFrame) -> DataFrame:
    """Needs ``semantic_conf`` and the final ``block_type``."""
    return annotated.groupBy("doc_id").agg(
        F.avg(F.coalesce("semantic_conf", F.lit(1.0))).alias("avg_semantic"),
        (F.count_if(F.col("block_type") == "UNKNOWN") / F.count("*")).alias("r_unknown"),
        F.count_if(F.coalesce("semantic_conf", F.lit(1.0)) < 0.60).alias("low_confidence"),
    ).withColumn("semantic_quality", F.expr("greatest(0D, least(1D, avg_semantic * (1 - r_unknown)))"))


def hierarchy_score(validation: DataFrame) -> DataFrame:
    return validation.select(
        "doc_id", F.col("consistency_score").alias("hierarchy_quality"), "orphan_count", "cycle_detected"
    )


def hierarchy_fallback(blocks: DataFrame) -> DataFrame:
    """Used when no validation ran: share of blocks without a parent, if there are headings."""
    loose = "parent_block_id IS NULL AND block_type NOT IN ('HEADING', 'HEADER', 'FOOTER', 'PAGE_NUMBER')"
    agg = blocks.groupBy("doc_id").agg(
        F.expr("count_if(block_type = 'HEADING')").alias("_h"), F.expr(f"count_if({loose})").alias("_o"),
        F.count("*").alias("_n"),
    )
    return agg.selectExpr(
        "doc_id", "IF(_h > 0, greatest(0D, 1D - _o / _n), 1D) AS hierarchy_quality",
        "IF(_h > 0, _o, 0L) AS orphan_count", "false AS cycle_detected",
    )


def backward_jumps(blocks: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    df = near(
        blocks.drop("chunk"),
        lambda w: {"_np": F.lead("page_number").over(w), "_ny": F.lead("y1").over(w)}, rows=rows,
    )
    return df.groupBy("doc_id").agg(
        F.expr("count_if(_np = page_number AND _ny < y0 - 200)").alias("backward_jumps")
    )


def reading_score(blocks: DataFrame, edges: DataFrame | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    jumps = backward_jumps(blocks, rows)
    if edges is None:
        jumps = jumps.withColumn("_amb", F.lit(0.0))
    else:
        flow = edges.where("edge_type IN ('READING_FLOW', 'NEXT')").groupBy("doc_id").agg(
            (F.count_if(F.col("confidence") < 0.90) / F.count("*")).alias("_amb")
        )
        jumps = jumps.join(dealt(flow), "doc_id", "left").fillna(0.0, ["_amb"])
    return jumps.withColumn(
        "reading_quality", F.expr("IF(backward_jumps > 0, greatest(0D, 1D - _amb - backward_jumps * 0.15D), 1D - _amb)")
    ).drop("_amb")


def overall(ocr: DataFrame, layout: DataFrame, semantic: DataFrame, hier: DataFrame, reading: DataFrame) -> DataFrame:
    """All scores of a document and their geometric mean."""
    df = layout
    for side in (ocr, semantic, hier, reading):
        df = df.join(dealt(side), "doc_id", "left")
    df = df.fillna(1.0, ["ocr_quality", "semantic_quality", "hierarchy_quality", "reading_quality"])
    prod = "ocr_quality * layout_quality * semantic_quality * hierarchy_quality * reading_quality"
    return df.withColumn("overall_quality", F.expr(f"greatest(0D, least(1D, pow({prod}, 0.2D)))"))


def quality_notes(scores: DataFrame, odd: DataFrame | None = None) -> DataFrame:
    """Warning and recommendation rows, one rule per entry."""
    w = lambda cond, code, sev: (cond, "warning", code, sev)
    r = lambda cond, code, sev: (cond, "recommendation", code, sev)
    review = "(layout_quality < 0.7 OR hierarchy_quality < 0.6)"
    rules = [
        w("ocr_quality < 0.75", "POOR_OCR_CONFIDENCE", "IF(ocr_quality < 0.6, 'CRITICAL', 'WARNING')"),
        w("r_garbage > 0.05", "EXCESSIVE_GARBAGE_CHARS", "'WARNING'"),
        r("ocr_quality < 0.7", "RERUN_OCR_RECOMMENDED", "'WARNING'"),
        w("overlapping_pairs > 0", "OVERLAPPING_LAYOUT_ELEMENTS", "'WARNING'"),
        w("r_spacing > 0.4", "INCONSISTENT_LAYOUT_SPACING", "'INFO'"),
        r("layout_quality < 0.7", "MANUAL_REVIEW_REQUIRED", "'WARNING'"),
        w("low_confidence > 0", "LOW_SEMANTIC_CONFIDENCE", "IF(low_confidence > blocks * 0.2D, 'WARNING', 'INFO')"),
        w("r_unknown > 0.15", "EXCESSIVE_UNKNOWN_BLOCKS", "'WARNING'"),
        w("cycle_detected", "CYCLIC_HIERARCHY_RELATIONS", "'CRITICAL'"),
        w("orphan_count > blocks * 0.1D", "LARGE_ORPHAN_COUNT", "'WARNING'"),
        r("hierarchy_quality < 0.6", "MANUAL_REVIEW_REQUIRED", "'WARNING'"),
        w("backward_jumps > 0", "BACKWARD_READING_FLOW", "'WARNING'"),
        w("reading_quality < 0.75", "AMBIGUOUS_READING_FLOW", "'WARNING'"),
        r("overall_quality < 0.6", "LOW_CONFIDENCE_FOR_AI", "'CRITICAL'"),
        r("overall_quality >= 0.85", "SUITABLE_FOR_GENERATION", "'INFO'"),
        r(f"reading_quality < 0.6 AND NOT {review}", "MANUAL_REVIEW_REQUIRED", "'WARNING'"),
    ]
    items = ", ".join(
        f"IF({c}, named_struct('kind', '{k}', 'code', '{code}', 'severity', {sev}), NULL)" for c, k, code, sev in rules
    )
    out = scores.select(
        "doc_id", F.col("doc_id").cast("string").alias("target_id"), F.expr(f"inline(array_compact(array({items})))")
    )
    if odd is not None:
        out = out.unionByName(
            odd.selectExpr(
                "doc_id", "block_id AS target_id", "'warning' AS kind", "code",
                "IF(code = 'MERGED_LAYOUT_BLOCK', 'WARNING', 'INFO') AS severity",
            )
        )
    return out
