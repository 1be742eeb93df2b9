"""Table work around recognised words: screening, layout, merge, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.geometry import bands, band_of
from .assembly import FirstPassParams, first_pass
from .ordered import dense_position
from .settle import settle

PAGE = ["doc_id", "page_number"]
BAND = 64.0


def screen_pages(pages: DataFrame, blocks: DataFrame, strategy: str = "AUTO", threshold: int = 50) -> DataFrame:
    """Pages that need recognition: all, none, or those with little text."""
    if strategy not in ("AUTO", "FORCE", "SKIP"):
        raise ValueError(strategy)
    chars = blocks.groupBy(*PAGE).agg(F.sum(F.length("text")).alias("chars"))
    rule = {"AUTO": f"coalesce(chars, 0) < {threshold}", "FORCE": "true", "SKIP": "false"}[strategy]
    return pages.select(*PAGE).join(chars, PAGE, "left").selectExpr(
        *PAGE, "coalesce(chars, 0) AS chars", f"{rule} AS needs_ocr"
    )


def words_to_blocks(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Words to lines to blocks, pixels scaled to points.

    ``words`` carry img_w and img_h; ``pages`` width and height.  A line and a block are
    what one text box of a page holds.
    """
    block = [*PAGE, "block_num"]
    lines = words.groupBy(*block, "line_num").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(x0, word_ord, text))), w -> w.text), ' ')").alias("line"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.sum(F.col("y1") - F.col("y0")).alias("_h"), F.sum("confidence").alias("_c"), F.count("*").alias("_n"),
        F.max("img_w").alias("img_w"), F.max("img_h").alias("img_h"), F.min("word_ord").alias("_first"),
    )
    b = lines.groupBy(*block).agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(line_num, line))), l -> l.line), '\\n')").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        (F.sum("_h") / F.sum("_n")).alias("_height"), (F.sum("_c") / F.sum("_n")).alias("ocr_confidence"),
        F.max("img_w").alias("img_w"), F.max("img_h").alias("img_h"), F.min("_first").alias("block_ord"),
    )
    b = b.withColumn("text", F.expr(tx.sql_strip("text"))).where("text <> ''").join(
        pages.select(*PAGE, F.col("width").alias("page_width"), F.col("height").alias("page_height")), PAGE
    )
    sx = F.expr("IF(img_w > 0, page_width / img_w, 1D)")
    sy = F.expr("IF(img_h > 0, page_height / img_h, 1D)")
    b = b.withColumns(
        {
            "x0": F.col("x0") * sx, "x1": F.col("x1") * sx, "y0": F.col("y0") * sy, "y1": F.col("y1") * sy,
            "font_size": F.col("_height") * sy, "font_family": F.lit("OCR-Tesseract"),
            "bold": F.lit(False), "italic": F.lit(False), "provenance": F.lit("OCR"),
        }
    ).drop("_height", "img_w", "img_h")
    # Numbering reads the blocks twice: stored, so that words are grouped once.
    return dense_position(settle(b), ["block_ord"]).withColumn(
        "block_id", F.sha2(F.concat_ws(":", F.lit("ocr"), F.col("doc_id").cast("string"), "page_number", "block_num"), 256)
    )


def classified_words(blocks: DataFrame, p: FirstPassParams = FirstPassParams()) -> DataFrame:
    """First-pass type of recognised pages, each judged by the pages up to it; confidence is word
    confidence times class confidence, 3 digits."""
    return first_pass(blocks, p, by_page=True).withColumn(
        "confidence", F.round(F.col("ocr_confidence") * F.col("class_confidence"), 3)
    )


def overlap_candidates(native: DataFrame, ocr: DataFrame, ratio: float = 0.40, band: float = BAND) -> DataFrame:
    """(doc, page, n_seq, o_seq) of pairs whose intersection exceeds ``ratio`` of the smaller box."""
    box = lambda df, p: df.select(*PAGE, F.col("seq").alias(f"{p}_seq"), *[F.col(c).alias(p + c) for c in ("x0", "y0", "x1", "y1")]
                                  ).withColumn("_band", F.explode(bands(F.col(p + "y0"), F.col(p + "y1"), band)))
    w, h = "(least(nx1, ox1) - greatest(nx0, ox0))", "(least(ny1, oy1) - greatest(ny0, oy0))"
    j = box(native, "n").join(box(ocr, "o"), [*PAGE, "_band"]).where(f"{w} > 0 AND {h} > 0").where(
        F.col("_band") == band_of(F.greatest("ny0", "oy0"), band)
    )
    small = "least((nx1 - nx0) * (ny1 - ny0), (ox1 - ox0) * (oy1 - oy0))"
    return j.where(f"{small} > 0 AND {w} * {h} / {small} > {ratio}").select(*PAGE, "n_seq", "o_seq")


def greedy_pairs(cands: DataFrame) -> DataFrame:
    """The pairs a serial pass over native blocks would take.

    A pair is final when the OCR block is the native block's first free candidate and the
    native block is the first unmatched one among all candidates of the OCR block.  The
    first unmatched native block of a page always qualifies, so every round makes progress.
    """
    left, done = settle(cands.distinct()), None
    while not left.isEmpty():
        first_o = left.groupBy(*PAGE, "n_seq").agg(F.min("o_seq").alias("o_seq"))
        first_n = left.groupBy(*PAGE, "o_seq").agg(F.min("n_seq").alias("n_seq"))
        final = settle(first_o.join(first_n, [*PAGE, "n_seq", "o_seq"]))
        done = final if done is None else done.unionByName(final)
        left = settle(
            left.join(final.select(*PAGE, "n_seq"), [*PAGE, "n_seq"], "left_anti")
            .join(final.select(*PAGE, "o_seq"), [*PAGE, "o_seq"], "left_anti")
        )
    return done if done is not None else cands.limit(0)


def merge_layers(native: DataFrame, ocr: DataFrame, ratio: float = 0.40) -> DataFrame:
    """Native and OCR blocks of the same pages with duplicates resolved by confidence; ties keep native."""
    pairs = settle(greedy_pairs(overlap_candidates(native, ocr, ratio)))
    cols = [*PAGE, "seq", "block_id", "text", "x0", "y0", "x1", "y1", "confidence", "provenance", "reading_order"]
    n, o = native.select(*cols), ocr.select(*cols)
    oc = pairs.join(o.select(*PAGE, F.col("seq").alias("o_seq"), F.struct(*cols[2:]).alias("_o")), [*PAGE, "o_seq"]).select(
        *PAGE, F.col("n_seq").alias("seq"), "_o")
    kept = n.join(oc, [*PAGE, "seq"], "left").withColumn(
        "_pick", F.expr(f"IF(_o IS NOT NULL AND _o.confidence > confidence, _o, struct({', '.join(cols[2:])}))")
    ).select(
        *PAGE, F.col("seq").alias("insert_ord"), *[F.col(f"_pick.{c}").alias(c) for c in cols[3:] if c != "provenance"],
        F.expr("IF(_o IS NULL, provenance, 'MERGED')").alias("provenance"), F.lit(0).alias("layer"),
    )
    rest = o.join(pairs.select(*PAGE, F.col("o_seq").alias("seq")), [*PAGE, "seq"], "left_anti").select(
        *PAGE, F.col("seq").alias("insert_ord"), *[c for c in cols[3:] if c != "provenance"], "provenance", F.lit(1).alias("layer")
    )
    return kept.unionByName(rest)


def renumber(merged: DataFrame) -> DataFrame:
    """Document-wide reading order from 1 by page, page order and insertion order."""
    df = dense_position(merged.withColumnRenamed("reading_order", "_ro"), ["_ro", "layer", "insert_ord"], out="reading_order", start=1)
    return df.withColumn("reading_order", F.col("reading_order").cast("int")).drop("_ro")


def page_confidence(merged: DataFrame, screened: DataFrame) -> DataFrame:
    """Average confidence of blocks still marked OCR; 1.0 where there are none or OCR did not run."""
    conf = merged.where("provenance = 'OCR'").groupBy(*PAGE).agg(F.avg("confidence").alias("_c"))
    return screened.select(*PAGE, "needs_ocr").join(conf, PAGE, "left").select(
        *PAGE, "needs_ocr", F.expr("IF(needs_ocr, round(coalesce(_c, 1D), 3), 1D)").alias("page_confidence")
    )


def document_confidence(page_conf: DataFrame) -> DataFrame:
    return page_conf.groupBy("doc_id").agg(F.round(F.avg("page_confidence"), 3).alias("ocr_confidence"))


def word_statistics(words: DataFrame) -> DataFrame:
    return words.groupBy(*PAGE).agg(
        F.count("*").alias("word_count"), F.round(F.avg("confidence"), 3).alias("average_word_confidence"),
        F.round(F.min("confidence"), 3).alias("min_word_confidence"),
        F.count_if(F.col("confidence") < 0.6).alias("low"),
        F.count_if((F.col("confidence") >= 0.6) & (F.col("confidence") < 0.85)).alias("medium"),
        F.count_if(F.col("confidence") >= 0.85).alias("high"),
    )


def ocr_status(page_runs: DataFrame) -> DataFrame:
    """``page_runs``: doc_id, outcome (done, failed or skipped) per page."""
    n = page_runs.groupBy("doc_id").agg(
        *[F.expr(f"count_if(outcome = '{o}')").alias(o) for o in ("done", "failed", "skipped")]
    )
    return n.withColumn(
        "ocr_status", F.expr("CASE WHEN done = 0 THEN 'skipped' WHEN failed > 0 THEN 'failed' ELSE 'completed' END")
    )
