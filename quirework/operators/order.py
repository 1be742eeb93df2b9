"""Reading order: column layout per page, then one dense order per document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import CHUNK_ROWS, dense_position, near


@dataclass(frozen=True)
class ColumnRule:
    """How blocks are told apart; expressions over x0, x1, y0, y1, w, h and block_type."""

    head: str
    foot: str
    spanning: str
    margin_by_x: bool


RESOLVER = ColumnRule(
    head="block_type = 'HEADER'",
    foot="block_type IN ('FOOTER', 'PAGE_NUMBER')",
    spanning="(x1 - x0) > w * 0.7D OR (x0 < w * 0.3D AND x1 > w * 0.7D)",
    margin_by_x=True,
)
FIRST_PASS = ColumnRule(
    head="y1 <= 60",
    foot="y0 >= h - 60",
    spanning="x0 < w / 3 AND x1 > 2 * w / 3",
    margin_by_x=False,
)


def column_keys(blocks: DataFrame, rule: ColumnRule = RESOLVER, width: float = 600.0, height: float = 800.0) -> DataFrame:
    """Sort keys of every block inside its page, and its column index."""
    e = F.expr
    df = blocks.withColumns(
        {"w": e(f"coalesce(page_width, {width}D)"), "h": e(f"coalesce(page_height, {height}D)")}
    ).withColumn("_zone", e(f"CASE WHEN {rule.head} THEN 0 WHEN {rule.foot} THEN 2 ELSE 1 END"))
    df = df.withColumn(
        "_side",
        e(f"CASE WHEN _zone <> 1 THEN NULL WHEN {rule.spanning} THEN 2 WHEN (x0 + x1) / 2 < w / 2 THEN 0 ELSE 1 END"),
    )
    page = Window.partitionBy("doc_id", "page_number")
    down = page.orderBy("y0").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # A column block comes after every full-width block that starts at or above it.
    df = df.withColumns(
        {
            "_two": e("_zone = 1") & (F.max(e("_side = 0")).over(page)) & (F.max(e("_side = 1")).over(page)),
            "_above": F.count_if(e("_side = 2")).over(down),
        }
    )
    by_x = "true" if rule.margin_by_x else "_zone = 1"
    return df.withColumns(
        {
            "_two": e("coalesce(_two, false)"),
            "_seg": e("CASE WHEN coalesce(_two, false) THEN _above - IF(_side = 2, 1, 0) ELSE 0 END"),
            "_rank": e("CASE WHEN coalesce(_two, false) THEN _side ELSE 0 END"),
            "_x": e(f"CASE WHEN NOT coalesce(_two, false) AND {by_x} THEN x0 ELSE 0D END"),
            "column_index": e("CASE WHEN coalesce(_two, false) AND _side = 1 THEN 1 ELSE 0 END"),
        }
    ).drop("_above", "_two", "_side", "w", "h")


ORDER = ["_zone", "_seg", "_rank", "y0", "_x", "_old"]
_TMP = ["_zone", "_seg", "_rank", "_x", "_old"]


def reading_order(blocks: DataFrame, rule: ColumnRule = RESOLVER) -> DataFrame:
    """Redefine ``seq`` and ``reading_order`` by layout; the parser order is kept."""
    df = column_keys(blocks.drop("chunk"), rule).withColumnRenamed("seq", "_old")
    keep = F.col("original_parser_order") if "original_parser_order" in blocks.columns else F.col("_old")
    df = dense_position(df.withColumn("original_parser_order", keep), ORDER)
    return df.withColumns(
        {
            "reading_order": F.col("seq").cast("int"),
            "order_confidence": F.expr(
                "CASE WHEN block_type IN ('HEADER', 'FOOTER', 'PAGE_NUMBER') THEN 0.99D ELSE 0.95D END"
            ),
        }
    ).drop(*_TMP)


def reading_links(ordered: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Previous and next block across page boundaries."""
    return near(
        ordered,
        lambda w: {
            "previous_block_id": F.lag("block_id").over(w),
            "next_block_id": F.lead("block_id").over(w),
        },
        rows=rows,
    )


def first_pass_order(blocks: DataFrame, rule: ColumnRule = FIRST_PASS) -> DataFrame:
    """Page-local order from 0 and page-local links, as parsing leaves them."""
    df = column_keys(blocks, rule, 595.0, 842.0).withColumn("_old", F.col("seq"))
    w = Window.partitionBy("doc_id", "page_number").orderBy(*ORDER)
    return df.withColumns(
        {
            "original_parser_order": (F.row_number().over(
                Window.partitionBy("doc_id", "page_number").orderBy("seq")) - 1).cast("int"),
            "reading_order": (F.row_number().over(w) - 1).cast("int"),
            "previous_block_id": F.lag("block_id").over(w),
            "next_block_id": F.lead("block_id").over(w),
        }
    ).drop(*_TMP)
