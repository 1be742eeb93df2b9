"""The end-to-end jobs: each stage is written once and read by everything after it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify as cl
from ..operators import features as ft
from ..operators import hierarchy as hi
from ..operators import order as ro
from ..operators.ordered import CHUNK_ROWS
from ..operators.settle import discard, settle


#: What the passes see of the rows beside a block, its stripped text, and the ratios that no rule
#: reads (``features.extract`` has them for its own users): not computed, stored or moved on here.
PASSING = ["t", *[f"{side}_{c}" for side in ("prev", "next") for c in ft.BESIDE], *ft.UNRULED]
#: How a block came to its type; stored with the classified blocks, of no use above them.
REASONS = ["contributors", "semantic_module", "weighted_sum", "c2_conf", "c5_type", "c6_type", "c7_type", "dominant_size", "dominant_indent",
           *[f"sig_{k}" for k in cl.SIGNALS], *ft.DERIVED]


PAGE = ["doc_id", "page_number"]


def _ordered(blocks: DataFrame) -> DataFrame:
    """Blocks in reading order, which is told by HEADER, FOOTER and PAGE_NUMBER alone. The heading pass
    replaces every type and gives none of them, so the order does not wait for it."""
    plain = blocks.withColumnRenamed("block_type", "_type").withColumn("block_type", F.lit("PARAGRAPH"))
    return ro.reading_order(plain).drop("block_type").withColumnRenamed("_type", "block_type")


def classified(blocks: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Features, heading pass, reading order, then the rule passes on the new order; stored.

    The texts are dealt out once, by page: per-document values come to where the rows are, found
    on rows without texts, and only headings are dealt out for their levels."""
    scored = cl.heading_scores(ft.extract(blocks, rows, by_page=True), rows=rows, dealt_by=PAGE).drop(*PASSING)
    lengths = blocks.withColumn("text", F.coalesce("text", F.lit(""))).transform(ft.typography).transform(ft.geometry).transform(ft.statistics)
    keys = _ordered(lengths.select(
        *PAGE, "seq", "block_type", "x0", "y0", "x1", "y1", "page_width", "page_height", "f_size", "char_count", "margin_left"))
    ruled = cl.list_quote_note(_ordered(scored), rows, PAGE, keys)
    done = settle(cl.annotate(cl.code_formula(cl.table_caption(ruled))).drop(*PASSING))
    is_head = F.col("block_type") == "HEADING"
    rest = done.where(~is_head).withColumn("heading_level", F.lit(None).cast("int"))
    out = settle(rest.unionByName(cl.heading_levels(done.where(is_head), rows=rows).select(*rest.columns)))
    discard(done)
    return out


def structured(classified_blocks: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Classified blocks, stored, with their place in the section hierarchy."""
    return hi.hierarchy(classified_blocks.drop("chunk", *REASONS), rows)


_stages: dict[tuple[str, str, str], DataFrame] = {}


def stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage table of this session: built and written at first use, then only read."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stages:
        rows = build()
        _stages[key] = rows if "settled_at" in vars(rows) else settle(rows)
    return _stages[key]


def forget(spark: SparkSession) -> None:
    """Drop the stage tables of this session, so that the next use builds them again."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _stages if k[0] == app]:
        discard(_stages.pop(key))
