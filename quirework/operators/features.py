"""Per-block features: typography, geometry, layout, statistics and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .ordered import CHUNK_ROWS, near

HEIGHT = "coalesce(nullif(page_height, 0D), 842D)"
WIDTH = "coalesce(nullif(page_width, 0D), 595D)"


BESIDE = ("block_id", "text", "font_size", "block_type", "page_number", "y0", "y1")
#: Features no classification rule reads, and those that only these rules read.
UNRULED = (
    "aspect_ratio", "line_spacing", "uppercase_ratio", "lowercase_ratio", "digit_ratio", "symbol_ratio", "avg_word_length", "text_density",
)
DERIVED = (
    "f_size", "f_family", "f_bold", "f_italic", "all_caps", "title_case", "starts_capital", "ends_punct", "width", "height",
    "page_position_y", "margin_right", "alignment", "is_at_top", "is_at_bottom", "space_above", "space_below", "char_count",
    "word_count", "punctuation_ratio",
)


def _exprs(df: DataFrame, items: dict[str, str]) -> DataFrame:
    return df.withColumns({k: F.expr(v) for k, v in items.items()})


def typography(df: DataFrame) -> DataFrame:
    U, L = tx.UPPER, tx.LOWER
    broken = rf"[{tx.CASED}][{U}\p{{Lt}}]|(?:^|[^{tx.CASED}])[{L}]"
    upper = tx.sql_rlike("text", f"[{U}]")
    return _exprs(df, {
        "f_size": "coalesce(nullif(font_size, 0D), 10D)",
        "f_family": "coalesce(nullif(font_family, ''), 'Sans-serif')",
        "f_bold": "coalesce(bold, false)",
        "f_italic": "coalesce(italic, false)",
        "all_caps": f"{upper} AND NOT " + tx.sql_rlike("text", rf"[{L}\p{{Lt}}]"),
        "title_case": tx.sql_rlike("text", rf"[{U}\p{{Lt}}]") + " AND NOT " + tx.sql_rlike("text", broken),
        "starts_capital": tx.sql_rlike("left(text, 1)", f"[{U}]"),
        "ends_punct": f"right({tx.sql_strip('text')}, 1) IN ('.', '!', '?', ';', ':', ',')",
    })


def geometry(df: DataFrame) -> DataFrame:
    out = _exprs(df, {
        "width": "x1 - x0",
        "height": "y1 - y0",
        "page_position_y": f"y0 / {HEIGHT}",
        "margin_left": "x0",
        "margin_right": f"{WIDTH} - x1",
    })
    return _exprs(out, {
        "aspect_ratio": "CASE WHEN height > 0 THEN width / height ELSE 0D END",
        "alignment": "CASE WHEN abs(margin_left - margin_right) < 15 AND margin_left > 40 THEN 'center' ELSE 'left' END",
    })


def context(df: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Previous and next block in document order, plus the gaps to them on the same page."""

    def look(w):
        prev = {f"prev_{c}": F.lag(c).over(w) for c in BESIDE}
        return prev | {f"next_{c}": F.lead(c).over(w) for c in BESIDE}

    return near(df, look, rows=rows)


def page_context(df: DataFrame) -> DataFrame:
    """The same for rows dealt out by page: a neighbour is given where it is on the same page, and is
    left null where the place beside the block belongs to another one, which no layout rule tells apart."""
    w = Window.partitionBy("doc_id", "page_number").orderBy("seq")
    beside = {
        f"{side}_{c}": F.when(F.abs(at("seq").over(w) - F.col("seq")) <= 1, at(c).over(w))
        for side, at in (("prev", F.lag), ("next", F.lead)) for c in BESIDE
    }
    return df.withColumns(beside)


def layout(df: DataFrame) -> DataFrame:
    """Needs the neighbour columns of ``context``."""
    return _exprs(df, {
        "is_at_top": "NOT coalesce(prev_page_number = page_number, false)",
        "is_at_bottom": "NOT coalesce(next_page_number = page_number, false)",
        "space_above": "CASE WHEN prev_page_number = page_number THEN greatest(0D, y0 - prev_y1) ELSE 0D END",
        "space_below": "CASE WHEN next_page_number = page_number THEN greatest(0D, next_y0 - y1) ELSE 0D END",
        "line_spacing": r"(y1 - y0) / (1 + length(text) - length(replace(text, '\n', '')))",
    })


def statistics(df: DataFrame) -> DataFrame:
    n = "char_count"
    ratio = lambda cls: f"CASE WHEN {n} > 0 THEN {tx.sql_count('text', cls)} / CAST({n} AS DOUBLE) ELSE 0D END"
    out = _exprs(df, {
        n: "length(text)",
        "word_count": f"size({tx.sql_words('text')})",
    })
    return _exprs(out, {
        "uppercase_ratio": ratio(tx.UPPER),
        "lowercase_ratio": ratio(tx.LOWER),
        "digit_ratio": ratio(r"\p{Nd}\u00B2\u00B3\u00B9\u2070\u2074-\u2079\u2080-\u2089"),
        "punctuation_ratio": ratio(r".,!?;:\x22\x27()\[\]{}"),
        "symbol_ratio": f"CASE WHEN {n} > 0 THEN length(regexp_replace(text, r'[{tx.ALNUM}{tx.BLANK_CLASS}]+', ''))"
                        f" / CAST({n} AS DOUBLE) ELSE 0D END",
        "avg_word_length": f"CASE WHEN word_count > 0 THEN length(regexp_replace(text, r'[{tx.BLANK_CLASS}]+', ''))"
                           " / CAST(word_count AS DOUBLE) ELSE 0D END",
        "text_density": f"CASE WHEN (x1 - x0) * (y1 - y0) > 0 THEN {n} / ((x1 - x0) * (y1 - y0)) ELSE 0D END",
    })


def extract(blocks: DataFrame, rows: int = CHUNK_ROWS, by_page: bool = False) -> DataFrame:
    """All five groups; neighbours first, so the text work runs on the shuffled rows, which are dealt
    out by chunk, or by page (see ``page_context``)."""
    df = blocks.withColumn("text", F.coalesce("text", F.lit("")))
    return (page_context(df) if by_page else context(df, rows)).transform(typography).transform(geometry).transform(layout).transform(statistics)


def fingerprint(blocks: DataFrame) -> DataFrame:
    """Digest of content and geometry; equal digests need no new features."""
    num = lambda c: f"cast({c} AS string)"
    flag = lambda c: f"initcap(cast({c} AS string))"
    sig = (
        "concat(block_id, ':', coalesce(text, ''), ':', "
        f"{num('x0')}, ',', {num('y0')}, ',', {num('x1')}, ',', {num('y1')}, ':', "
        f"coalesce(font_family, 'None'), ':', coalesce({num('font_size')}, 'None'), ':', "
        f"{flag('bold')}, ':', {flag('italic')})"
    )
    return blocks.withColumn("fingerprint", F.expr(f"sha2({sig}, 256)"))


def changed_blocks(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """Blocks whose fingerprint is not among the stored ones: the incremental work list."""
    return fingerprint(blocks).join(known.select("fingerprint"), "fingerprint", "left_anti")
