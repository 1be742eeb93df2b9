"""Block classification: heading score, then lists, notes, quotes, tables, code, formulas.

Every rule is a column expression.  Document-wide statistics are small per-document
rows, copied per chunk so that they join without skew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .ordered import CHUNK_ROWS, join_per_doc

SIGNALS = ("size", "bold", "length", "case", "punctuation", "numbering", "spacing", "alignment")
_P = tx.portable
# The patterns of the classification rules.
NUMBERING = _P(r"^(?:(?i:chapter\s+\d+|part\s+[ivx\d]+|section\s+\d+|lesson\s+\d+)|\d+(?:\.\d+)*\s+[A-Z])")
BULLET = _P(
    r"^[\u2022\u25e6\u25aa\u25ab\u25ca\u25cb\u25cf\u25d8\u2023\u2043\u25c9\u25c8\u25a0\u25c6"
    r"\-*\u2726\u27a2\u00b6]\s+"
)
NUMBERED = _P(r"^(?:\d+(?:\.\d+)*|[a-zA-Z]|[ivxldcmIVXLDCM]+)[.)]\s+")
ENCLOSED = _P(r"^\((?:\d+|[a-zA-Z]|[ivxldcmIVXLDCM]+)\)\s+")
FOOTNOTE_MARK = _P(r"^(?:\d+|[*\u2020\u2021\u00a7\u00b6])\s+[A-Za-z]")
NOTE_WORD = _P(r"^(?i:note|footnote|source|tip|warning|notice):\s+")
CAPTION = _P(r"^(?i:figure|fig|table|map|chart|illustration|diagram)\s+\d+")
MONO_FONT = r"(?i)courier|consolas|mono|menlo|dejavu|lucida"
CODE_WORD = (
    r"(?<![\p{L}\p{N}_])(?:def|import|class|function|return|let|const|var|public|private|void|struct|package"
    r"|namespace)(?![\p{L}\p{N}_])"
)
LATEX_WRAP = r"(?s)^\$\$.*\$\$$|^\\\[.*\\\]$|^\\\(.*\\\)$"
MATH_TOKEN = r"\\[a-zA-Z]+(?![\p{L}\p{N}_])|[+\-*/^=<>~]"
#: Every token has one of these.
MATH_SIGN = r"[\\+\-*/^=<>~]"


@dataclass(frozen=True)
class HeadingParams:
    size: float = 1.5
    bold: float = 1.0
    length: float = 0.8
    case: float = 0.6
    punctuation: float = 1.2
    numbering: float = 1.0
    spacing: float = 0.8
    alignment: float = 0.6
    heading_at: float = 0.65
    unknown_below: float = 0.35

    @property
    def total(self) -> float:
        return sum(abs(getattr(self, s)) for s in SIGNALS)


def dominant(df: DataFrame, items: dict[str, tuple[str, str]]) -> DataFrame:
    """Per document the value with the largest summed weight; the first seen wins a tie.

    ``items`` maps an output name to (value expression, weight expression).  All of them
    are found in one grouped pass, pre-aggregated per task.
    """
    pairs = ", ".join(f"'{k}', CAST({v} AS DOUBLE), CAST({w} AS BIGINT)" for k, (v, w) in items.items())
    sums = (
        df.selectExpr("doc_id", "seq", f"stack({len(items)}, {pairs}) AS (k, v, w)")
        .groupBy("doc_id", "k", "v").agg(F.sum("w").alias("w"), F.min("seq").alias("first"), F.max("seq").alias("m"))
    )
    best = [F.expr(f"max_by(v, struct(w, -first)) FILTER (WHERE k = '{k}')").alias(k) for k in items]
    return sums.groupBy("doc_id").agg(F.max("m").alias("max_seq"), *best)


def with_dominant(df: DataFrame, items: dict[str, tuple[str, str]], rows: int = CHUNK_ROWS, dealt_by: list[str] | None = None,
                  keys: DataFrame | None = None) -> DataFrame:
    """``dealt_by`` are columns, doc_id first, that ``df`` is already partitioned by: the values are
    copied to each of their groups, and the rows stay where they are. ``keys`` are the same rows
    without texts, where ``df`` itself is dear to read twice."""
    if dealt_by:
        narrow = df if keys is None else keys
        side = dominant(narrow, items).drop("max_seq").join(narrow.select(*dealt_by).distinct(), "doc_id")
        return df.join(side, dealt_by, "left")
    return join_per_doc(df, dominant(df, items), rows=rows)


SIZE_BY_CHARS = {"dominant_size": ("f_size", "char_count")}


def signal_sql(d: str = "d") -> dict[str, str]:
    last = "right(t, 1) IN ('.', '?', '!')"
    gap = lambda c: f"CASE WHEN {c} > 25 THEN 0.5D WHEN {c} > 15 THEN 0.25D ELSE 0D END"
    return {
        "size": f"CASE WHEN {d} > 4.5 THEN 1D WHEN {d} > 2 THEN 0.6D WHEN abs({d}) <= 0.75 THEN -0.5D "
                f"WHEN {d} < -1 THEN -0.8D ELSE 0D END",
        "bold": "CASE WHEN f_bold THEN 0.8D ELSE -0.5D END",
        "length": "CASE WHEN word_count < 8 AND NOT ends_punct THEN 0.8D WHEN word_count < 15 THEN 0.4D "
                  "WHEN word_count > 30 THEN -1D ELSE 0D END",
        "case": "CASE WHEN all_caps THEN 0.8D WHEN title_case THEN 0.4D WHEN starts_capital THEN 0.2D ELSE -0.3D END",
        "punctuation": f"CASE WHEN ends_punct AND {last} THEN -0.6D WHEN punctuation_ratio > 0.15 THEN -0.5D "
                       "ELSE 0.3D END",
        "numbering": f"CASE WHEN {tx.sql_rlike('t', NUMBERING)} THEN 1D ELSE 0D END",
        "spacing": f"{gap('space_above')} + {gap('space_below')}",
        "alignment": "CASE WHEN alignment = 'center' THEN 0.6D ELSE 0D END",
    }


def heading_scores(features: DataFrame, p: HeadingParams = HeadingParams(), rows: int = CHUNK_ROWS,
                   dealt_by: list[str] | None = None) -> DataFrame:
    """Weighted signals, confidence and first type; existing types are replaced."""
    df = with_dominant(features, SIZE_BY_CHARS, rows, dealt_by).withColumns(
        {"t": F.expr(tx.sql_strip("text")), "d": F.expr("f_size - dominant_size")}
    )
    df = df.withColumns({f"sig_{k}": F.expr(f"({v}) * {getattr(p, k)}D") for k, v in signal_sql().items()})
    total = " + ".join(f"sig_{k}" for k in SIGNALS)
    df = df.withColumn("weighted_sum", F.expr(total))
    scored = f"greatest(0D, least(1D, (weighted_sum / {p.total}D + 1) / 2))"
    alnum = tx.sql_rlike("t", f"[{tx.ALNUM}]")
    df = df.withColumn("c2_conf", F.expr(f"CASE WHEN t = '' THEN 1D WHEN NOT {alnum} THEN 0D ELSE {scored} END"))
    kind = (
        f"CASE WHEN t = '' OR NOT {alnum} THEN 'UNKNOWN' WHEN c2_conf >= {p.heading_at}D THEN 'HEADING' "
        f"WHEN c2_conf < {p.unknown_below}D THEN 'UNKNOWN' ELSE 'PARAGRAPH' END"
    )
    return df.withColumn("block_type", F.expr(kind)).drop("d")


def heading_levels(scored: DataFrame, size: str = "f_size", out: str = "heading_level",
                   rows: int = CHUNK_ROWS) -> DataFrame:
    """Rank of the heading size in its document, largest first, at most 6."""
    sizes = scored.where("block_type = 'HEADING'").groupBy("doc_id", F.col(size).alias("_s")).agg(
        F.max("seq").alias("m")
    )
    # Only the five largest sizes can give a level below 6.
    w = Window.partitionBy("doc_id").orderBy(F.desc("_s"))
    top = sizes.withColumn("_rn", F.row_number().over(w)).where("_rn <= 5")
    largest = top.groupBy("doc_id").agg(F.sort_array(F.collect_list("_s"), asc=False).alias("_sizes"))
    last = sizes.groupBy("doc_id").agg(F.max("m").alias("max_seq"))
    level = f"CASE WHEN block_type = 'HEADING' THEN coalesce(nullif(array_position(_sizes, {size}), 0), 6) END"
    return (
        join_per_doc(scored, largest.join(last, "doc_id"), rows=rows)
        .withColumn(out, F.expr(f"CAST({level} AS INT)"))
        .drop("_sizes")
    )


MARGINS = {
    "dominant_indent": ("bround(margin_left / 5, 0) * 5", "1"),
    "dominant_margin_right": ("bround(margin_right / 5, 0) * 5", "1"),
}
# Types a later pass leaves alone.
KEPT = "('HEADING', 'HEADER', 'FOOTER', 'PAGE_NUMBER')"
BEFORE_TABLES = "('HEADING', 'HEADER', 'FOOTER', 'PAGE_NUMBER', 'LIST', 'QUOTE', 'FOOTNOTE', 'NOTE')"
BEFORE_CODE = BEFORE_TABLES[:-1] + ", 'TABLE', 'CAPTION')"


def list_quote_note(df: DataFrame, rows: int = CHUNK_ROWS, dealt_by: list[str] | None = None, keys: DataFrame | None = None) -> DataFrame:
    """NOTE, FOOTNOTE, LIST and QUOTE; the first rule that fits wins.  Adds ``c5_type``."""
    if "dominant_size" in df.columns:
        df = df.drop("dominant_size")
    df = with_dominant(df, SIZE_BY_CHARS | {"dominant_indent": MARGINS["dominant_indent"]}, rows, dealt_by, keys)
    df = df.withColumn("t", F.expr(tx.sql_strip("text")))
    r = lambda p: tx.sql_rlike("t", p)
    wrapped = " OR ".join(
        f"(startswith(t, '{a}') AND endswith(t, '{b}'))"
        for a, b in (("\u201c", "\u201d"), ('"', '"'), ("\u2018", "\u2019"))
    )
    indented = "margin_left > dominant_indent + 15"
    rule = f"""CASE
        WHEN block_type IN {KEPT} OR t = '' THEN NULL
        WHEN {r(NOTE_WORD)} THEN 'NOTE'
        WHEN page_position_y > 0.75 AND f_size <= dominant_size - 1.5
             AND ({r(FOOTNOTE_MARK)} OR {tx.sql_rlike('left(t, 1)', _P(chr(92) + 'd'))}) THEN 'FOOTNOTE'
        WHEN {r(BULLET)} OR {r(NUMBERED)} OR {r(ENCLOSED)} THEN 'LIST'
        WHEN {wrapped} OR ({indented} AND margin_right > 80) OR (f_italic AND {indented}) THEN 'QUOTE'
        END"""
    return df.withColumn("c5_type", F.expr(rule)).withColumn("block_type", F.expr("coalesce(c5_type, block_type)"))


def table_caption(df: DataFrame) -> DataFrame:
    """CAPTION by prefix and number, TABLE by columns in at least half of the lines.  Adds ``c6_type``."""
    lines = f"filter(transform(split(text, r'\\n', -1), x -> {tx.sql_strip('x')}), x -> x != '')"
    columns = tx.sql_rlike("x", f"[{tx.BLANK_CLASS}]{{3,}}")
    grid = f"size(filter({lines}, x -> {columns} OR contains(x, '|')))"
    rule = f"""CASE
        WHEN block_type IN {BEFORE_TABLES} OR t = '' THEN NULL
        WHEN {tx.sql_rlike('t', CAPTION)} THEN 'CAPTION'
        WHEN NOT contains(t, '\\n') THEN NULL
        WHEN {grid} >= 2 AND {grid} >= size({lines}) * 0.5D THEN 'TABLE'
        END"""
    df = df.withColumn("t", F.expr(tx.sql_strip("text")))
    return df.withColumn("c6_type", F.expr(rule)).withColumn("block_type", F.expr("coalesce(c6_type, block_type)"))


def code_formula(df: DataFrame) -> DataFrame:
    """CODE and EQUATION from font, keywords and sign density.  Adds ``c7_type``."""
    df = df.withColumn("t", F.expr(tx.sql_strip("text")))
    df = df.withColumns(
        {
            "_open": F.expr(f"NOT coalesce(block_type IN {BEFORE_CODE}, false) AND t <> ''"),
            "_mono": F.expr(tx.sql_rlike("coalesce(f_family, '')", MONO_FONT)),
            "_syntax": F.expr("length(t) - length(replace(replace(replace(t, '{'), '}'), ';'))"),
        }
    )
    # Texts are searched only where the answer can make a difference: no text holds more tokens than signs of them.
    df = df.withColumns(
        {
            "_word": F.expr(f"IF(_open AND (_mono OR _syntax / nullif(length(t), 0) > 0.05D), {tx.sql_rlike('t', CODE_WORD)}, false)"),
            "_most": F.expr(f"IF(_open, length(t) - length(regexp_replace(t, r'{MATH_SIGN}+', '')), 0)"),
        }
    ).withColumns(
        {
            "_tokens": F.expr(f"IF(_most >= 3 AND _most / nullif(word_count, 0) > 0.8D, regexp_count(t, r'{MATH_TOKEN}'), 0)"),
            # Signs the density rule counts: everything that is no letter, or a digit 0-9.
            "_signs": F.expr(f"IF(_open AND length(t) < 100, length(regexp_replace(t, r'[{tx.ALNUM}&&[^0-9]]+', '')), 0)"),
        }
    )
    rule = f"""CASE
        WHEN block_type IN {BEFORE_CODE} OR t = '' THEN NULL
        WHEN (_mono AND _word) OR (_mono AND _syntax >= 2) OR (_word AND _syntax / length(t) > 0.05D) THEN 'CODE'
        WHEN {tx.sql_rlike('t', LATEX_WRAP)} OR (_tokens >= 3 AND word_count > 0 AND _tokens / word_count > 0.8D)
             OR (_signs / length(t) > 0.85D AND length(t) < 100) THEN 'EQUATION'
        END"""
    df = df.withColumn("c7_type", F.expr(rule)).withColumn("block_type", F.expr("coalesce(c7_type, block_type)"))
    return df.drop("_open", "_mono", "_word", "_syntax", "_most", "_tokens", "_signs")


# Confidence of the rule-based passes.
RULE_CONFIDENCE = {
    "NOTE": 0.95, "FOOTNOTE": 0.90, "LIST": 0.95, "QUOTE": 0.85,
    "CAPTION": 0.95, "TABLE": 0.90, "CODE": 0.90, "EQUATION": 0.95,
}


def annotate(df: DataFrame) -> DataFrame:
    """The annotation a block ends up with: type, confidence, module and contributors."""
    conf = "CASE coalesce(c7_type, c6_type, c5_type) " + " ".join(
        f"WHEN '{k}' THEN {v}D" for k, v in RULE_CONFIDENCE.items()
    ) + " ELSE c2_conf END"
    sigs = ", ".join(f"'{k}', sig_{k}" for k in SIGNALS)
    df = df.withColumn("semantic_conf", F.expr(conf))
    return df.withColumns(
        {
            "semantic_module": F.expr(
                "CASE WHEN c7_type IS NOT NULL THEN 'CODE_FORMULA_DETECTION_MODULE' "
                "WHEN c6_type IS NOT NULL THEN 'TABLE_CAPTION_DETECTION_MODULE' "
                "WHEN c5_type IS NOT NULL THEN 'LIST_QUOTE_NOTE_DETECTION_MODULE' ELSE 'HEADING_DETECTION_MODULE' END"
            ),
            "contributors": F.expr(
                "CASE WHEN coalesce(c7_type, c6_type, c5_type) IS NOT NULL THEN map('pattern', semantic_conf) "
                f"ELSE map({sigs}) END"
            ),
        }
    )
