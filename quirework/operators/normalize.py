"""Text normalisation of layout blocks.

Seven steps run in a fixed order.  They do not rewrite the table seven times: one
*trace* DataFrame carries the text after each step plus the step that dropped a row,
so the cleaned blocks, the change ledger, the step counts and the per-step snapshots
are all projections of the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .ordered import CHUNK_ROWS, dense_position, near, running
from .settle import discard, settle

UNICODE, CONTROL, WHITESPACE = "UNICODE_NORMALIZER", "CONTROL_CHARACTER_NORMALIZER", "WHITESPACE_NORMALIZER"
HYPHEN, PARAGRAPH = "HYPHENATION_NORMALIZER", "PARAGRAPH_NORMALIZER"
HEADER_FOOTER, EMPTY = "HEADER_FOOTER_NORMALIZER", "EMPTY_BLOCK_NORMALIZER"
STEPS = (UNICODE, CONTROL, WHITESPACE, HYPHEN, PARAGRAPH, HEADER_FOOTER, EMPTY)

# The typographic replacements.
ONE_TO_ONE = {
    "\u201c": '"', "\u201d": '"', "\u201e": '"',
    "\u2018": "'", "\u2019": "'", "\u201a": "'",
    "\u2013": "-", "\u2014": "-", "\u2015": "-",
    "\u00a0": " ", "\u2002": " ", "\u2003": " ", "\u2009": " ",
}
EXPANDING = {
    "\ufb01": "fi", "\ufb02": "fl", "\ufb00": "ff", "\ufb03": "ffi", "\ufb04": "ffl", "\u2026": "...",
}
# Fixed value: what a page number looks like.
PAGE_NUMBER = r"(?i)^(\d+|[ivxldcmIVXLDCM]+|page\s+\d+|\d+\s+of\s+\d+)$"


@dataclass(frozen=True)
class NormalizeParams:
    max_vertical_gap: float = 15.0
    indent_tolerance: float = 5.0
    header_pages: int = 2
    footer_pages: int = 2
    cross_page_merge: bool = True
    hyphen_merge: bool = True
    header_footer_mode: str = "remove"
    disabled: frozenset = field(default_factory=frozenset)
    chunk_rows: int = CHUNK_ROWS

    def on(self, step: str) -> bool:
        return step not in self.disabled


# ---------------------------------------------------------------- scalar steps


# Text without any of these signs needs neither of the first two steps.
_PLAIN = r"\t\n\r -~\u00C0-\u024F"


def _special(c: Column) -> Column:
    return tx.matches(c, f"[^{_PLAIN}]")


def fold_typography(c: Column) -> Column:
    out = F.translate(c, "".join(ONE_TO_ONE), "".join(ONE_TO_ONE.values()))
    for sign, plain in EXPANDING.items():
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return F.when(_special(c), out).otherwise(c)


def drop_controls(c: Column) -> Column:
    return F.when(_special(c), F.regexp_replace(c, r"[\p{Cc}\p{Cf}&&[^\n\r\t]]", "")).otherwise(c)


def tidy_whitespace(c: Column) -> Column:
    b = tx.BLANK_CLASS
    one_line_ends = F.regexp_replace(c, r"\r\n?", "\n")
    spaced = F.regexp_replace(F.translate(one_line_ends, "\t", " "), " +", " ")
    # A line strip removes every blank except the line feed that delimits the line.
    inner = b.replace(r"\n", "")
    stripped = F.regexp_replace(F.regexp_replace(spaced, f"[{inner}]+\n", "\n"), f"\n[{inner}]+", "\n")
    full = tx.strip(F.regexp_replace(stripped, r"\n{3,}", "\n\n"))
    untidy = F.contains(c, F.lit("\n"))
    for sign in ("\t", "\r", "  "):
        untidy = untidy | F.contains(c, F.lit(sign))
    return F.when(untidy, full).otherwise(tx.strip(c))


def rejoin_hyphens(c: Column) -> Column:
    fixed = F.regexp_replace(c, f"([{tx.WORD}]+)-\n([{tx.WORD}]+)", "$1$2")
    return F.when(F.contains(c, F.lit("-\n")), fixed).otherwise(c)


def soften_breaks(c: Column) -> Column:
    """Replace a line break by a space where the sentence goes on."""
    lines = F.transform(F.split(c, "\n", -1), tx.strip)
    n = F.size(lines)

    def piece(line: Column, i: Column) -> Column:
        following = F.coalesce(F.get(lines, i + 1), F.lit(""))
        joins = tx.unfinished(line) & tx.starts_continuation(following)
        return (
            F.when(line == "", F.lit("\n"))
            .when(i == n - 1, line)
            .when(joins, F.concat(line, F.lit(" ")))
            .otherwise(F.concat(line, F.lit("\n")))
        )

    return F.when(F.contains(c, F.lit("\n")), tx.strip(F.array_join(F.transform(lines, piece), ""))).otherwise(c)


# ------------------------------------------------------------- cross-row steps


def scalar_trace(blocks: DataFrame, p: NormalizeParams = NormalizeParams()) -> DataFrame:
    """Text after the first three steps: t1, t2, t3 (t0 is the input)."""
    t = blocks.withColumn("t0", F.coalesce("text", F.lit("")))
    for i, (step, fn) in enumerate(
        ((UNICODE, fold_typography), (CONTROL, drop_controls), (WHITESPACE, tidy_whitespace)), start=1
    ):
        t = t.withColumn(f"t{i}", fn(F.col(f"t{i-1}")) if p.on(step) else F.col(f"t{i-1}"))
    return t.withColumn("dropped_by", F.lit(None).cast("string"))


def hyphen_trace(t: DataFrame, p: NormalizeParams = NormalizeParams()) -> DataFrame:
    """Adds t4; a block ending in '-' may absorb the one that follows it."""
    if not (p.on(HYPHEN) and p.hyphen_merge):
        return t.withColumn("t4", F.col("t3"))
    fixed = t.withColumn("_fix", rejoin_hyphens(F.col("t3")))

    def look_ahead(w: Window):
        nxt = lambda c: F.lead(c).over(w)
        same_page = (
            (nxt("page_number") == F.col("page_number"))
            & (nxt("reading_order") == F.col("reading_order") + 1)
            & (F.col("x1") > nxt("x0"))
        )
        size = lambda c: F.coalesce(c, F.lit(0.0))
        next_page = (
            (nxt("page_number") == F.col("page_number") + 1)
            & F.col("font_family").eqNullSafe(nxt("font_family"))
            & (F.abs(size(F.col("font_size")) - size(nxt("font_size"))) <= 1.0)
        )
        opens = tx.matches(tx.first_char(nxt("t3")), rf"[{tx.LOWER}]|[^{tx.ALNUM}]")
        joins = F.col("_fix").endswith("-") & (same_page | next_page) & opens
        return {"_joins": F.coalesce(joins, F.lit(False)), "_next": nxt("t3")}

    look_back = lambda w: {"_prev": F.coalesce(F.lag("_joins").over(w), F.lit(False))}
    pairs = near(fixed, look_ahead, look_back, width=2, rows=p.chunk_rows)
    # A run of joining rows pairs off from its first row: even places absorb odd ones.
    runs = running(
        pairs, {"_from": ("last", F.when(~F.col("_prev"), F.col("seq")))}, rows=p.chunk_rows
    ).withColumn("_odd", (F.col("seq") - F.col("_from")) % 2 == 1)
    absorbed = F.col("_prev") & F.col("_odd")
    heads = F.col("_joins") & ~F.col("_odd")
    return runs.withColumns(
        {
            "t4": F.when(absorbed, F.lit(""))
            .when(heads, F.concat(F.expr("left(_fix, length(_fix) - 1)"), F.col("_next")))
            .otherwise(F.col("_fix")),
            "dropped_by": F.when(absorbed, F.lit(HYPHEN)).otherwise(F.col("dropped_by")),
        }
    ).drop("_fix", "_joins", "_next", "_prev", "_from", "_odd")


def _fold_merges(gap: float, indent: float, cross_page: bool):
    """Serial rule inside one candidate run, on numbers only: which row heads each row."""

    def fold(batches):
        key, s = None, None
        for pdf in batches:
            out = []
            cols = [pdf[c].tolist() for c in ("run_doc", "run", "seq", "page_number", "font_size", "x0", "y0", "y1")]
            for doc, run, seq, page, size, x0, y0, y1 in zip(*cols):
                if key == (doc, run):
                    head, hpage, hsize, mx0, my1 = s
                    ok = abs(hsize - size) <= 0.5 and abs(mx0 - x0) <= indent and (
                        (page == hpage and 0 <= y0 - my1 <= gap) or (cross_page and page == hpage + 1)
                    )
                    s = (head, hpage, hsize, min(mx0, x0), max(my1, y1)) if ok else (seq, page, size, x0, y1)
                else:
                    key, s = (doc, run), (seq, page, size, x0, y1)
                out.append(s[0])
            yield pdf[["run_doc", "seq", "t5", "x0", "x1", "y1"]].assign(head_seq=out)

    return fold


def paragraph_heads(t: DataFrame, p: NormalizeParams = NormalizeParams()) -> DataFrame:
    """Rows of every candidate run of two or more rows, each with the row that heads it."""
    alive = t.where("dropped_by IS NULL").select(
        "doc_id", "seq", *(["doc_rows"] if "doc_rows" in t.columns else []),
        "page_number", "block_type", "font_family",
        F.coalesce("font_size", F.lit(0.0)).alias("font_size"), "x0", "y0", "x1", "y1", "t5",
        tx.unfinished(tx.strip(F.col("t5"))).alias("_open"),
        tx.starts_continuation(tx.strip(F.col("t5"))).alias("_goes_on"),
    )

    def link(w: Window):
        prev = lambda c: F.lag(c).over(w)
        # Conditions every merge must meet whatever the head is; they cut the data into short runs.
        cond = (
            (F.col("block_type") == "PARAGRAPH") & (prev("block_type") == "PARAGRAPH")
            & prev("_open") & F.col("_goes_on")
            & F.col("font_family").eqNullSafe(prev("font_family"))
            & (F.abs(F.col("font_size") - prev("font_size")) <= 1.0)
            & (F.abs(F.col("x0") - prev("x0")) <= 2 * p.indent_tolerance)
            & F.col("page_number").between(prev("page_number"), prev("page_number") + (1 if p.cross_page_merge else 0))
        )
        return {"_link": F.coalesce(cond, F.lit(False))}

    # An absorbed row never follows another, so the previous live row is at most two back.
    follow = lambda w: {"_linked_next": F.coalesce(F.lead("_link").over(w), F.lit(False))}
    linked = near(alive, link, follow, width=4, rows=p.chunk_rows)
    runs = running(linked, {"run": ("last", F.when(~F.col("_link"), F.col("seq")))}, rows=p.chunk_rows)
    todo = runs.where(F.col("_link") | F.col("_linked_next")).select(
        F.col("doc_id").alias("run_doc"), "run", "seq", "page_number", "font_size", "x0", "y0", "x1", "y1", "t5"
    )
    doc_type = t.schema["doc_id"].dataType.simpleString()
    ordered = todo.repartition("run_doc", "run").sortWithinPartitions("run_doc", "run", "seq")
    folded = ordered.mapInPandas(
        _fold_merges(p.max_vertical_gap, p.indent_tolerance, p.cross_page_merge),
        f"run_doc {doc_type}, seq bigint, t5 string, x0 double, x1 double, y1 double, head_seq bigint",
    )
    return folded.withColumnRenamed("run_doc", "doc_id")


def paragraph_trace(t: DataFrame, p: NormalizeParams = NormalizeParams()) -> DataFrame:
    """Adds t5 (soft breaks removed), t6 (merged text) and ``merged_parts``; widens head boxes."""
    if not p.on(PARAGRAPH):
        return t.withColumns({"t5": F.col("t4"), "t6": F.col("t4"), "merged_parts": F.lit(None).cast("array<string>")})
    soft = t.withColumn(
        "t5",
        F.when((F.col("block_type") == "PARAGRAPH") & (F.col("t4") != ""), soften_breaks(F.col("t4"))).otherwise(
            F.col("t4")
        ),
    )
    # One merge spans at most two pages, so its texts fit a row.
    parts = (
        paragraph_heads(soft, p)
        .groupBy("doc_id", "head_seq")
        .agg(
            F.array_sort(F.collect_list(F.struct("seq", "t5"))).alias("_parts"),
            F.min("x0").alias("_x0"), F.max("x1").alias("_x1"), F.max("y1").alias("_y1"),
        )
        .where(F.size("_parts") > 1)
    )
    # Heads get the merged text, the other members a tombstone.
    marks = parts.select(
        "doc_id",
        F.posexplode(F.col("_parts.seq")).alias("_i", "seq"),
        F.col("_parts.t5").alias("_texts"), "_x0", "_x1", "_y1",
    ).select(
        "doc_id", "seq", "_i",
        F.when(F.col("_i") == 0, F.col("_texts")).alias("merged_parts"), "_x0", "_x1", "_y1",
    )
    j = soft.join(marks, ["doc_id", "seq"], "left")
    head, gone = F.col("_i") == 0, F.col("_i") > 0
    return j.withColumns(
        {
            "t6": F.when(head, F.array_join("merged_parts", " ")).when(gone, F.lit("")).otherwise(F.col("t5")),
            "dropped_by": F.when(gone, F.lit(PARAGRAPH)).otherwise(F.col("dropped_by")),
            "x0": F.when(head, F.col("_x0")).otherwise(F.col("x0")),
            "x1": F.when(head, F.col("_x1")).otherwise(F.col("x1")),
            "y1": F.when(head, F.col("_y1")).otherwise(F.col("y1")),
        }
    ).drop("_i", "_x0", "_x1", "_y1")


def running_trace(t: DataFrame, p: NormalizeParams = NormalizeParams(), text: str = "t6", stored: bool = False) -> DataFrame:
    """Adds ``running_type``: HEADER, FOOTER or PAGE_NUMBER for text repeated across pages.

    Of ``stored`` rows, which are cheap to read again, only those in a margin are dealt out."""
    none = F.lit(None).cast("string")
    if not p.on(HEADER_FOOTER):
        return t.withColumn("running_type", none)
    height = F.coalesce(F.col("page_height"), F.lit(842.0))
    height = F.when(height == 0, F.lit(842.0)).otherwise(height)
    body = tx.strip(F.col(text))
    near_15 = lambda c: (F.bround(F.col(c) / 15.0, 0) * 15).cast("long")
    layout = F.struct(
        F.col("_top"), near_15("x0"), near_15("y0"),
        F.coalesce("font_family", F.lit("\u0000")),
        F.bround(F.coalesce("font_size", F.lit(0.0)) / 0.5, 0) * 0.5,
        F.col("_bottom"),
    )
    marked = t.withColumns(
        {
            "_top": F.col("y1") <= height * 0.20,
            "_bottom": F.col("y0") >= height * 0.80,
            "_body": body,
        }
    )
    margin = F.col("dropped_by").isNull() & (F.col("_body") != "") & (F.col("_top") | F.col("_bottom"))
    marked = marked.withColumns(
        {
            "_number": tx.matches(F.col("_body"), PAGE_NUMBER),
            "_place": F.when(margin, F.sha2(F.to_json(layout), 256)),
            "_sig": F.when(margin, F.sha2(F.to_json(F.struct(F.lower("_body"), layout)), 256)),
        }
    )
    least = F.when(F.col("_top"), F.lit(p.header_pages)).otherwise(F.lit(p.footer_pages))
    # Distinct pages in two steps, so one very frequent line is pre-aggregated before the shuffle.
    keys = F.array_compact(F.array(F.col("_sig"), F.when(F.col("_number"), F.col("_place"))))
    pages = (
        marked.where(F.col("_sig").isNotNull())
        .select("doc_id", "page_number", least.alias("_least"), F.explode(keys).alias("_key"))
        .groupBy("doc_id", "_key", "page_number").agg(F.min("_least").alias("_least"))
    )
    repeated = (
        pages.groupBy("doc_id", "_key").agg(F.count("*").alias("_n"), F.min("_least").alias("_least"))
        .where("_n >= _least").select("doc_id", "_key")
    )
    same_text = repeated.select("doc_id", F.col("_key").alias("_sig"), F.lit(True).alias("_static"))
    same_place = repeated.select("doc_id", F.col("_key").alias("_place"), F.lit(True).alias("_paged"))
    beside = marked.where(F.coalesce(margin, F.lit(False))) if stored else marked
    j = beside.join(same_text, ["doc_id", "_sig"], "left").join(same_place, ["doc_id", "_place"], "left")
    if stored:
        j = j.unionByName(marked.where(~F.coalesce(margin, F.lit(False))), allowMissingColumns=True)
    kind = (
        F.when(F.coalesce("_paged", F.lit(False)) & F.col("_number"), F.lit("PAGE_NUMBER"))
        .when(F.coalesce("_static", F.lit(False)) & F.col("_top"), F.lit("HEADER"))
        .when(F.coalesce("_static", F.lit(False)), F.lit("FOOTER"))
    )
    out = j.withColumn("running_type", F.when(F.col("_sig").isNotNull(), kind))
    if p.header_footer_mode == "remove":
        out = out.withColumn(
            "dropped_by", F.when(F.col("running_type").isNotNull(), F.lit(HEADER_FOOTER)).otherwise(F.col("dropped_by"))
        )
    else:
        out = out.withColumn("block_type", F.coalesce("running_type", "block_type"))
    return out.drop("_top", "_bottom", "_body", "_number", "_place", "_sig", "_static", "_paged")


def empty_trace(t: DataFrame, p: NormalizeParams = NormalizeParams(), text: str = "t6") -> DataFrame:
    if not p.on(EMPTY):
        return t
    gone = F.col("dropped_by").isNull() & tx.is_blank(F.col(text))
    return t.withColumn("dropped_by", F.when(gone, F.lit(EMPTY)).otherwise(F.col("dropped_by")))


def _stored(t: DataFrame) -> DataFrame:
    """Write the rows with each text only where it differs from that of the step before."""
    texts = [c for c in ("text", "t0", "t1", "t2", "t3", "t4", "t5", "t6") if c in t.columns]
    pairs = list(zip(texts[1:], texts))
    rows = settle(t.withColumns({c: F.when(F.col(c).eqNullSafe(F.col(last)), F.lit(None)).otherwise(F.col(c)) for c, last in pairs}))
    out = rows
    for c, last in pairs:
        out = out.withColumn(c, F.coalesce(c, last))
    out.settled_at = rows.settled_at
    return out


def trace(blocks: DataFrame, p: NormalizeParams = NormalizeParams()) -> DataFrame:
    """All seven steps in order; absorbed, repeated and empty blocks stay as tombstones."""
    # Each of the cross-row steps reads its rows twice or more, every projection once.
    broken = _stored(scalar_trace(blocks, p).transform(hyphen_trace, p))
    merged = _stored(paragraph_trace(broken, p))
    discard(broken)
    done = _stored(running_trace(merged, p, stored=True).transform(empty_trace, p))
    discard(merged)
    return done


# ------------------------------------------------------------------ projections


def cleaned(t: DataFrame, text: str = "t6") -> DataFrame:
    """Surviving blocks with their final text; ``seq`` is made dense again."""
    keep = t.where("dropped_by IS NULL").withColumn("text", F.col(text))
    keep = keep.drop("t0", "t1", "t2", "t3", "t4", "t5", "t6", "merged_parts", "running_type", "dropped_by", "chunk")
    return dense_position(keep.withColumnRenamed("seq", "_old"), ["_old"]).drop("_old")


def normalize(blocks: DataFrame, p: NormalizeParams = NormalizeParams()) -> DataFrame:
    return cleaned(trace(blocks, p))


def _digest(c: Column) -> Column:
    return F.when(c != "", F.sha2(c, 256))


def ledger(t: DataFrame, *, mode: str = "remove", verbose: bool = False) -> DataFrame:
    """One row per change: step, action, digests before and after, reason."""

    def entry(when: Column, step: str, action: str, reason: Column, before: Column, after: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(STEPS.index(step)).alias("step_no"), F.lit(step).alias("step_name"),
                F.lit(action).alias("action"), reason.alias("reason"),
                before.alias("before"), after.alias("after"),
            ),
        )

    c, lit = F.col, F.lit
    changed = lambda a, b: (c(a) != c(b)) & (c(a) != "")
    by = lambda step: c("dropped_by") == step
    not_absorbed = ~F.coalesce(by(HYPHEN), lit(False))
    pn = c("running_type") == "PAGE_NUMBER"
    singles = F.array(
        entry(changed("t0", "t1"), UNICODE, "modified", lit("unicode normalization"), c("t0"), c("t1")),
        entry(changed("t1", "t2"), CONTROL, "modified", lit("removed control characters"), c("t1"), c("t2")),
        entry(changed("t2", "t3"), WHITESPACE, "modified", lit("whitespace normalization"), c("t2"), c("t3")),
        entry(changed("t3", "t4") & not_absorbed, HYPHEN, "modified", lit("Repaired line-break hyphenation"),
              c("t3"), c("t4")),
        entry(by(HYPHEN), HYPHEN, "deleted", lit("Empty block after hyphen merge"), c("t3"), lit("")),
        entry(changed("t4", "t5") & not_absorbed, PARAGRAPH, "modified", lit("Removed soft line break"),
              c("t4"), c("t5")),
        entry(by(PARAGRAPH), PARAGRAPH, "deleted", lit("Paragraph block merged into previous block"),
              c("t5"), lit("")),
        entry(
            c("running_type").isNotNull() & lit(mode == "remove"), HEADER_FOOTER, "deleted",
            F.when(pn, lit("Detected page number")).when(c("running_type") == "HEADER", lit("Removed repeated header"))
            .otherwise(lit("Removed repeated footer")), c("t6"), lit("")),
        entry(
            c("running_type").isNotNull() & lit(mode != "remove"), HEADER_FOOTER, "modified",
            F.concat(lit("Classified as "), c("running_type")), c("t6"), c("t6")),
        entry(by(EMPTY), EMPTY, "deleted", lit("empty block removed"), c("t6"), lit("")),
    )
    # The k-th merge of a head turns its first k parts into its first k+1 parts.
    n = F.size("merged_parts")
    merges = F.when(
        n > 1,
        F.transform(
            F.sequence(lit(1), n - 1),
            lambda k: F.struct(
                lit(STEPS.index(PARAGRAPH)).alias("step_no"), lit(PARAGRAPH).alias("step_name"),
                lit("modified").alias("action"), lit("Merged paragraph").alias("reason"),
                F.array_join(F.slice("merged_parts", lit(1), k), " ").alias("before"),
                F.array_join(F.slice("merged_parts", lit(1), k + 1), " ").alias("after"),
            ),
        ),
    )
    rows = t.select(
        "doc_id", "block_id", "seq",
        F.explode(F.concat(F.filter(singles, lambda e: e.isNotNull()),
                           F.coalesce(merges, F.array().cast(_entry_type())))).alias("e"),
    )
    text = [c("e.before").alias("original_text"), c("e.after").alias("transformed_text")] if verbose else []
    return rows.select(
        "doc_id", "block_id", "seq", "e.step_no", "e.step_name", "e.action", "e.reason",
        _digest(c("e.before")).alias("original_hash"), _digest(c("e.after")).alias("transformed_hash"), *text,
    )


def _entry_type() -> str:
    return (
        "array<struct<step_no:int,step_name:string,action:string,reason:string,before:string,after:string>>"
    )


def stage_metrics(t: DataFrame) -> DataFrame:
    """Modified, removed and merged block counts per document and step."""
    c = F.col
    alive_at = lambda step: ~F.coalesce(c("dropped_by").isin([s for s in STEPS if STEPS.index(s) < STEPS.index(step)]),
                                        F.lit(False))
    changed = lambda a, b: F.count_if((c(a) != c(b)) & (c(a) != ""))
    dropped = lambda step: F.count_if(c("dropped_by") == step)
    heads = F.count_if(F.size("merged_parts") > 1)
    zero = F.lit(0).cast("long")
    kept = F.count_if(c("running_type").isNotNull() & c("dropped_by").isNull())

    def row(step: str, modified: Column, removed: Column, merged: Column) -> Column:
        return F.struct(
            F.lit(step).alias("step_name"), modified.alias("modified"), removed.alias("removed"), merged.alias("merged")
        )

    hyphen_changed = F.count_if((c("t3") != c("t4")) & (c("t3") != "") & ~F.coalesce(c("dropped_by") == HYPHEN, F.lit(False)))
    soft = F.count_if((c("t4") != c("t5")) & alive_at(PARAGRAPH))
    rows = F.array(
        row(UNICODE, changed("t0", "t1"), zero, zero),
        row(CONTROL, changed("t1", "t2"), zero, zero),
        row(WHITESPACE, changed("t2", "t3"), zero, zero),
        row(HYPHEN, hyphen_changed, dropped(HYPHEN), zero),
        row(PARAGRAPH, soft + heads, dropped(PARAGRAPH), dropped(PARAGRAPH)),
        row(HEADER_FOOTER, kept, dropped(HEADER_FOOTER), zero),
        row(EMPTY, zero, dropped(EMPTY), zero),
    )
    return t.groupBy("doc_id").agg(rows.alias("r")).select("doc_id", F.inline("r"))


def snapshots(t: DataFrame) -> DataFrame:
    """The text of every block alive after each step, stacked with the step name."""
    c = F.col
    texts = dict(zip(STEPS, ("t1", "t2", "t3", "t4", "t6", "t6", "t6")))
    gone = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STEPS]), c("dropped_by")), F.lit(0)) - 1
    at = F.array(
        *[
            F.struct(F.lit(i).alias("step_no"), F.lit(s).alias("step_name"), c(texts[s]).alias("text"))
            for i, s in enumerate(STEPS)
        ]
    )
    return t.select(
        "doc_id", "block_id", "seq",
        F.inline(F.filter(at, lambda x: (gone < 0) | (x["step_no"] < gone))),
    )
