"""Order-dependent work on documents of any length.

A document may be far larger than one task should hold, so nothing here opens a
window over a whole document.  Rows carry a dense position ``seq``; a *chunk* is
``seq div rows`` and every window is partitioned by (document, chunk):

* ``near`` gives lag/lead style access.  The few rows at a chunk edge are copied
  into the neighbouring chunk, so one shuffle is enough and no join is needed.
* ``running`` gives running last/sum/max.  Each chunk is summarised to one row, the
  summaries (1/65536 of the data) are scanned per document, and the carried value
  is joined back on (document, chunk).
* ``dense_position`` numbers rows by counting per page first.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 16


def chunk(seq: Column | str, rows: int) -> Column:
    c = F.col(seq) if isinstance(seq, str) else seq
    return F.floor(c / F.lit(rows)).cast("long")


def _keys(df: DataFrame, keys: list[str]) -> list[str]:
    """``doc_rows`` is constant per document; as a key it lets a filter on it pass below the window."""
    return [*keys, "doc_rows"] if "doc_rows" in df.columns else keys


def near(
    df: DataFrame,
    *stages: Callable[[Window], Mapping[str, Column]],
    width: int = 1,
    rows: int = CHUNK_ROWS,
    doc: str = "doc_id",
    seq: str = "seq",
) -> DataFrame:
    """Add columns computed from at most ``width`` positions before or after a row.

    Each stage may look one row further than the stage before it, so ``width`` is the
    summed reach.  The result keeps the ``chunk`` column it is partitioned by, and
    ``running`` on the same rows needs no further shuffle.
    """
    if rows < width:
        raise ValueError("a chunk must be at least as long as the reach")
    own = chunk(seq, rows)
    pos = F.col(seq) - own * rows
    empty = F.array().cast("array<bigint>")
    copies = F.concat(
        F.array(own),
        F.when((pos < width) & (own > 0), F.array(own - 1)).otherwise(empty),
        F.when(pos >= rows - width, F.array(own + 1)).otherwise(empty),
    )
    w = Window.partitionBy(*_keys(df, [doc]), "chunk").orderBy(seq)
    out = df.drop("chunk").withColumn("chunk", F.explode(copies))
    for stage in stages:
        out = out.withColumns(dict(stage(w)))
    return out.where(F.col("chunk") == own)


def running(
    df: DataFrame,
    specs: Mapping[str, tuple[str, Column]],
    *,
    rows: int = CHUNK_ROWS,
    doc: str | list[str] = "doc_id",
    seq: str = "seq",
    before: bool = False,
) -> DataFrame:
    """Add running values, current row included unless ``before`` is set.

    ``specs`` maps an output column to ``(kind, value)`` where kind is ``last``
    (last non-null), ``sum`` or ``max``.  ``doc_rows``, when present, bounds ``seq`` in
    the document; only documents longer than a chunk are summarised. A value that is too
    small for a row beyond the first chunk is an error.
    """
    keys = _keys(df, [doc] if isinstance(doc, str) else list(doc))
    work = df.withColumns({f"_v_{k}": v for k, (_, v) in specs.items()})
    if "chunk" not in df.columns:
        work = work.withColumn("chunk", chunk(seq, rows))
    w = Window.partitionBy(*keys, "chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    wd = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)

    def over(kind: str, v: Column, win) -> Column:
        if kind == "last":
            return F.last(v, ignorenulls=True).over(win)
        return (F.sum(v) if kind == "sum" else F.max(v)).over(win)

    def total(kind: str, v: Column) -> Column:
        if kind == "last":
            return F.max_by(v, F.when(v.isNotNull(), F.col(seq)))
        return F.sum(v) if kind == "sum" else F.max(v)

    longer = work.where(F.col("doc_rows") > rows) if "doc_rows" in df.columns else work
    totals = longer.groupBy(*keys, "chunk").agg(
        *[total(kind, F.col(f"_v_{k}")).alias(f"_t_{k}") for k, (kind, _) in specs.items()]
    )
    carry = totals.select(
        *keys, "chunk", *[over(kind, F.col(f"_t_{k}"), wd).alias(f"_c_{k}") for k, (kind, _) in specs.items()]
    ).where("chunk > 0")

    local = work.withColumns({f"_r_{k}": over(kind, F.col(f"_v_{k}"), w) for k, (kind, _) in specs.items()})
    if "doc_rows" in df.columns:  # else rows beyond the first chunk would lose what is carried to them
        local = local.where(F.expr(f"IF(chunk > 0 AND doc_rows <= {rows}, raise_error('doc_rows is below the position of a row'), true)"))
    joined = local.join(carry, [*keys, "chunk"], "left")

    def merge(kind: str, r: Column, c: Column) -> Column:
        if kind == "last":
            return F.coalesce(r, c)
        if kind == "sum":
            return F.when(r.isNull(), c).otherwise(r + F.coalesce(c, F.lit(0)))
        return F.greatest(r, c)

    out = joined.withColumns({k: merge(kind, F.col(f"_r_{k}"), F.col(f"_c_{k}")) for k, (kind, _) in specs.items()})
    return out.drop(*[f"_{p}_{k}" for p in "vrc" for k in specs])


def page_offsets(counts: DataFrame, *, doc: str = "doc_id", page: str = "page_number", group: int = 4096) -> DataFrame:
    """Rows before each page, from (doc, page, n): summed per page group, then per document."""
    g = counts.withColumn("_g", F.floor(F.col(page) / F.lit(group)).cast("long"))
    wd = Window.partitionBy(doc).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    groups = g.groupBy(doc, "_g").agg(F.sum("n").alias("_gn")).select(
        doc, "_g", F.coalesce(F.sum("_gn").over(wd), F.lit(0)).alias("_base")
    )
    wp = Window.partitionBy(doc, "_g").orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    inner = g.withColumn("_in", F.coalesce(F.sum("n").over(wp), F.lit(0)))
    return inner.join(groups, [doc, "_g"]).select(doc, page, (F.col("_base") + F.col("_in")).alias("page_base"))


def dense_position(
    df: DataFrame,
    order: list[Column | str],
    *,
    out: str = "seq",
    start: int = 0,
    doc: str = "doc_id",
    page: str = "page_number",
) -> DataFrame:
    """Number the rows of every document by (page, order) without sorting a whole document."""
    w = Window.partitionBy(doc, page).orderBy(*order)
    offsets = page_offsets(df.groupBy(doc, page).agg(F.count("*").alias("n")), doc=doc, page=page)
    ranked = df.withColumn("_rn", F.row_number().over(w))
    return (
        ranked.join(offsets, [doc, page])
        .withColumn(out, (F.col("page_base") + F.col("_rn") - 1 + start).cast("long"))
        .drop("_rn", "page_base")
    )


def spread_over_chunks(per_doc: DataFrame, n_rows: Column, rows: int = CHUNK_ROWS) -> DataFrame:
    """Copy a per-document row once per chunk, so it joins on (doc, chunk) without skew."""
    last = F.greatest(F.floor((n_rows - 1) / F.lit(rows)).cast("long"), F.lit(0).cast("long"))
    return per_doc.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))


def join_per_doc(
    df: DataFrame,
    per_doc: DataFrame,
    *,
    rows: int = CHUNK_ROWS,
    doc: str = "doc_id",
    seq: str = "seq",
    how: str = "left",
) -> DataFrame:
    """Attach per-document values (which must carry ``max_seq``) chunk by chunk."""
    side = spread_over_chunks(per_doc, F.col("max_seq") + 1, rows).drop("max_seq")
    base = df if "chunk" in df.columns else df.withColumn("chunk", chunk(seq, rows))
    return base.join(side, [doc, "chunk"], how)
