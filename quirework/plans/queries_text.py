"""Registered queries: text normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import normalize as nz
from ..sources import standin as src
from .pipeline import stage

CLASSIFY = nz.NormalizeParams(header_footer_mode="classify")


def _scalar(col):
    return lambda s, d: nz.scalar_trace(src.wrapped_blocks(s, d)).select("doc_id", "block_id", F.col(col).alias("text"))


def _hyphen(s, d):
    t = nz.scalar_trace(src.wrapped_blocks(s, d))
    return t.select("doc_id", "block_id", nz.rejoin_hyphens(F.col("t3")).alias("text"))


def _hyphen_cross(s, d):
    t = nz.hyphen_trace(nz.scalar_trace(src.wrapped_blocks(s, d)))
    return t.where("dropped_by IS NULL").select("doc_id", "block_id", F.col("t4").alias("text"))


def _para(s, d):
    return nz.paragraph_trace(nz.hyphen_trace(nz.scalar_trace(src.wrapped_blocks(s, d))))


def _soft(s, d):
    t = nz.hyphen_trace(nz.scalar_trace(src.wrapped_blocks(s, d))).where("dropped_by IS NULL")
    return t.select("doc_id", "block_id", nz.soften_breaks(F.col("t4")).alias("text"))


def _merge(s, d):
    return _para(s, d).where("dropped_by IS NULL").select(
        "doc_id", "block_id", F.col("t6").alias("text"), "x0", "y0", "x1", "y1"
    )


def _headed(s, d, p=nz.NormalizeParams()):
    t = nz.scalar_trace(src.headed_blocks(s, d), p)
    return t.transform(nz.hyphen_trace, p).transform(nz.paragraph_trace, p).transform(nz.running_trace, p)


def _remove(s, d):
    return _headed(s, d).where("dropped_by IS NULL").select("doc_id", "block_id", F.col("t6").alias("text"))


def _classify(s, d):
    return _headed(s, d, CLASSIFY).where("dropped_by IS NULL").select("doc_id", "block_id", "block_type")


def _drop_empty(s, d):
    t = nz.empty_trace(nz.scalar_trace(src.wrapped_blocks(s, d)), text="t3")
    return t.where("dropped_by IS NULL").select("doc_id", "block_id", F.col("t3").alias("text"))


def _trace(s, d):
    return stage(s, d, "trace", lambda: nz.trace(src.headed_blocks(s, d)))


def _all(s, d):
    return nz.cleaned(_trace(s, d)).select("doc_id", "block_id", "text", "page_number", "seq")


def _ledger(s, d):
    return nz.ledger(_trace(s, d)).drop("step_no")


def _metrics(s, d):
    return nz.stage_metrics(_trace(s, d))


def _snapshots(s, d):
    return nz.snapshots(_trace(s, d)).select("doc_id", "block_id", "step_name", "text")


QUERIES = {
    "normalize_unicode": _scalar("t1"),
    "normalize_control": _scalar("t2"),
    "normalize_whitespace": _scalar("t3"),
    "normalize_hyphen": _hyphen,
    "hyphen_cross_block": _hyphen_cross,
    "soft_line_breaks": _soft,
    "paragraph_merge": _merge,
    "running_headers_remove": _remove,
    "running_headers_classify": _classify,
    "drop_empty": _drop_empty,
    "normalize_all": _all,
    "ledger": _ledger,
    "stage_metrics": _metrics,
    "stage_snapshots": _snapshots,
}
