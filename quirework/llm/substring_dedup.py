"""Substring dedup: remove long passages that an earlier document already holds.

A window is ``WINDOW`` consecutive words of one document. Every window has a Rabin-Karp hash
of its word sequence. A window whose hash also occurs in a document with a smaller id is
removed, and overlapping or touching removed windows merge into maximal intervals.

Most windows occur once, so they are sifted before they are counted. The anchor of a
window is the smallest hash of the 25-word grams inside it. Equal windows have equal
anchors, and neighbouring windows mostly share one, so there are about 13 times fewer
anchors than windows. Spark counts the documents of every anchor. Only windows whose anchor
occurs in two documents move on, as runs with one anchor, so no repeated window can be
lost; anchor and hash together are 128 bits from two bases. Runs meet by anchor in the order
of ids, and each window is looked up among those seen before. An anchor of more than
``PART_DOCS`` documents is dealt to several parts, and the first sights of its windows are
compared across the parts afterwards.

Defined results: a null or empty text has no words (its kept text is empty); rows that
repeat an id never remove words from each other; a row with a null id keeps all its words and
takes none from others; texts shorter than a window stay whole; an empty table gives no
rows; ``kept`` joins the words left by one space; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as wd

WINDOW, PART_DOCS = 50, 1_000
U64 = np.uint64


def anchors_of(hashes: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window: a sliding minimum over the grams of half its length."""
    gram = max(1, window // 2)
    low, width, span = wd.rolling(hashes, gram, wd.BASES[1]), 1, window - gram + 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[: len(low) - (span - width)], low[span - width :]) if span > width else low


def merged(cuts: list[dict]) -> list[tuple[int, int]]:
    """Sorted intervals that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for c in cuts:
        if out and c["from"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], c["to"]))
        else:
            out.append((c["from"], c["to"]))
    return out


def _source(documents: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", text.alias("text"), *more, F.xxhash64("doc_id", text).alias("row_key"))


def _columns(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, keys = _columns(batch, "text", "doc_id", "row_key")
            found, counts = [], []
            for d in wd.documents(texts):
                own = np.unique(anchors_of(d.hashes, window)) if len(d) >= window else np.empty(0, U64)
                found.append(own)
                counts.append(len(own))
            rows = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*found, np.empty(0, U64)]).view(np.int64)), ids.take(rows), keys.take(rows)],
                ["anchor", "doc_id", "row_key"],
            )

    return run


def _run_rows(window: int):
    """Runs of neighbouring windows with one shared anchor: their hashes as one list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, keys, shared = _columns(batch, "text", "doc_id", "row_key", "shared")
            bounds, wanted = np.asarray(shared.offsets), shared.values
            names, parts = np.asarray(wanted.field("anchor")).view(U64), np.asarray(wanted.field("parts"))
            anchors, salts, starts, rows, lists, sizes = [], [], [], [], [], [0]
            salt = np.asarray(keys).view(U64)
            for d in wd.documents(texts):
                lo, hi = bounds[d.row], bounds[d.row + 1]
                if lo == hi:
                    continue
                order = np.argsort(names[lo:hi])
                known, n_parts = names[lo:hi][order], parts[lo:hi][order]
                own = anchors_of(d.hashes, window)
                edges = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
                place = np.minimum(np.searchsorted(known, own[edges[:-1]]), len(known) - 1)
                hashed = wd.rolling(d.hashes, window, wd.BASES[0])
                for k in np.flatnonzero(known[place] == own[edges[:-1]]).tolist():
                    a, b = edges[k], edges[k + 1]
                    anchors.append(own[a])
                    salts.append(salt[d.row] % U64(n_parts[place[k]]) if n_parts[place[k]] > 1 else -1)
                    starts.append(a)
                    rows.append(d.row)
                    lists.append(hashed[a:b])
                    sizes.append(b - a)
            take = pa.array(rows, pa.int64())
            flat = pa.array(np.concatenate([*lists, np.empty(0, U64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(anchors, U64).view(np.int64)), pa.array(np.array(salts, np.int64).astype(np.int32)), ids.take(take),
                    keys.take(take), pa.array(starts, pa.int32()), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), flat),
                ],
                ["anchor", "part", "doc_id", "row_key", "start", "windows"],
            )

    return run


def _seen_rows(window: int):
    """Runs sorted by (anchor, part, doc_id): which windows had an earlier document?

    Gives word intervals to remove (window null), and the first sight of each window where
    the anchor has several parts, to be compared across parts. Only the distinct windows of
    one anchor and part are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, doc, seen, fresh = None, None, set(), set()
        for batch in batches:
            anchors, salts, ids, keys, starts, lists = (c.to_pylist() for c in batch.columns)
            out: list[tuple] = []
            for anchor, part, doc_id, key, start, hashed in zip(anchors, salts, ids, keys, starts, lists, strict=True):
                if (anchor, part) != group:
                    group, doc, seen, fresh = (anchor, part), doc_id, set(), set()
                if doc_id != doc:
                    seen |= fresh
                    doc, fresh = doc_id, set()
                first = None
                for i, h in enumerate(hashed):
                    if h in seen:
                        first = i if first is None else first
                        continue
                    fresh.add(h)
                    if first is not None:
                        out.append((anchor, None, doc_id, key, start + first, start + i - 1 + window))
                        first = None
                    if part >= 0:
                        out.append((anchor, h, doc_id, key, start + i, start + i + window))
                if first is not None:
                    out.append((anchor, None, doc_id, key, start + first, start + len(hashed) - 1 + window))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int64(), batch.schema.field(2).type, pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["anchor", "window", "doc_id", "row_key", "from", "to"])

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, part_docs: int = PART_DOCS) -> DataFrame:
    """Rows (row_key, cuts): the word intervals to remove from a document of :func:`_source`."""
    id_type = dict(docs.dtypes)["doc_id"]
    anchors = docs.where("doc_id IS NOT NULL").select("doc_id", "row_key", "text").mapInArrow(
        _anchor_rows(window), f"anchor long, doc_id {id_type}, row_key long"
    )
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    shared = shared.where("low < high").select("anchor", F.ceil(F.col("n") / part_docs).cast("int").alias("parts"))
    lists = anchors.join(shared, "anchor").groupBy("row_key").agg(F.collect_set(F.struct("anchor", "parts")).alias("shared"))
    runs = docs.join(lists, "row_key").select("doc_id", "row_key", "text", "shared").mapInArrow(
        _run_rows(window), f"anchor long, part int, doc_id {id_type}, row_key long, start int, windows array<long>"
    )
    seen = runs.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "doc_id").mapInArrow(
        _seen_rows(window), f"anchor long, window long, doc_id {id_type}, row_key long, from int, to int"
    )
    firsts = seen.where("window IS NOT NULL")
    earliest = firsts.groupBy("anchor", "window").agg(F.min("doc_id").alias("first_id"))
    across = firsts.join(earliest, ["anchor", "window"]).where("first_id < doc_id")
    cuts = seen.where("window IS NULL").select("row_key", "from", "to").unionByName(across.select("row_key", "from", "to"))
    return cuts.groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("cuts"))


def cut_text(d: wd.Words, cuts: list[tuple[int, int]]) -> bytes:
    """The text without the words of ``cuts``, its other spacing as it was."""
    if not len(d):
        return b""
    raw, at, parts = d.data.tobytes(), d.low, []
    for a, b in cuts:
        parts.append(raw[at : d.starts[a]])
        at = d.starts[b] if b < len(d) else d.high
    return b"".join([*parts, raw[at : d.high]])


def joined_text(d: wd.Words, cuts: list[tuple[int, int]]) -> bytes:
    """The words outside ``cuts``, joined by one space."""
    keep = np.ones(len(d), bool)
    for a, b in cuts:
        keep[a:b] = False
    raw = d.data.tobytes() if len(d) else b""
    return b" ".join([raw[s:e] for s, e in zip(d.starts[keep].tolist(), d.ends[keep].tolist(), strict=True)])


def _cut_rows(spaced: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = _columns(batch, "text", "cuts")
            totals, removed, kept, spans = [], [], [], []
            for d in wd.documents(texts):
                cuts = merged(lists[d.row].as_py())
                totals.append(len(d))
                removed.append(sum(b - a for a, b in cuts))
                if spaced and not cuts:
                    kept.append(texts[d.row].as_py())
                else:
                    kept.append((cut_text if spaced else joined_text)(d, cuts).decode())
                spans.append([{"start": a, "end": b} for a, b in cuts])
            own = [n for n in batch.schema.names if n not in ("text", "cuts")]
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*_columns(batch, *own), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())],
                [*own, "n_words", "n_removed", "removed", "kept"],
            )

    return run


def remove_repeats(documents: DataFrame, *more: str, window: int = WINDOW, part_docs: int = PART_DOCS, spaced: bool = False) -> DataFrame:
    """Rows (doc_id, more columns, n_words, n_removed, removed, kept) for every document.
    ``kept`` has the words left joined by one space, or, ``spaced``, as they were spaced."""
    docs = _source(documents, *more)
    cuts = F.coalesce("cuts", F.array().cast("array<struct<from:int,to:int>>")).alias("cuts")
    found = repeated_windows(docs.drop(*more), window, part_docs)
    rows = docs.join(found, "row_key", "left").select("doc_id", "text", *more, cuts)
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    new = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("removed", span), ("kept", T.StringType())]
    own = [f for f in rows.schema if f.name not in ("text", "cuts")]
    return rows.mapInArrow(_cut_rows(spaced), T.StructType([*own, *(T.StructField(n, t) for n, t in new)]))
