"""N-gram Jaccard self-join by PartEnum signatures, and the groups its links form.

A document's set holds the distinct hashes of its five-word shingles. Two sets link when
100 * |A & B| >= 80 * |A | B|, which bounds their symmetric difference by a ninth of the
sum of their sizes. PartEnum turns that into equality:

* Size bands. Sets that can link lie in one band of sizes or in neighbouring bands, so a
  set signs for its own band and, if a larger partner may lie there, for the next.
* Partitions. In a band whose pairs differ in at most k elements, the hash domain is cut
  into ``n1`` ranges, each of ``n2`` subranges. Some range differs in at most k2 elements,
  so some subset of n2 - k2 of its subranges is the same in both sets: each such subset is
  a signature. Small bands use n2 = 3, k2 = 1; large ones n2 = 1, k2 = 0, which gives
  the fewest signatures.
* Empty subsets would be shared by unrelated sets. There are spare ranges, and a set that
  surely agrees with any partner in a non-empty subset leaves its empty ones out; only
  sets that cannot be sure sign with them too.

Candidates are joined without all pairs of a group. Copies of one set are one node. In a
signature group first every member is compared with the smallest; the links found give
classes. Only where a group still spans several classes are members of different classes
compared, in blocks, and only if the counts of their elements per hash range (a lower
bound of their difference) allow a link. Each candidate is checked exactly on whole texts.

Defined results: shingles of fewer than five words are the whole word sequence; documents
without words or text are never linked; rows repeating an id are one node per text but share
the smallest label; a null id is its own class; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.settle import discard, settle
from . import bitmap
from . import words as wd
from .components import labels

WORDS, PERCENT = 5, 80
SMALL_BAND, GROWTH = 64, 1.6
SKETCH_BITS, BLOCK = 8, 1024
SKETCH = 1 << SKETCH_BITS
U64 = np.uint64
_STEP = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingles(hashes: np.ndarray, width: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a word sequence."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    total = np.full(n, width, U64)
    for j in range(width):
        total += wd.mix(hashes[j : j + n] + _STEP[j])
    return np.unique(wd.mix(total))


@cache
def bands(top: int) -> list[tuple[int, int]]:
    """Consecutive size bands (low, high) up to ``top``; a partner is at most a quarter larger,
    so a band's sets never link beyond the next band."""
    out, low = [], 1
    while low <= top:
        high = max(low * 100 // PERCENT, int(low * GROWTH) - 1 if low > 4 else low)
        out.append((low, high))
        low = high + 1
    return out


def difference(a: int, b: int) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


@cache
def scheme(high: int) -> tuple[int, int, int]:
    """(n1, n2, k2) of the band whose largest size is ``high``."""
    k = difference(high, high)
    if k == 0:
        return 1, 1, 0
    if high <= SMALL_BAND:
        return k // 2 + 2, 3, 1
    return int(0.24 * high) + 2, 1, 0


@lru_cache(maxsize=256)
def _layout(band: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Inner edges of a band's cells in the hash domain, and a value for each range."""
    n1, n2, _ = scheme(high)
    edges = (np.arange(1, n1 * n2, dtype=np.float64) * (2.0**64 / (n1 * n2))).astype(U64)
    return edges, wd.mix(np.arange(n1, dtype=U64) * U64(8) + U64(band << 40))


def _band_signatures(own: np.ndarray, prefix: np.ndarray, band: int, high: int, partner: int) -> np.ndarray:
    n1, n2, k2 = scheme(high)
    edges, places = _layout(band, high)
    bounds = np.concatenate([[0], np.searchsorted(own, edges), [len(own)]])
    sums = (prefix[bounds[1:]] - prefix[bounds[:-1]]).reshape(n1, n2)
    counts = np.diff(bounds).reshape(n1, n2)
    unsafe = ((counts > 0).sum(1) <= k2).sum()
    sure = n1 - difference(len(own), partner) // (k2 + 1) - unsafe >= 1
    out = []
    for left_out in range(n2 if k2 else 1):
        chosen = [q for q in range(n2) if not k2 or q != left_out]
        total = places + U64(left_out + 1)
        for q in chosen:
            total = total + wd.mix(sums[:, q] + _STEP[q])
        out.append(total if not sure else total[counts[:, chosen].sum(1) > 0])
    return wd.mix(np.concatenate(out)) >> U64(20)


def signatures(own: np.ndarray) -> np.ndarray:
    """PartEnum signatures of a sorted set, 44 bits each (a chance hit is only a candidate)."""
    n = len(own)
    prefix = np.zeros(n + 1, U64)
    np.cumsum(wd.mix(own + _STEP[4]), out=prefix[1:])
    all_bands = bands(2 * n + 8)
    band = next(i for i, (low, high) in enumerate(all_bands) if low <= n <= high)
    largest = n * 100 // PERCENT
    high = all_bands[band][1]
    out = [_band_signatures(own, prefix, band, high, min(high, largest))]
    if largest > high:
        out.append(_band_signatures(own, prefix, band + 1, all_bands[band + 1][1], largest))
    return np.unique(np.concatenate(out))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)) or not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, one, two, counts = [], [], [], []
        for d in wd.documents(batch.column(1), lower=True):
            own = shingles(d.hashes)
            sizes.append(len(own))
            one.append(own.sum(dtype=U64))
            two.append(wd.mix(own ^ _STEP[0]).sum(dtype=U64))
            cells = np.bincount((own >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=SKETCH)
            counts.append(np.minimum(cells, 255).astype(np.uint8).tobytes())
        as_long = lambda x: pa.array(np.array(x, U64).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), as_long(one), as_long(two), pa.array(counts, pa.binary())],
            ["doc_id", "n_shingles", "key_1", "key_2", "sketch"],
        )


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct set of a task signs once, under its first id there."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        found, counts = [], []
        for d in wd.documents(batch.column(1), lower=True):
            own = shingles(d.hashes)
            key = (int(own.sum(dtype=U64)), len(own))
            new = len(own) and key not in seen
            seen.add(key)
            found.append(signatures(own) if new else np.empty(0, U64))
            counts.append(len(found[-1]))
        rows = pa.array(np.repeat(np.arange(len(counts)), counts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([*found, np.empty(0, U64)]).view(np.int64)), batch.column(0).take(rows)], ["signature", "doc_id"]
        )


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, last, mine = [], None, None
        left, right = batch.column(2), batch.column(3)
        others = wd.documents(right, lower=True)
        ids = batch.column(0).to_pylist()
        for i, d in enumerate(others):
            if ids[i] != last:
                last = ids[i]
                mine = shingles(next(wd.documents(left.slice(i, 1), lower=True)).hashes)
            keep.append(linked(mine, shingles(d.hashes)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), SKETCH).astype(np.int16)


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose counts per hash range allow a link."""
    for batch in batches:
        apart = np.abs(_sketches(batch.column(4)) - _sketches(batch.column(5))).sum(1)
        total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        keep = pa.array(apart <= total * (100 - PERCENT) // (100 + PERCENT))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole texts link; ``pairs`` are read more than once."""
    texts = bitmap.among(docs.select("doc_id", "text"), "doc_id", pairs.select(F.explode(F.array("a", "b")).alias("id")), "id")
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_checked, "a long, b long").distinct()


def _cross_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (signature, cell_1, cell_2); a cell has two blocks at most. Compares each
    row with the k-th after it, for all rows at once, while both are in one cell."""
    held: list[pa.RecordBatch] = []

    def compared(t: pa.Table, cell: np.ndarray) -> pa.RecordBatch:
        block, node, label, size = (t.column(n).to_numpy() for n in ("block", "doc_id", "label", "n_shingles"))
        within = t.column("cell_1").to_numpy() == t.column("cell_2").to_numpy()
        sketch = _sketches(t.column("sketch").combine_chunks())
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        first, k = np.arange(t.num_rows), 0
        while len(first):
            k += 1
            first = first[first + k < t.num_rows]
            first = first[cell[first] == cell[first + k]]
            x, y = first, first + k
            may = (label[x] != label[y]) & (within[x] | (block[x] != block[y]))
            may &= 100 * np.minimum(size[x], size[y]) >= PERCENT * np.maximum(size[x], size[y])
            x, y = x[may], y[may]
            near = np.abs(sketch[x] - sketch[y]).sum(1) <= (size[x] + size[y]) * (100 - PERCENT) // (100 + PERCENT)
            left.append(node[x[near]])
            right.append(node[y[near]])
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([*held, batch])
        keys = [table.column(n).to_numpy() for n in ("signature", "cell_1", "cell_2")]
        new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        cell = np.concatenate([[0], np.cumsum(new)])
        whole = int(np.searchsorted(cell, cell[-1])) if table.num_rows else 0
        if whole:
            yield compared(table.slice(0, whole), cell[:whole])
        held = table.slice(whole).combine_chunks().to_batches()
    if held:
        rest = pa.Table.from_batches(held)
        yield compared(rest, np.zeros(rest.num_rows, np.int64))


def _leftover_pairs(groups: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of different classes in the signature groups that span several."""
    label = classes.select(F.col("node").alias("doc_id"), "label")
    members = groups.where("n >= 3").select("signature", "doc_id").join(label, "doc_id", "left").select(
        "signature", "doc_id", F.coalesce("label", "doc_id").alias("label")
    )
    w = Window.partitionBy("signature")
    blocked = members.select(
        "*", (F.min("label").over(w) < F.max("label").over(w)).alias("mixed"),
        F.floor((F.row_number().over(w.orderBy("doc_id")) - 1) / BLOCK).cast("int").alias("block"),
        F.floor((F.count("*").over(w) - 1) / BLOCK).cast("int").alias("top"),
    ).where("mixed")
    cells = blocked.select("*", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("with")).select(
        "signature", F.least("block", "with").alias("cell_1"), F.greatest("block", "with").alias("cell_2"), "block", "doc_id", "label"
    )
    keys = ["signature", "cell_1", "cell_2"]
    sketched = cells.join(sets.select("doc_id", "n_shingles", "sketch"), "doc_id").select(*keys, "block", "doc_id", "label", "n_shingles", "sketch")
    return sketched.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_cross_class, "a long, b long").distinct()


def join(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) for every document."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = docs.where("doc_id IS NOT NULL")
    sets = settle(docs.mapInArrow(_set_rows, "doc_id long, n_shingles long, key_1 long, key_2 long, sketch binary"))
    real = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    keys = ["key_1", "key_2", "n_shingles"]
    copies = real.join(real.groupBy(*keys).agg(F.min("doc_id").alias("a")), keys).where("a < doc_id").select("a", F.col("doc_id").alias("b"))
    signed = named.mapInArrow(_signature_rows, "signature long, doc_id long")
    w = Window.partitionBy("signature")
    groups = settle(
        signed.select("signature", "doc_id", F.min("doc_id").over(w).alias("hub"), F.count("*").over(w).alias("n")).where("n >= 3 OR hub < doc_id")
    )
    stars = settle(groups.where("hub < doc_id").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct())
    grouped = bitmap.among(real.select("doc_id", "n_shingles", "sketch"), "doc_id", stars.select(F.explode(F.array("a", "b")).alias("id")), "id")
    sized = lambda c: grouped.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    near = stars.join(sized("a"), "a").join(sized("b"), "b")
    near = near.where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    pairs = settle(near.mapInArrow(_possible, "a long, b long"))
    links = settle(verified(pairs, named).unionByName(copies))
    classes = labels(links)
    more = settle(_leftover_pairs(groups, classes, grouped))
    rest = settle(verified(more, named))
    discard(pairs, more, groups, stars)
    if rest.limit(1).count():
        classes = labels(links.unionByName(rest))
    named_label = classes.select(F.col("node").alias("doc_id"), "label")
    return sets.join(named_label, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id")
    )
