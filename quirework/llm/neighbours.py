"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Each vector is turned by a random orthonormal map into ``BITS_PER_DIM`` times its dimensions
and keeps the signs, packed, with two correction scalars: its norm and the cosine between
it and its code. The code gives an unbiased estimate of an inner product, with an error
that is below ``SIGMAS`` standard deviations almost always. A candidate is reranked on the
original vectors in double precision exactly when its upper bound reaches the k-th best
lower bound, so the bounds and no fixed number choose what is reranked.

All rows are indexed and all are scanned. Queries and candidates meet in cells of at most
``QUERY_BLOCK`` queries and ``GROUP`` candidates; a cell streams its candidates and keeps k
per query. Of equal vectors only the k + 1 smallest ids can be among k nearest, so only
those are candidates, however often a vector is repeated.

Defined results: rows whose id or vector is null, or whose vector is empty, zero or holds
null or non-finite components take no part; vectors are compared with those of their own
length; ties go to the smaller id; a query is never its own neighbour, also where its id is
repeated; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS_PER_DIM, SIGMAS, SEED = 4, 1.9, 11
QUERY_BLOCK, GROUP, SCAN = 1024, 16_384, 4096


@lru_cache(maxsize=4)
def rotation(dim: int, bits: int) -> np.ndarray:
    """A random matrix of ``dim`` orthonormal rows and ``bits`` columns."""
    g = np.random.default_rng(SEED).standard_normal((bits, dim))
    return np.linalg.qr(g)[0].T.astype(np.float32)


def bits_of(dim: int) -> int:
    return 8 * math.ceil(dim * BITS_PER_DIM / 8)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, cosine between vector and code, norm."""
    bits = bits_of(x.shape[1])
    norm = np.sqrt((x * x).sum(1))
    turned = (x / norm[:, None]).astype(np.float32) @ rotation(x.shape[1], bits)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.float32(math.sqrt(bits)), norm


def bounds(q: np.ndarray, codes: np.ndarray, cosine: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries by candidates) and their error bounds."""
    bits = 8 * codes.shape[1]
    signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    scale = (norm / (cosine * math.sqrt(bits))).astype(np.float32)
    estimate = (q.astype(np.float32) @ rotation(q.shape[1], bits)) @ signs.T * scale
    spread = SIGMAS * norm * np.sqrt(np.maximum(0, 1 - cosine**2)) / (cosine * math.sqrt(bits - 1))
    return estimate, np.sqrt((q * q).sum(1))[:, None].astype(np.float32) * spread.astype(np.float32) + np.float32(1e-5)


class Best:
    """The k best of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.found = [(np.empty(0), np.empty(0, np.int64))] * len(ids)
        self.bar = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, cosine: np.ndarray, norm: np.ndarray) -> None:
        estimate, error = bounds(self.vectors, codes, cosine, norm)
        bar = self.bar.astype(np.float32) - np.float32(1e-5)
        if len(ids) > self.k:  # one more, as the query itself may be among them
            place = len(ids) - self.k - 1
            bar = np.maximum(bar, np.partition(estimate - error, place, axis=1)[:, place])
        chosen = estimate + error >= bar[:, None]
        for i in range(len(self.ids)):
            at = np.flatnonzero(chosen[i])
            at = at[ids[at] != self.ids[i]]
            if not len(at):
                continue
            score = np.concatenate([self.found[i][0], (x[at] * self.vectors[i]).sum(1)])
            name = np.concatenate([self.found[i][1], ids[at]])
            if len(score) > 4 * self.k:
                least = np.partition(score, len(score) - self.k)[len(score) - self.k]
                keep = score >= least
                score, name = score[keep], name[keep]
            order = np.lexsort((name, -score))[: self.k]
            self.found[i] = (score[order], name[order])
            if len(order) == self.k:
                self.bar[i] = score[order[-1]]

    def rows(self) -> pa.RecordBatch:
        counts = [len(s) for s, _ in self.found]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(self.ids, counts)), pa.array(np.concatenate([n for _, n in self.found] + [np.empty(0, np.int64)])),
                pa.array(np.concatenate([s for s, _ in self.found] + [np.empty(0)])),
            ],
            ["query_id", "vec_id", "score"],
        )


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lists = batch.columns
        dims = np.diff(np.asarray(lists.offsets))
        for dim in np.unique(dims).tolist():
            rows = pa.array(np.flatnonzero(dims == dim))
            own = lists.take(rows)
            codes, cosine, norm = encode(_matrix(own))
            yield pa.RecordBatch.from_arrays(
                [ids.take(rows), own, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cosine.astype(np.float64)), pa.array(norm)],
                ["vec_id", "embedding", "code", "cosine", "norm"],
            )


def _cell_rows(k: int):
    """Rows sorted by (dim, block, part, is_candidate): a cell's queries, then its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries, best = None, [], None
        for batch in batches:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in keys], axis=0)) + 1
            cuts = [0, *edges.tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                here, candidates = tuple(c[a] for c in keys[:3]), bool(keys[3][a])
                if here != cell:
                    if best is not None:
                        yield best.rows()
                    cell, queries, best = here, [], None
                ids, x = batch.column(4).slice(a, b - a).to_numpy(), _matrix(batch.column(5).slice(a, b - a))
                if not candidates:
                    queries.append((ids, x))
                elif queries or best is not None:
                    if best is None:
                        best = Best(np.concatenate([q[0] for q in queries]), np.concatenate([q[1] for q in queries]), k)
                    for s in range(0, b - a, SCAN):
                        n = min(SCAN, b - a - s)
                        code = np.frombuffer(b"".join(batch.column(6).slice(a + s, n).to_pylist()), np.uint8).reshape(n, -1)
                        cosine, norm = (batch.column(c).slice(a + s, n).to_numpy() for c in (7, 8))
                        best.add(ids[s : s + n], x[s : s + n], code, cosine, norm)
        if best is not None:
            yield best.rows()

    return run


def usable(vector: Column) -> Column:
    x = F.coalesce(vector.cast("array<double>"), F.array().cast("array<double>"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return finite & F.exists(x, lambda v: v != 0)


def index(embeddings: DataFrame) -> DataFrame:
    """Every usable row with its code and correction scalars."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).mapInArrow(
        _index_rows, "vec_id long, embedding array<float>, code binary, cosine double, norm double"
    )


def search(embeddings: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of the k nearest of every usable query row."""
    indexed = index(embeddings)
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    candidates = indexed.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    n = embeddings.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    blocks, groups = max(1, math.ceil(n["q"] / QUERY_BLOCK)), max(1, math.ceil(n["n"] / GROUP))
    block = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int")
    group = F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(groups)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    rest = ["vec_id", "embedding", "code", "cosine", "norm"]
    dim = F.size("embedding").alias("dim")
    cells = (
        indexed.where(is_query).select(dim, block.alias("block"), every(groups).alias("part"), F.lit(False).alias("candidate"), *rest)
        .unionByName(candidates.select(dim, every(blocks).alias("block"), group.alias("part"), F.lit(True).alias("candidate"), *rest))
    )
    keys = ["dim", "block", "part"]
    found = cells.repartition(*keys).sortWithinPartitions(*keys, "candidate").mapInArrow(
        _cell_rows(k), "query_id long, vec_id long, score double"
    ).distinct()
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
