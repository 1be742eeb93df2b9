"""Words of Arrow text columns as 64-bit hashes, computed on whole byte buffers.

Words are maximal runs of bytes other than space and 0x09 to 0x0D. A word's hash is a
polynomial over a fixed random value per byte, mixed with its length; it does not depend
on where the word stands. Nothing here holds more than one slice of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n modulo 2^64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n, SLICE_BYTES) + 1, base, U64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive values: one prefix sum, then one
    difference per window, moved to a common exponent by the inverse of the base."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(base, len(values))[: len(values)], out=sums[1:])
    return mix((sums[width:] - sums[:n]) * powers(pow(base, -1, 2**64), n)[:n])


def find(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``data``; a word ends at the latest at a cut."""
    solid = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=solid[1:-1])
    starts = solid[1:] & ~solid[:-1]
    ends = solid[:-1] & ~solid[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    joined = inner[solid[inner] & solid[inner + 1]]
    starts[joined] = True
    ends[joined] = True
    return np.flatnonzero(starts), np.flatnonzero(ends)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, i, base = np.empty(len(starts), U64), 0, BASES[0]
    inverse = pow(base, -1, 2**64)
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + SLICE_BYTES, "right")))
        part = data[lo : ends[j - 1]]
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(_BYTE[part] * powers(base, len(part))[: len(part)], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * powers(inverse, len(part))[s] + (e - s).astype(U64))
        i = j
    return out


class Words:
    """The words of one document: hashes, and byte places in ``data``, where its UTF-8 text
    stands from ``low`` to ``high``."""

    __slots__ = ("row", "data", "low", "high", "starts", "ends", "hashes")

    def __init__(self, row, data, low, high, starts, ends, hashed):
        self.row, self.data, self.low, self.high = row, data, low, high
        self.starts, self.ends, self.hashes = starts, ends, hashed

    def __len__(self) -> int:
        return len(self.starts)


def documents(texts: pa.Array, lower: bool = False) -> Iterator[Words]:
    """The words of every text, in order; a null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(cuts, cuts[row] + SLICE_BYTES, "right")) - 1)
        part = data[cuts[row] : cuts[last]]
        if lower:
            part = _LOWER[part]
        own = cuts[row : last + 1] - cuts[row]
        starts, ends = find(part, own)
        hashed = hashes(part, starts, ends)
        edges = np.searchsorted(starts, own)
        for k in range(last - row):
            a, b = edges[k], edges[k + 1]
            yield Words(row + k, part, own[k], own[k + 1], starts[a:b], ends[a:b], hashed[a:b])
        row = last
