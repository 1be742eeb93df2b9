"""Periodic runs: stretches of a text whose words repeat with a period.

A run of period q is a stretch in which words q apart are identical, at least max(12, 2 q)
words long, that no neighbouring word extends. Seen by its matches (places i whose word equals
the word at i + q) it is a maximal interval of at least max(q, 12 - q) places. The
periods from 1 to 7 and then every doubling, 8 to 15, 16 to 31 and so on, are an octave.

1. Every document is cut into overlapping tiles per octave. Boundaries stand every ``step``
   words, so every interval of matches holds one; a boundary needs ``reach`` words on either
   side and one more period. A boundary counts only if some gram of half the least interval,
   before or behind it, comes again at a distance of the octave: that is compared for all
   boundaries at once by rolling hashes and can pass too many, never too few. Tiles of
   boundaries that count become rows and are dealt over the cluster, so that the tiles of a long
   document are solved by many tasks; a tile is as long as a few periods.
2. A tile is solved by two Z-functions at each boundary, of the words behind it and, reversed,
   of those before it: how far the match at distance q goes on to either side. A period with a
   divisor that is a period too is left out; it is the same run seen again. Words are compared
   by numbers of their own in the document, so this is exact up to 64-bit hashes of words.
3. The fragments are shuffled by document and period, and those that overlap are stitched to
   the whole run, also across tiles.

Defined results: null and empty texts have no words and no runs; rows that repeat an id and
text get the same runs each; a null id is an id like others; an empty table gives no rows;
further columns are ignored unless named in ``more``, which must not hold names of the columns
that are added here (put them into one struct).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.settle import settle
from . import bitmap
from . import words as wd

LEAST, FIRST_OCTAVE, TILE_WORDS, MANY = 12, 8, 8192, 16
U64 = np.uint64


class Octave:
    """The periods ``low`` to ``high - 1`` and the geometry of their tiles."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high
        needs = [self.need(low), self.need(high - 1)] if low >= LEAST // 2 else [self.need(q) for q in range(low, high)]
        self.step = min(needs)
        self.reach = max(2 * self.step, max(needs))
        self.gram = -(-self.step // 2)

    @staticmethod
    def need(period: int) -> int:
        """The fewest matches that a run of this period has."""
        return max(period, LEAST - period)


def octaves(n_words: int) -> Iterator[Octave]:
    low, high = 1, FIRST_OCTAVE
    while n_words >= max(LEAST, 2 * low):
        yield Octave(low, high)
        low, high = high, 2 * high


class Grams:
    """Rolling hashes of all grams of a document, of any width, from one prefix sum."""

    def __init__(self, hashes: np.ndarray):
        n, base = len(hashes), wd.BASES[0]
        self.inverse = wd.powers(pow(base, -1, 2**64), n)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(hashes * wd.powers(base, n)[:n], out=self.sums[1:])

    def of(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.inverse[:n]


def candidates(grams: Grams, octave: Octave) -> tuple[np.ndarray, np.ndarray]:
    """(boundaries, periods): the pairs at which a run of the octave may be seen, by boundary."""
    own, low, wide, step = grams.of(octave.gram), octave.low, octave.high - octave.low, octave.step
    padded = np.concatenate([own, np.zeros(wide + low, U64)])
    found = []
    for first in (0, -(-octave.gram // step) * step):  # grams behind the boundary, and before it
        at = 0 if first == 0 else first - octave.gram
        here = own[at : len(own) - low : step]
        if len(here):
            there = np.ndarray((len(here), wide), U64, padded, 8 * (at + low), (8 * step, 8))
            same = there == here[:, None]
            if same.any():
                place, period = np.nonzero(same)
                found.append((place * step + first) * wide + period)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    both = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
    return both // wide, both % wide + low


def tiles(d: wd.Words, tile_words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(low, base, marks, periods, words): the boundaries of one octave in up to ``tile_words`` words
    that count, as places in the tile, each with a period that may be seen there; the tile
    begins at word ``base`` and has its words as numbers."""
    grams, numbers = None, None
    for octave in octaves(len(d)):
        grams = grams or Grams(d.hashes)
        found, periods = candidates(grams, octave)
        if not len(found):
            continue
        if numbers is None:
            numbers = np.unique(d.hashes, return_inverse=True)[1].astype(np.int32)
        tile = found // max(octave.step, tile_words)
        cuts = np.flatnonzero(np.diff(tile)) + 1
        for part, asked in zip(np.split(found, cuts), np.split(periods, cuts), strict=True):
            base = max(0, int(part[0]) - octave.reach)
            words = numbers[base : int(part[-1]) + octave.reach + octave.high]
            yield octave.low, base, (part - base).astype(np.int32), asked.astype(np.int32), words


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    flat = pa.array(np.concatenate([*parts, np.empty(0, np.int32)]))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), flat)


def _tile_rows(tile_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("row_key"))
            out = [(d.row, *t) for d in wd.documents(batch.column(batch.schema.get_field_index("text"))) for t in tiles(d, tile_words)]
            rows, lows, bases, *lists = zip(*out, strict=True) if out else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(rows, pa.int64())), pa.array(lows, pa.int32()), pa.array(bases, pa.int32()), *map(_lists, lists)],
                ["row_key", "low", "base", "marks", "periods", "words"],
            )

    return run


def z_function(s: list[int], upto: int) -> list[int]:
    """How far the text from each of the first ``upto`` places agrees with its beginning."""
    n = len(s)
    upto = min(upto, n)
    z, left, right = [n] + [0] * (upto - 1), 0, 0
    for i in range(1, upto):
        k = min(z[i - left], right - i) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


@lru_cache(maxsize=1 << 16)
def largest_divisors(q: int) -> tuple[int, ...]:
    """q divided by each of its prime factors: any period of a block that divides q divides one."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return (*out, q // rest) if rest > 1 else tuple(out)


class Tile:
    """The two Z-functions of the boundaries of a tile, ``ahead`` and ``behind``: how many words after,
    or before, the boundary agree with those q words later. Values are found singly where few are
    asked for, all at once where many are. Inside a run all agree, which one comparison of
    bytes tells."""

    def __init__(self, words: np.ndarray, octave: Octave):
        self.words, self.raw, self.octave, self.reach = words, words.tobytes(), octave, octave.reach
        self.text: list[int] | None = None

    def same(self, a: int, b: int, n: int) -> bool:
        return self.raw[4 * a : 4 * (a + n)] == self.raw[4 * b : 4 * (b + n)]

    def ahead(self, at: int, q: int) -> int:
        n = min(self.reach, len(self.words) - at - q)
        if n <= 0 or self.same(at, at + q, n):
            return max(n, 0)
        return int((self.words[at : at + n] != self.words[at + q : at + q + n]).argmax())

    def behind(self, at: int, q: int) -> int:
        n = min(self.reach, at)
        if n == 0 or self.same(at - n, at + q - n, n):
            return n
        return int((self.words[at - n : at] != self.words[at + q - n : at + q])[::-1].argmax())

    def all_values(self, at: int) -> tuple[list[int], list[int]]:
        self.text = self.text or self.words.tolist()
        low, high = max(0, at - self.reach), min(self.octave.high, len(self.words) - at + 1)
        before = self.text[low:at]
        turned = [*reversed(before), -1, *reversed(self.text[low : at + high - 1])]
        back = z_function(turned, len(before) + high + 1)
        # The value of the place where the words up to q words behind the boundary begin, read backwards.
        behind = [0, *(min(self.reach, back[len(before) + high - q]) for q in range(1, high))]
        on = z_function(self.text[at : at + self.reach + high], high)
        return [min(self.reach, z) for z in on] + [0] * (high - len(on)), behind

    def fragments(self, at: int, periods: list[int]) -> Iterator[tuple[int, int, int]]:
        """(period, from, to) of the matches around a boundary, as far as the reach goes."""
        values = self.all_values(at) if len(periods) > MANY else None
        for q in periods:
            if at + q > len(self.words):
                continue
            on, back = (values[0][q], values[1][q]) if values else (self.ahead(at, q), self.behind(at, q))
            if back + on >= self.octave.need(q) and not any(self.same(at, at + d, q - d) for d in largest_divisors(q)):
                yield q, at - back, at + on


def _fragment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, lows, bases, marks, periods, words = batch.columns
        out: list[tuple[int, int, int, int]] = []
        for row in range(len(batch)):
            low, base, tile = lows[row].as_py(), bases[row].as_py(), np.asarray(words[row].values)
            solver = Tile(tile, Octave(low, FIRST_OCTAVE if low == 1 else 2 * low))
            last: dict[int, list[int]] = {}
            places, asked = np.asarray(marks[row].values), np.asarray(periods[row].values)
            cuts = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), len(places)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                for q, start, end in solver.fragments(int(places[i]), asked[i:j].tolist()):
                    held = last.get(q)
                    if held and start <= held[1]:
                        held[1] = max(held[1], end)
                        continue
                    if held:
                        out.append((row, q, base + held[0], base + held[1]))
                    last[q] = [start, end]
            out.extend((row, q, base + a, base + b) for q, (a, b) in last.items())
        rows, periods, starts, ends = zip(*out, strict=True) if out else ((),) * 4
        yield pa.RecordBatch.from_arrays(
            [keys.take(pa.array(rows, pa.int64())), pa.array(periods, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
            ["row_key", "period", "from", "to"],
        )


def stitched(found: DataFrame) -> DataFrame:
    """(row_key, runs): fragments of one document and period that overlap are one run."""
    w = Window.partitionBy("row_key", "period").orderBy("from")
    once = found.groupBy("row_key", "period", "from").agg(F.max("to").alias("to"))
    reached = once.withColumn("reached", F.max("to").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    numbered = reached.withColumn("island", F.count(F.when(F.col("reached").isNull() | (F.col("from") > F.col("reached")), 1)).over(w))
    whole = numbered.groupBy("row_key", "period", "island").agg(F.min("from").alias("start"), F.max("to").alias("to"))
    run = F.struct("start", "period", (F.col("to") - F.col("start") + F.col("period")).alias("length"))
    return whole.groupBy("row_key").agg(F.array_sort(F.collect_list(run)).alias("runs"))


def row_key(text: Column) -> Column:
    """128 bits that tell rows with another id or text apart."""
    return F.unhex(F.md5(F.concat_ws("\x00", F.col("doc_id").cast("string"), text)))


def find_runs(documents: DataFrame, tile_words: int = TILE_WORDS) -> DataFrame:
    """Rows (row_key, runs) of the documents that have runs: ``runs`` is an array of
    (start, period, length) by start, then period."""
    text = F.coalesce("text", F.lit(""))
    dealt = documents.select(row_key(text).alias("row_key"), text.alias("text")).mapInArrow(
        _tile_rows(tile_words), "row_key binary, low int, base int, marks array<int>, periods array<int>, words array<int>"
    )
    # A fixed number: tiles are small but costly, so partitions must not be joined by their bytes.
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    solved = dealt.repartition(parts, "row_key", "low", "base").mapInArrow(_fragment_rows, "row_key binary, period long, from long, to long")
    return stitched(solved)


def _collapsed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = batch.column(batch.schema.get_field_index("runs"))
        totals, kept = [], []
        for d in wd.documents(batch.column(batch.schema.get_field_index("text"))):
            keep, own = np.ones(len(d), bool), runs[d.row].values
            if own is not None and len(own):
                starts, periods, lengths = (np.asarray(own.field(c)) for c in ("start", "period", "length"))
                drops = np.zeros(len(d) + 1, np.int64)
                np.add.at(drops, starts + periods, 1)
                np.add.at(drops, starts + lengths, -1)
                keep = np.cumsum(drops)[:-1] == 0
            raw = d.data.tobytes() if len(d) else b""
            totals.append(len(d))
            kept.append(b" ".join([raw[s:e] for s, e in zip(d.starts[keep].tolist(), d.ends[keep].tolist(), strict=True)]).decode())
        own = [n for n in batch.schema.names if n != "text"]
        columns = [batch.column(batch.schema.get_field_index(n)) for n in own]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(kept, pa.string())], [*own, "n_words", "kept"])


def collapse(documents: DataFrame, *more: str, tile_words: int = TILE_WORDS) -> DataFrame:
    """Rows (doc_id, more columns, runs, n_words, kept) for every document. ``kept`` has the
    words without the repeats in runs, that is behind the first period of each, joined by one space."""
    found = settle(find_runs(documents, tile_words))
    text = F.coalesce("text", F.lit(""))
    rows = bitmap.marked(documents.select("doc_id", *more, text.alias("text"), row_key(text).alias("row_key")), "row_key", found, "row_key")
    none = F.array().cast(found.schema["runs"].dataType)
    sure = rows.where("not maybe").select("doc_id", *more, "text", none.alias("runs"))
    unsure = rows.where("maybe").join(found, "row_key", "left").select("doc_id", *more, "text", F.coalesce("runs", none).alias("runs"))
    all_rows = sure.unionByName(unsure)
    own = [f for f in all_rows.schema if f.name != "text"]
    return all_rows.mapInArrow(
        _collapsed_rows, T.StructType([*own, T.StructField("n_words", T.LongType()), T.StructField("kept", T.StringType())])
    )
