"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Pieces come in descending length; each goes into
the open bin that it fills best. Where none has room, a bin is opened: for every permitted
size the bin's filling with the pieces still to come is tried, and the size with the least cost per
unit of content (padding plus a fixed cost per sequence) is opened. When all are placed, every bin is
downsized to the smallest permitted length that holds its contents.

Documents longer than the largest size are cut into pieces of that size; nothing is left
out. Pieces are dealt by hash to groups of about ``GROUP_PIECES``, which are packed
independently: a task holds one group (lengths and ids, no texts), and there are more groups where
there are more documents. The place of a stored piece is part of the hash, so rows that share
an id, even a third of all, spread like others. :func:`sequences` joins the words of the pieces.

Defined results: a null or empty text is one piece of the length of its end mark; repeated
rows are packed each; ids are integers (text ids are cast, those that are no numbers fail); a
null id stays null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.settle import settle
from . import words as wd

CAPACITIES = (512, 1024, 2048, 4096)
SEQUENCE_COST = 16
GROUP_PIECES = 20_000
WORD = r"[^\x20\x09-\x0D]+"


class Packer:
    """One group: pieces by descending length in, bins out."""

    def __init__(self, lengths: list[int], capacities: tuple[int, ...]):
        self.capacities = sorted(capacities)
        self.left = Counter(lengths)
        self.sizes = sorted(self.left)
        self.rooms: list[int] = []  # distinct free spaces of open bins, ascending
        self.by_room: dict[int, list[int]] = {}
        self.used: list[int] = []
        self.capacity: list[int] = []

    def filling(self, room: int) -> int:
        """How much of a free space the pieces to come would fill, largest first."""
        filled, taken = 0, Counter()
        i = len(self.sizes)
        while room > 0:
            i = bisect_right(self.sizes, room, 0, i)
            if not i:
                break
            size = self.sizes[i - 1]
            n = min(self.left[size] - taken[size], room // size)
            if n <= 0:
                i -= 1
                continue
            taken[size] += n
            filled += n * size
            room -= n * size
            if taken[size] >= self.left[size]:
                i -= 1
        return filled

    def opened(self, length: int) -> int:
        """Capacity of least cost per unit of content for a new bin that starts with ``length``."""
        best, least = self.capacities[-1], math.inf
        for c in self.capacities:
            if c >= length:
                content = length + self.filling(c - length)
                shrunk = next(x for x in self.capacities if x >= content)
                cost = (shrunk - content + SEQUENCE_COST) / content
                if cost < least:
                    best, least = c, cost
        return best

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of the next piece."""
        self.left[length] -= 1
        if not self.left[length]:
            del self.left[length]
            self.sizes.pop(bisect_left(self.sizes, length))
        at = bisect_left(self.rooms, length)
        if at < len(self.rooms):
            room = self.rooms[at]
            bins = self.by_room[room]
            number = bins.pop()
            if not bins:
                del self.by_room[room]
                self.rooms.pop(at)
        else:
            number, room = len(self.used), self.opened(length)
            self.used.append(0)
            self.capacity.append(room)
        offset, room = self.used[number], room - length
        self.used[number] += length
        if room:
            if room not in self.by_room:
                insort(self.rooms, room)
            self.by_room.setdefault(room, []).append(number)
        return number, offset

    def final_capacity(self, number: int) -> int:
        return next(c for c in self.capacities if c >= self.used[number])


def _packed_rows(capacities: tuple[int, ...]):
    """Pieces sorted by group and descending length; a group is written when it is complete."""

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        packer = Packer([r[4] for r in rows], capacities)
        placed = [packer.place(r[4]) for r in rows]
        columns = [
            [r[0] for r in rows], [n for n, _ in placed], [packer.final_capacity(n) for n, _ in placed], [o for _, o in placed],
            [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows],
        ]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        names = ["group", "bin", "capacity", "offset", "doc_id", "piece", "first", "length", "unit"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][0] != row[0]:
                    yield pack(held)
                    held = []
                held.append(row)
        if held:
            yield pack(held)

    return run


def unit(text: Column) -> Column:
    """What tells rows of another id or text apart."""
    return F.xxhash64("doc_id", text)


def lengths(documents: DataFrame) -> DataFrame:
    """(doc_id, length, unit): words of the whole text and one for its end mark."""
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", (F.regexp_count(text, F.lit(WORD)) + 1).cast("long").alias("length"), unit(text).alias("unit"))


def pack(measured: DataFrame, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """Rows (group, bin, capacity, offset, doc_id, piece, first, length, unit) of (doc_id, length,
    unit): where in a sequence of ``capacity`` the units from ``first`` on of a document stand."""
    largest = max(capacities)
    pieces = settle(
        measured.select("doc_id", "length", "unit", F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / largest).cast("int") - 1)).alias("piece"))
        .select(
            F.col("doc_id").cast("long").alias("doc_id"), "piece", (F.col("piece").cast("long") * largest).alias("first"),
            F.least(F.lit(largest), F.col("length") - F.col("piece").cast("long") * largest).cast("int").alias("length"), "unit",
            F.monotonically_increasing_id().alias("place"),
        )
    )
    groups = max(1, math.ceil(pieces.count() / GROUP_PIECES))
    dealt = pieces.select(F.pmod(F.xxhash64("place", "piece", F.lit(9)), F.lit(groups)).alias("group"), "doc_id", "piece", "first", "length", "unit")
    return dealt.repartition("group").sortWithinPartitions("group", F.desc("length"), "doc_id", "piece", "unit").mapInArrow(
        _packed_rows(capacities), "group long, bin long, capacity int, offset int, doc_id long, piece int, first long, length int, unit long"
    )


def _piece_rows(largest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, rows, numbers, texts = batch.column(batch.schema.get_field_index("unit")), [], [], []
            for d in wd.documents(batch.column(batch.schema.get_field_index("text"))):
                raw = d.data.tobytes() if len(d) else b""
                for piece in range(len(d) // largest + 1):
                    own = slice(piece * largest, (piece + 1) * largest)
                    rows.append(d.row)
                    numbers.append(piece)
                    texts.append(b" ".join([raw[s:e] for s, e in zip(d.starts[own].tolist(), d.ends[own].tolist(), strict=True)]).decode())
            yield pa.RecordBatch.from_arrays(
                [units.take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], ["unit", "piece", "text"]
            )

    return run


def sequences(documents: DataFrame, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """:func:`pack` with the ``text`` of every piece, its words joined by one space. A sequence is
    the pieces of one (group, bin) by ``offset``, an end mark behind the last piece of each document."""
    text = F.coalesce("text", F.lit(""))
    once = documents.select(text.alias("text"), unit(text).alias("unit")).mapInArrow(_piece_rows(max(capacities)), "unit long, piece int, text string")
    # Rows that repeat id and text have one text between them; their pieces are placed each.
    texts = once.groupBy("unit", "piece").agg(F.first("text").alias("text"))
    placed = pack(lengths(documents), capacities)
    return placed.join(texts, ["unit", "piece"]).select(*[c for c in placed.columns if c != "unit"], "text")
