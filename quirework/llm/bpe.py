"""Byte-level BPE as a bounded-lookahead transducer, and its decoder as a state machine.

Merges apply by rank, so a token boundary depends on text to its right only as far as
chains of higher-ranked merges reach. :func:`lookahead_of` computes that reach for a merge
list: rule t = (u, v) looks across v, and further where an earlier rule can take the end
of v away, that is a rule whose left part is v or a token on v's right edge. The encoder reads a piece
of text in blocks, merges what it holds, emits the tokens that end at least that many bytes
before the end of the buffer, since nothing that follows can change them, and keeps only the
rest. Its memory is a few lookaheads however long a piece is; usual pieces fit in one
block and come from a bounded table of recent pieces.

Decoding feeds the bytes of ids, block by block, to a machine that holds at most the
unfinished bytes of one character; ill-formed bytes give U+FFFD as in the tokenizers library.

The vocabulary file is a parameter: its path must name the same file on every executor.

Defined results: a null or empty text has no ids and decodes to the empty text; the strings
of special tokens inside a text are their single ids, as in the library; repeated rows are
encoded each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

# Fixed value: the public pattern that splits text before the merges.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: A piece always begins at a space between two solid characters.
SAFE_CUT = regex.compile(r"(?<=\S) (?=\S)")
SEGMENT, RECENT, BLOCK_BYTES, FEED_IDS = 1 << 16, 500_000, 1 << 22, 1 << 16


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: bytes that print as
    themselves keep their code point, the others get those from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def lookahead_of(rules: list[tuple[int, int, int]], length: dict[int, int]) -> int:
    """Sufficient lookahead in bytes of rules (left, right, merged) in rank order."""
    right_part: dict[int, int] = {}
    reach: dict[int, int] = {}
    most = 0
    for left, right, merged in rules:
        edge, beyond = right, 0
        while edge is not None:
            beyond = max(beyond, reach.get(edge, 0))
            edge = right_part.get(edge)
        own = length[right] + beyond
        reach[left] = max(reach.get(left, 0), own)
        right_part[merged] = right
        most = max(most, own)
    return most


class Transducer:
    """Encoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, letters = model["model"]["vocab"], byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes_of = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.first = [vocab[c] for c in letters]
        rules = []
        for pair in model["model"]["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            rules.append((vocab[left], vocab[right], vocab[left + right]))
        self.rank_of = {(a, b): rank for rank, (a, b, _) in enumerate(rules)}
        self.made = [merged for _, _, merged in rules]
        self.lookahead = lookahead_of(rules, {i: len(b) for i, b in self.bytes_of.items()})
        names = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.recent: dict[str, tuple[int, ...]] = {}

    def merged(self, ids: list[int]) -> list[int]:
        """All merges of a short buffer, best rank first, leftmost first within a rank."""
        rank_of, never = self.rank_of.get, len(self.made)
        ranks = [rank_of(pair, never) for pair in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            ids[i] = self.made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), never)
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), never)
        return ids

    def piece(self, raw: bytes) -> Iterator[int]:
        """Tokens of one piece, emitted once no later byte can change them."""
        block, held = 2 * self.lookahead, b""
        for at in range(0, len(raw), block):
            held += raw[at : at + block]
            tokens = self.merged([self.first[b] for b in held])
            if at + block >= len(raw):
                yield from tokens
                return
            done = 0
            for t in tokens:
                if done + len(self.bytes_of[t]) > len(held) - self.lookahead:
                    break
                done += len(self.bytes_of[t])
                yield t
            held = held[done:]

    def plain(self, text: str, out: list[int]) -> None:
        """Text without special tokens, in segments that end where a piece begins."""
        at, recent = 0, self.recent
        while at < len(text):
            cut = SAFE_CUT.search(text, at + SEGMENT) if len(text) - at > SEGMENT else None
            end = cut.start() if cut else len(text)
            for p in PIECES.findall(text, at, end) if cut else PIECES.findall(text, at):
                ids = recent.get(p)
                if ids is None:
                    raw = p.encode()
                    ids = tuple(self.piece(raw))
                    if len(raw) <= 64:
                        if len(recent) >= RECENT:
                            recent.clear()
                        recent[p] = ids
                out += ids
            at = end

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                out.append(self.special[part])
            elif part:
                self.plain(part, out)
        return out


class TextMachine:
    """Bytes in, text out; between calls it holds the unfinished bytes of one character."""

    def __init__(self):
        self.held = b""

    def feed(self, raw: bytes, last: bool = False) -> str:
        raw = self.held + raw
        end = len(raw)
        if not last:
            for back in range(1, min(3, len(raw)) + 1):
                b = raw[-back]
                if b >= 0xC0:  # a character begins here: is it whole?
                    end -= back if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4) else 0
                    break
                if b < 0x80:
                    break
        self.held = raw[end:]
        return raw[:end].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


@lru_cache(maxsize=2)
def id_bytes(path: str) -> pa.Array:
    table = transducer(path).bytes_of
    return pa.array([table.get(i, b"") for i in range(max(table) + 1)], pa.binary())


def _slices(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, stop - at
        at = stop


def _encode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            texts = batch.column(1)
            for at, n in _slices(texts):
                parts = [np.array(machine.encode(t) if t else [], np.int32) for t in texts.slice(at, n).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), ids], ["doc_id", "ids"])

    return run


def decode_ids(path: str, ids: pa.Array) -> str:
    machine, table = TextMachine(), id_bytes(path)
    out = []
    for at in range(0, len(ids), FEED_IDS):
        _, offsets, data = table.take(ids.slice(at, FEED_IDS)).buffers()
        out.append(machine.feed(data.to_pybytes() if data else b"", False))
    out.append(machine.feed(b"", True))
    return "".join(out)


def _decode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            joined = pc.binary_join(lists.cast(pa.list_(pa.string())), ",") if len(lists) else pa.array([], pa.string())
            texts = [decode_ids(path, lists[i].values) for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.list_value_length(lists).cast(pa.int64()), joined, pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_text", "decoded"],
            )

    return run


def encode(documents: DataFrame, path: str) -> DataFrame:
    """Documents (doc_id, text) to (doc_id, ids)."""
    rows = documents.select("doc_id", "text")
    return rows.mapInArrow(_encode_rows(path), f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, n_tokens, ids_text, decoded); ``ids_text`` joins the ids by commas."""
    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(_decode_rows(path), f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_text string, decoded string")
