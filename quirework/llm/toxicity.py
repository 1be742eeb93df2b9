"""Toxicity by Levenshtein automata intersected with a lexicon trie.

The lexicon is learned from a bounded sample of labelled texts: word prefixes that toxic
texts hold far more often than others (likelihood ratio against the number of candidates).
A prefix extends while nearly all its occurrences continue alike, so a term is either a
whole word or a stem that takes any ending. The trie of the terms is intersected
with the automaton of words within a term's edit distance (longer terms allow more), and made
deterministic once into a table; every word of every text then runs through that table.

A hit counts by its term's weight, a misspelled one by half of it at most, less where the
sample's harmless texts come as close by chance. Its context window adds: hits near
each other strengthen each other, while a hit between quotation marks that open and close
inside the window is taken as quoted and counts a quarter. The sum of a text gives its
score by a logistic curve fitted on the same sample.

Sizes: ``TRAIN_ROWS`` labelled texts fit the model. Every prefix of them that passes the
evidence test becomes a term. A table has at most ``TOGETHER`` terms and ``STATES`` states; more terms
have several tables, which run in turn. Scores use whole texts only; label, language, source
and id are no inputs.

Defined results: a null or empty text has no hits and gets the score of such texts; labels
that are null are not used; an id labelled twice is toxic if one label is; without usable
labels every score is 0.0; repeated rows are scored each; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.settle import settle
from . import bitmap
from . import words as wd

TRAIN_ROWS, TOGETHER, STATES = 10_000, 64, 50_000
LEAST_TEXTS, LONGEST, CONTINUES, PURER, CONTAINED, FORMS, ECHO = 3, 24, 0.9, 10, 0.95, 5, 0.25
WINDOW_BYTES, QUOTED, NEAR_BYTES, ENOUGH = 240, 0.25, 80, 40.0
THRESHOLD = 0.7

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with Latin letters in lower case."""
    low = wd._LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    low[upper] += 32
    return low


def letter_runs(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters and digits; typographic marks separate."""
    solid = np.zeros(len(data) + 2, bool)
    inside = solid[1:-1]
    inside[:] = _LETTER[data]
    marks = np.flatnonzero(data == 0xC2)
    inside[marks] = False
    inside[marks[marks + 1 < len(data)] + 1] = False
    marks = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80)) if len(data) > 2 else np.empty(0, np.int64)
    for k in range(3):
        inside[marks + k] = False
    starts, ends = solid[1:] & ~solid[:-1], solid[:-1] & ~solid[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    joined = inner[solid[inner] & solid[inner + 1]]
    starts[joined] = True
    ends[joined] = True
    return np.flatnonzero(starts), np.flatnonzero(ends)


def parts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a text column: first row, bytes, and the rows' byte bounds inside."""
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(cuts, cuts[row] + wd.SLICE_BYTES, "right")) - 1)
        yield row, data[cuts[row] : cuts[last]], cuts[row : last + 1] - cuts[row]
        row = last


def edits_allowed(term: bytes, whole: bool) -> int:
    n = len(term)
    return (0 if n < 5 else 1 if n < 9 else 2) if whole else (0 if n < 6 else 1)


@dataclass
class Automaton:
    """Deterministic table: ``step[state, class of byte]``; state 0 is dead, 1 the start."""

    byte_class: np.ndarray
    step: np.ndarray
    term: np.ndarray
    edits: np.ndarray

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Final state of every word; words leave the loop when they end or die."""
        state = np.ones(len(starts), np.int32)
        at, live = 0, np.arange(len(starts))
        while len(live):
            state[live] = self.step[state[live], self.byte_class[data[starts[live] + at]]]
            at += 1
            live = live[(state[live] > 0) & (starts[live] + at < ends[live])]
        return state


def intersect(terms: list[tuple[bytes, bool]], states: float = math.inf) -> Automaton | None:
    """Lexicon trie times edit distance, by subsets of (trie node, edits so far); none where it
    has more than ``states``."""
    children: list[dict[int, int]] = [{}]
    ends: list[list[int]] = [[]]
    for k, (term, _) in enumerate(terms):
        node = 0
        for b in term:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
                ends.append([])
            node = children[node][b]
        ends[node].append(k)
    most = [0] * len(children)  # edits some term below a node allows
    for node in reversed(range(len(children))):
        own = [edits_allowed(*terms[k]) for k in ends[node]]
        most[node] = max([0, *own, *(most[c] for c in children[node].values())])
    letters = sorted({b for c in children for b in c})
    byte_class = np.zeros(256, np.int16)
    byte_class[letters] = np.arange(1, len(letters) + 1)

    def close(found: dict[int, int]) -> frozenset:
        """Least edits per node, with skipped term letters, without what no term allows."""
        todo = list(found.items())
        while todo:
            node, e = todo.pop()
            if node < 0 or found.get(node) != e:
                continue
            for c in children[node].values():
                if e < most[c] and e + 1 < found.get(c, 99):
                    found[c] = e + 1
                    todo.append((c, e + 1))
        return frozenset(x for x in found.items() if x[0] < 0 or x[1] <= most[x[0]])

    def stems(state: frozenset) -> frozenset:
        """A stem that is matched stays matched, whatever follows: node -1 - term."""
        found = dict(state)
        for node, e in state:
            for k in ends[node] if node >= 0 else []:
                if not terms[k][1] and e <= edits_allowed(*terms[k]):
                    found[-1 - k] = min(e, found.get(-1 - k, 99))
        return frozenset(found.items())

    start = stems(close({0: 0}))
    number, order, rows = {frozenset(): 0, start: 1}, [frozenset(), start], []
    for state in order:
        if len(order) > states:
            return None
        row = []
        for b in [None, *letters]:
            found: dict[int, int] = {}
            for node, e in state:
                if node < 0:
                    found[node] = min(e, found.get(node, 99))
                    continue
                if e < most[node]:
                    found[node] = min(e + 1, found.get(node, 99))
                for letter, c in children[node].items():
                    cost = e + (letter != b)
                    if cost <= most[c]:
                        found[c] = min(cost, found.get(c, 99))
            new = stems(close(found))
            if new not in number:
                number[new] = len(order)
                order.append(new)
            row.append(number[new])
        rows.append(row)
    term, edits = np.full(len(order), -1, np.int32), np.zeros(len(order), np.int32)
    for i, state in enumerate(order):
        hits = [(e, k) for node, e in state for k in ([-1 - node] if node < 0 else ends[node]) if e <= edits_allowed(*terms[k])]
        if hits:
            edits[i], term[i] = min(hits)
    return Automaton(byte_class, np.array(rows, np.int32), term, edits)


def automata(terms: list[tuple[bytes, bool]], first: int = 0) -> list[tuple[int, Automaton]]:
    """Tables of bounded size for runs of the terms, each with the number of its first term."""
    if not terms:
        return []
    table = intersect(terms, STATES if len(terms) > 1 else math.inf) if len(terms) <= TOGETHER else None
    if table is not None:
        return [(first, table)]
    half = len(terms) // 2
    return automata(terms[:half], first) + automata(terms[half:], first + half)


@dataclass
class Model:
    terms: list[tuple[bytes, bool]] = field(default_factory=list)
    weight: np.ndarray = field(default_factory=lambda: np.empty(0))
    near: np.ndarray = field(default_factory=lambda: np.empty(0))
    curve: np.ndarray = field(default_factory=lambda: np.array([-50.0, 0.0]))
    tables: list[tuple[int, Automaton]] = field(default_factory=list)

    def _found(self, texts: pa.Array) -> Iterator[tuple]:
        if not self.tables or not len(texts):
            return
        for row, raw, cuts in parts(texts):
            low = folded(raw) if len(raw) else raw
            starts, ends = letter_runs(low, cuts)
            term, edits = np.full(len(starts), -1, np.int32), np.zeros(len(starts), np.int32)
            for first, table in self.tables:
                state = table.run(low, starts, ends)
                closer = (table.term[state] >= 0) & ((term < 0) | (table.edits[state] < edits))
                term[closer], edits[closer] = table.term[state[closer]] + first, table.edits[state[closer]]
            hit = np.flatnonzero(term >= 0)
            if len(hit):
                at = starts[hit]
                doc = np.searchsorted(cuts, at, "right") - 1
                quoted = _quoted(low, cuts[doc], cuts[doc + 1], at, ends[hit])
                yield row + doc, at, term[hit], edits[hit], quoted

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, term, edits) of every hit."""
        for doc, _, term, edits, _ in self._found(texts):
            yield from zip(doc.tolist(), term.tolist(), edits.tolist(), strict=True)

    def sums(self, texts: pa.Array) -> np.ndarray:
        """Per text: its weighted hits in their context windows."""
        out = np.zeros(len(texts))
        for doc, at, term, edits, quoted in self._found(texts):
            value = np.where(edits == 0, self.weight[term], self.near[term] * 0.5 ** (edits - 1)) * np.where(quoted, QUOTED, 1.0)
            near = np.zeros(len(at))
            if len(at) > 1:
                close = (np.diff(at) <= NEAR_BYTES) & (doc[1:] == doc[:-1])
                near[1:] += close
                near[:-1] += close
            np.add.at(out, doc, value * (1 + 0.25 * near))
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * np.minimum(self.sums(texts), ENOUGH), -50, 50)))


def _quoted(data: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Does a quotation that opens before and closes after a hit lie inside its window?"""
    out = np.zeros(len(start), bool)
    plain = np.flatnonzero(data == 0x22)
    if len(plain):
        before = np.searchsorted(plain, start)
        odd = (before - np.searchsorted(plain, low)) % 2 == 1
        opened = plain[np.maximum(before - 1, 0)]
        closed = plain[np.minimum(before, len(plain) - 1)]
        out |= odd & (start - opened <= WINDOW_BYTES) & (closed >= end) & (closed < high) & (closed - end <= WINDOW_BYTES)
    for head, opening, closing in (((0xC2,), 0xAB, 0xBB), ((0xE2, 0x80), 0x9C, 0x9D)):
        lead = data[len(head) - 1 : -1] == head[-1]
        if len(head) == 2:
            lead = lead & (data[:-2] == head[0])
        places = np.flatnonzero(lead) + len(head)
        marks = places[(data[places] == opening) | (data[places] == closing)]
        if len(marks):
            before = np.searchsorted(marks, start)
            opened, closed = marks[np.maximum(before - 1, 0)], marks[np.minimum(before, len(marks) - 1)]
            out |= (before > 0) & (opened >= low) & (data[opened] == opening) & (start - opened <= WINDOW_BYTES) & (closed >= end) & (
                closed < high) & (data[closed] == closing) & (closed - end <= WINDOW_BYTES)
    return out


def _prefixes(raw: bytes, starts: list[int], ends: list[int]) -> set[bytes]:
    """Prefixes of three bytes or more that end with a character, and whole words with a ``$``."""
    out = set()
    for w in {raw[s:e] for s, e in zip(starts, ends, strict=True)}:
        out.update(w[:n] for n in range(3, min(len(w), LONGEST) + 1) if n == len(w) or not 0x80 <= w[n] < 0xC0)
        if 3 <= len(w) <= LONGEST:
            out.add(w + b"$")
    return out


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: in how many texts each prefix occurs; b"" counts the texts."""
    for batch in batches:
        count: Counter = Counter()
        for _, raw, cuts in parts(batch.column(0)):
            low = folded(raw) if len(raw) else raw
            starts, ends = letter_runs(low, cuts)
            edges, raw = np.searchsorted(starts, cuts), low.tobytes()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                count.update(_prefixes(raw, starts[a:b].tolist(), ends[a:b].tolist()))
                count[b""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.binary()), pa.array(count.values(), pa.int64())], ["prefix", "n"])


def training_rows(documents: DataFrame, labels: DataFrame, usable, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` labelled texts, chosen by a hash of the id."""
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & usable)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(rows)
    )
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id", "text").alias("row"))


def candidates(train: DataFrame) -> DataFrame:
    """Rows (prefix, a, b): the toxic and harmless texts of prefixes, ``LEAST_TEXTS`` toxic ones or more."""
    counts = lambda toxic: train.where(f"toxic = {toxic}").select("text").mapInArrow(_count_rows, "prefix binary, n long")
    toxic = settle(counts(1).groupBy("prefix").agg(F.sum("n").alias("a")).where(f"a >= {LEAST_TEXTS} OR prefix = X''"))
    harmless = bitmap.among(counts(0), "prefix", toxic, "prefix").groupBy("prefix").agg(F.sum("n").alias("b"))
    return settle(toxic.join(harmless, "prefix", "left").select("prefix", "a", F.coalesce("b", F.lit(0)).alias("b")))


def pure(found: DataFrame, n_pos: int, n_neg: int) -> dict[bytes, tuple[int, int, int]]:
    """Toxic texts, harmless texts and toxic texts as a whole word of the prefixes that toxic
    texts hold ``PURER`` times as often; ``found`` is settled."""
    whole = found.where("right(hex(prefix), 2) = '24'").select(F.expr("substring(prefix, 1, length(prefix) - 1)").alias("prefix"), F.col("a").alias("whole"))
    kept = found.where("prefix <> X'' AND right(hex(prefix), 2) <> '24'").where(F.col("a") * n_neg >= F.col("b") * (PURER * n_pos))
    rows = kept.join(whole, "prefix", "left").collect()
    return {bytes(r["prefix"]): (r["a"], r["b"], r["whole"] or 0) for r in rows}


def lexicon(counts: dict[bytes, tuple[int, int, int]], n_pos: int, n_neg: int, tried: int) -> list[tuple[bytes, bool, float]]:
    """Terms (bytes, whole word?, weight) from counts of pure prefixes, of ``tried`` candidates."""
    share = n_pos / (n_pos + n_neg)
    needed = 2 * math.log(max(2, tried)) + 4

    def evidence(a: int, b: int) -> float:
        other = b * math.log(b / ((a + b) * (1 - share))) if b else 0.0
        return 2 * (a * math.log(a / ((a + b) * share)) + other)

    strong = {p: e for p, (a, b, _) in counts.items() if (e := evidence(a, b)) >= needed}
    longer: dict[bytes, list[bytes]] = {}
    for p in strong:
        for cut in range(len(p) - 1, 2, -1):
            if p[:cut] in strong:
                longer.setdefault(p[:cut], []).append(p)
                break
    out: list[tuple[bytes, bool, float]] = []
    stems: set[bytes] = set()
    begun: set[bytes] = set()
    for p in sorted(strong, key=lambda p: (-strong[p], -len(p), p)):
        a, b, n_whole = counts[p]
        if any(counts[q][0] >= CONTINUES * a for q in longer.get(p, [])):
            continue
        whole = n_whole >= CONTINUES * a
        # A stem covers what begins with it; a whole word covers nothing else.
        if any(p[:n] in stems for n in range(3, len(p))) or (not whole and p in begun):
            continue
        if not whole:
            stems.add(p)
        begun.update(p[:n] for n in range(3, len(p)))
        out.append((p, whole, math.log((a + 0.5) / (n_pos + 1)) - math.log((b + 0.5) / (n_neg + 1))))
    return out


def shares(texts_of: dict[int, set], forms: list[int]) -> np.ndarray:
    """Share of its weight that a term keeps: ``ECHO`` for terms of few forms whose toxic texts nearly all
    hold one stronger term. The words of a text that was copied often say little more than the term it holds."""
    leads: list[int] = []
    out = np.full(len(forms), ECHO)
    for k, n in enumerate(forms):
        own = texts_of.get(k, set())
        if own and (n >= FORMS or not any(len(own & texts_of[j]) >= CONTAINED * len(own) for j in leads)):
            leads.append(k)
            out[k] = 1.0
    return out


def near_weights(weight: np.ndarray, positive: np.ndarray, negative: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Weight of a misspelled hit per term: half the exact one, less where words that come
    as close by chance are found in harmless texts."""
    odds = np.log((positive + 2) / (n_pos + 2)) - np.log((negative + 0.5) / (n_neg + 1))
    return np.clip(odds, 0, 0.5 * weight)


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Logistic regression on the sum of log odds by Newton steps of bounded length, drawn
    gently to a plain curve (labels that separate would else send it to infinity)."""
    x = np.column_stack([np.ones(len(x)), np.minimum(x, ENOUGH)])
    prior, pull = np.array([-4.0, 1.2]), np.array([0.5, 5.0])
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + pull * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull), slope)
        w = w - step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn(documents: DataFrame, labels: DataFrame, usable=None, rows: int = TRAIN_ROWS) -> Model:
    """Fit lexicon, automaton and curve on the labelled rows for which ``usable`` holds."""
    train = training_rows(documents, labels, F.lit(True) if usable is None else usable, rows)
    found = candidates(train)
    total = found.where("prefix = X''").first()
    if total is None or not total["b"]:
        return Model()
    n_pos, n_neg = total["a"], total["b"]
    counts = pure(found, n_pos, n_neg)
    terms = lexicon(counts, n_pos, n_neg, found.count())
    if not terms:
        return Model()
    model = Model([(t, w) for t, w, _ in terms], tables=automata([(t, w) for t, w, _ in terms]))

    def exact_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(d, k) for d, k, e in model.hits(batch.column(0)) if not e}
            rows = pa.array([d for d, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([k for _, k in found], pa.int32()), batch.column(2).take(rows)], ["term", "row"])

    texts_of: dict[int, set] = {}
    for r in train.where("toxic = 1").mapInArrow(exact_hits, "term int, row long").distinct().collect():
        texts_of.setdefault(r["term"], set()).add(r["row"])
    forms = [0 if whole else sum(n >= LEAST_TEXTS and p.startswith(t) for p, (_, _, n) in counts.items()) for t, whole, _ in terms]
    model.weight = np.array([v for _, _, v in terms]) * shares(texts_of, forms)

    def near_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(d, k) for d, k, e in model.hits(batch.column(0)) if e}
            rows = pa.array([d for d, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([k for _, k in found], pa.int32()), batch.column(1).take(rows)], ["term", "toxic"])

    close = np.zeros((2, len(terms)))
    for r in train.mapInArrow(near_hits, "term int, toxic int").groupBy("term", "toxic").count().collect():
        close[int(r["toxic"] > 0), r["term"]] = r["count"]
    model.near = near_weights(model.weight, close[1], close[0], n_pos, n_neg)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.sums(batch.column(0))), batch.column(1)], ["total", "toxic"])

    seen = train.mapInArrow(features, "total double, toxic int").groupBy("total", "toxic").count().collect()
    x = np.array([r["total"] for r in seen for _ in range(r["count"])])
    model.curve = fit_curve(x, np.array([r["toxic"] for r in seen for _ in range(r["count"])], float))
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of ``documents`` (none named ``score``) with ``score``, without a shuffle."""
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.scores(batch.column(names.index("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*names, "score"])

    return documents.mapInArrow(run, T.StructType([*documents.schema, T.StructField("score", T.DoubleType())]))
