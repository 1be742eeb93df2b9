"""Tokens, toxicity, near duplicates, repeated passages, packing and neighbours."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirework.llm import bpe, neighbours, ngram_join, packing, substring_dedup, toxicity
from quirework.llm.queries import vocabulary
from quirework.llm.words import documents as word_documents

DOCS = "doc_id long, text string, score double, signature string, a int, others string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 0.5, "x", 1, "y") for i, t in texts], DOCS)


def words_of(text):
    return text.translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ")


def split(text):
    return [w for w in words_of(text or "") if w]


def test_word_places_and_hashes():
    texts = ["a b", None, "", "  a\tb\x0bc ", "é\xa0x y", "x" * 3000 + " a", "b a"]
    got = list(word_documents(pa.array(texts, pa.string())))
    for d, t in zip(got, texts, strict=True):
        raw = d.data.tobytes()
        assert [raw[s:e].decode() for s, e in zip(d.starts, d.ends, strict=True)] == split(t)
    assert got[0].hashes[0] == got[3].hashes[0] == got[5].hashes[-1] == got[6].hashes[1] != got[0].hashes[1]


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(vocabulary())
    r = random.Random(5)
    kinds = ["abcdefghij", "ab", "theing ", "  \n\t\r\x0b\x1c\x85\xa0　'sdm", "éèñßüöаб中文字😀²½Ⅷ٣", "'ll've <|endoftext|> "]
    texts = ["".join(r.choice(r.choice(kinds)) for _ in range(r.choice([1, 6, 60]))) for _ in range(150)]
    texts += ["x<|endoftext|>y<|endoftext|>", None, "", "q" * 5000, "".join(r.choice("theiaonst") for _ in range(6000)), "word " * 20000]
    rows = bpe.decode(bpe.encode(docs(spark, list(enumerate(texts))), vocabulary()), vocabulary()).collect()
    assert len(rows) == len(texts)
    for x in rows:
        ids = own.encode(texts[x["doc_id"]] or "", add_special_tokens=False).ids
        assert x["ids_text"] == ",".join(map(str, ids)) and x["n_tokens"] == len(ids)
        assert x["decoded"] == own.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs(spark, []), vocabulary()).count() == 0


def test_lookahead_bounds_what_later_bytes_can_change():
    machine = bpe.transducer(vocabulary())
    r = random.Random(6)
    for alphabet in ("theiaonstr", "ab", "0123456789", "=-"):
        raw = "".join(r.choice(alphabet) for _ in range(4 * machine.lookahead)).encode()
        assert list(machine.piece(raw)) == machine.merged([machine.first[b] for b in raw])


def test_text_machine_splits_anywhere():
    r = random.Random(8)
    for _ in range(200):
        raw = bytes(r.choice([0x41, 0xC3, 0xA9, 0xE4, 0xB8, 0xAD, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0]) for _ in range(11))
        m, cut = bpe.TextMachine(), r.randrange(12)
        assert m.feed(raw[:cut]) + m.feed(raw[cut:]) + m.feed(b"", True) == raw.decode("utf-8", "replace")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = [(b"idiot", True), (b"worthless", True), (b"scum", True), (b"worldly", False), (b"lost", False)]
    machine = toxicity.intersect(terms)
    r = random.Random(9)
    words = {b"idiot", b"worthless", b"worldlyness", b"lostanything", b"id"}
    for t, _ in terms:
        for _ in range(300):
            w = bytearray(t)
            for _ in range(r.randrange(4)):
                k = r.randrange(len(w) + 1)
                w[k : k + r.randrange(2)] = bytes([r.choice(b"abdehilorstwuyz")]) if r.random() < 0.7 else b""
            words.add(bytes(w) + (b"" if r.random() < 0.6 else b"ing"))
    words = sorted(w for w in words if w)
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    state = machine.run(data, ends - [len(w) for w in words], ends)
    for w, s in zip(words, state, strict=True):
        best = []
        for t, whole in terms:
            most = toxicity.edits_allowed(t, whole)
            d = distance(t, w) if whole else min(distance(t, w[:n]) for n in range(len(w) + 1))
            if d <= most:
                best.append(d)
        assert (machine.term[s] >= 0) == bool(best), w
        if best:
            assert machine.edits[s] == min(best), w


def test_toxicity_learns_and_reads_quotes(spark):
    r = random.Random(10)
    plain = ["lamp", "river", "stone", "cloud", "paper", "garden", "window", "bridge"]
    text = lambda extra: " ".join([r.choice(plain) for _ in range(20)] + extra)
    rows = [(i, text([r.choice(["grobian", "dumpling"])] * 2 if i % 4 == 0 else [])) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(0, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs(spark, rows), labels)
    assert {t for t, _ in model.terms} == {b"grobian", b"dumpling"}
    tests = [text(["grobian"]), text(["Grobian!"]), text(["he said \"grobian\" there"]), text([]), None, "", text(["grobiam", "dumplin"])]
    frame = docs(spark, list(enumerate(tests))).drop("score")
    got = {x["doc_id"]: x["score"] for x in toxicity.score(frame, model).collect()}
    assert got[0] >= 0.7 and got[1] == got[0] and got[2] < got[0] and got[3] < 0.2 and got[4] == got[5] == got[3] < got[6]
    none = toxicity.learn(docs(spark, rows), labels.where("toxic = 0"))
    assert toxicity.score(frame, none).agg(F.max("score")).first()[0] < 1e-9
    assert toxicity.score(frame.limit(0), model).count() == 0


def test_lexicon_keeps_every_term_with_evidence(spark):
    r = random.Random(31)
    bad = [chr(97 + k // 26) + chr(97 + k % 26) + "q" + "".join(r.choice("aeioudlmnrst") for _ in range(5)) for k in range(90)]
    plain = ["lamp", "river", "stone", "cloud", "paper", "garden", "window", "bridge"]
    text = lambda extra: " ".join([r.choice(plain) for _ in range(12)] + extra)
    rows = [(i, text([bad[i % 90], *(["zwilling"] if i % 90 == 0 else [])] if i < 1080 else [])) for i in range(3000)]
    labels = spark.createDataFrame([(i, 1, int(i < 1080)) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs(spark, rows), labels)
    found = {t.decode(): k for k, (t, _) in enumerate(model.terms)}
    assert found.keys() == {*bad, "zwilling"} and len(model.tables) > 1
    pair = sorted(model.weight[[found[bad[0]], found["zwilling"]]])
    assert 0 < pair[0] < pair[1]
    scores = model.scores(pa.array([text([w]) for w in bad] + [text([])]))
    assert scores[:-1].min() > scores[-1]


def test_several_tables_equal_one(monkeypatch):
    terms = [(b"idiot", True), (b"worthless", True), (b"scum", True), (b"worldly", False), (b"lostly", False), (b"idiots", True)]
    texts = pa.array(["idiot idiots idiotz worthles scum", "worldlynes lostlx", None, "idio lostlyx wrthless"])
    one = toxicity.Model(terms, tables=[(0, toxicity.intersect(terms))])
    monkeypatch.setattr(toxicity, "STATES", 40)
    many = toxicity.Model(terms, tables=toxicity.automata(terms))
    assert len(many.tables) > 1 and sorted(many.hits(texts)) == sorted(one.hits(texts))


def shingles(text):
    w = split((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute_classes(texts):
    sets = [(i, shingles(t)) for i, t in texts]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def near_texts(seed=12):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(4))
    texts, passage = [], [word() for _ in range(60)]
    for size in (1, 3, 4, 5, 6, 8, 9, 12, 20, 40, 90, 200, 600):
        for _ in range(3):
            first = [word() for _ in range(size)]
            for edits in (0, 0, 1, 2, 3, size // 30, size // 22, size // 15):
                w = list(first)
                for _ in range(edits):
                    w[r.randrange(len(w))] = word()
                texts.append(" ".join(w).upper() if r.random() < 0.2 else "\n ".join(w))
    for _ in range(40):
        texts.append(" ".join([word() for _ in range(5)] + passage + [word() for _ in range(r.randrange(5, 30))]))
    return [(i * 3, t) for i, t in enumerate(r.sample(texts, len(texts)))]


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    texts = near_texts() + [(10001, None), (10002, ""), (10003, " \t "), (10005, "one")]
    want = brute_classes(texts)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.join(docs(spark, texts)).collect()}
    assert got == want


def test_near_duplicates_of_odd_tables(spark):
    assert ngram_join.join(docs(spark, [])).count() == 0
    rows = ngram_join.join(docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert sorted(((x["doc_id"], x["component_id"]) for x in rows), key=str) == sorted([(1, 1), (1, 1), (2, 1), (None, None)], key=str)


def test_signatures_meet_for_every_linked_pair():
    r = np.random.default_rng(1)
    for n in [*range(1, 60), 100, 333, 1000]:
        for _ in range(6):
            a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
            drop = int(r.integers(0, max(1, n // 5) + 1))
            add = int(r.integers(0, max(1, n // 5) + 1))
            b = np.unique(np.concatenate([r.permutation(a)[: len(a) - drop], r.integers(0, 2**64, add, dtype=np.uint64)]))
            if ngram_join.linked(a, b):
                assert len(np.intersect1d(ngram_join.signatures(a), ngram_join.signatures(b))), (n, drop, add)


def brute_cuts(texts, window):
    first = {}
    for i, t in sorted(((i, t) for i, t in texts if i is not None), key=lambda x: x[0]):
        w = split(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, t in texts:
        w, gone = split(t), set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("window,part_docs", [(50, 1000), (4, 2), (7, 1)])
def test_repeats_equal_brute_force(spark, window, part_docs):
    r = random.Random(window)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("ab")
    shared = [[word() for _ in range(r.randrange(window, 3 * window))] for _ in range(5)]
    texts = []
    for i in range(60):
        parts = []
        for _ in range(r.randrange(0, 5)):
            parts += [word() for _ in range(r.randrange(0, window))] + (r.choice(shared) if r.random() < 0.7 else [])
        texts.append((i * 2, r.choice([" ", "\n", "\t "]).join(parts)))
    texts += [(900, None), (901, ""), (902, " ".join(["a"] * 3 * window)), (903, " ".join(["a"] * 4 * window)), (None, " ".join(shared[0]))]
    got = substring_dedup.remove_repeats(docs(spark, texts), window=window, part_docs=part_docs).collect()
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept"]) for x in got} == brute_cuts(texts, window)
    spaced = substring_dedup.remove_repeats(docs(spark, texts), "score", window=window, part_docs=part_docs, spaced=True).collect()
    plain = {i: t for i, t in texts}
    for x in spaced:
        want = brute_cuts(texts, window)[x["doc_id"]]
        assert " ".join(split(x["kept"])) == want[2] and (want[1] or x["kept"] == (plain[x["doc_id"]] or ""))


def test_repeats_of_odd_tables(spark):
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0
    long = " ".join(str(k) for k in range(120))
    got = substring_dedup.remove_repeats(docs(spark, [(1, long), (1, long), (2, long)])).collect()
    assert sorted((x["doc_id"], x["n_removed"]) for x in got) == [(1, 0), (1, 0), (2, 120)]


def test_packing_is_whole_and_tight(spark):
    r = random.Random(13)
    texts = [(i, " ".join(["w"] * int(r.lognormvariate(4, 1.3)))) for i in range(600)] + [(700, None), (701, ""), (702, "w " * 9000), (703, "x"), (703, "x")]
    rows = packing.pack(packing.lengths(docs(spark, texts)), (64, 128, 512)).collect()
    want = sorted((i, len(split(t)) + 1) for i, t in texts)
    per_doc = {}
    for x in rows:
        per_doc.setdefault(x["doc_id"], []).append((x["first"], x["length"]))
    assert sorted((i, sum(n for _, n in p)) for i, p in per_doc.items()) == sorted({i: sum(n for j, n in want if j == i) for i, _ in want}.items())
    at = 0
    for first, n in sorted(per_doc[702]):
        assert first == at
        at += n
    bins = {}
    for x in rows:
        bins.setdefault((x["group"], x["bin"]), []).append(x)
    for own in bins.values():
        own.sort(key=lambda x: x["offset"])
        used = 0
        for x in own:
            assert x["offset"] == used
            used += x["length"]
        assert own[0]["capacity"] == min(c for c in (64, 128, 512) if c >= used)
    assert sum(x["length"] for x in rows) / sum(own[0]["capacity"] for own in bins.values()) > 0.97
    assert packing.pack(packing.lengths(docs(spark, []))).count() == 0


def naive_packing(lengths, capacities):
    """The rule word by word: for every piece all bins are looked at, for every new bin all sizes are tried."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        n = left.pop(0)
        fits = [b for b in bins if b[0] - sum(b[1]) >= n]
        if fits:
            # The fullest; of equal ones the one that was last given that room.
            room = min(b[0] - sum(b[1]) for b in fits)
            best = max((b for b in fits if b[0] - sum(b[1]) == room), key=lambda b: b[2])
        else:
            costs = []
            for c in sorted(x for x in capacities if x >= n):
                content = n
                for m in left:
                    content += m if content + m <= c else 0
                costs.append(((min(x for x in capacities if x >= content) - content + packing.SEQUENCE_COST) / content, c))
            best = [min(costs, key=lambda x: x[0])[1], [], 0]
            bins.append(best)
        best[1].append(n)
        best[2] = max(b[2] for b in bins) + 1
    return sorted((min(x for x in capacities if x >= sum(own)), *own) for _, own, _ in bins)


def test_packing_equals_a_naive_best_fit():
    r = random.Random(14)
    for _ in range(60):
        capacities = tuple(r.sample([16, 32, 48, 64, 100], r.randrange(1, 5)))
        lengths = sorted((min(max(capacities), int(r.lognormvariate(2.5, 1)) + 1) for _ in range(r.randrange(1, 60))), reverse=True)
        packer, got = packing.Packer(lengths, capacities), {}
        for n in lengths:
            number, offset = packer.place(n)
            assert offset == sum(got.setdefault(number, []))
            got[number].append(n)
        assert sorted((packer.final_capacity(k), *own) for k, own in got.items()) == naive_packing(lengths, capacities)


def test_packed_texts_and_rows_under_one_id(spark, monkeypatch):
    """A third of the rows under one id, and half of those the same text, spread over the groups."""
    monkeypatch.setattr(packing, "GROUP_PIECES", 100)
    r = random.Random(15)
    texts = [(i, "  ".join(f"w{r.randrange(50)}" for _ in range(r.randrange(0, 40)))) for i in range(400)]
    texts += [(7, f"same {i % 2 and i}") for i in range(200)] + [(None, None), (900, "v\t" * 3000), (901, "x " * 63), (902, "x " * 64)]
    rows = packing.sequences(docs(spark, texts), (64, 512)).collect()
    per_group = [sum(x["group"] == g for x in rows) for g in {x["group"] for x in rows}]
    assert len(per_group) >= 6 and max(per_group) < 2 * sum(per_group) / len(per_group)
    assert len({x["group"] for x in rows if x["doc_id"] == 7}) == len(per_group)
    pieces = {}
    for x in rows:
        words = split(x["text"])
        assert x["text"] == " ".join(words) and x["length"] - len(words) in (0, 1)
        pieces.setdefault(x["doc_id"], []).append((x["first"], x["text"]))
    want = {}
    for i, t in texts:
        want.setdefault(i, []).append(" ".join(split(t)))
    for i, own in want.items():
        if len(own) == 1:
            assert " ".join(t for _, t in sorted(pieces[i]) if t) == own[0]
        else:
            assert sorted(t for _, t in pieces[i]) == sorted(own)


def test_neighbours_recall_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP", 300)
    r = np.random.default_rng(3)
    x = r.standard_normal((900, 24)).astype(np.float32)
    x[100:200] = x[5]
    x[200:230] = x[6] + r.standard_normal((30, 24)).astype(np.float32) * 0.01
    rows = [(i, v.tolist(), 0.0) for i, v in enumerate(x)]
    odd = [(5000, None, 0.0), (5020, [0.0] * 24, 0.0), (5040, [float("nan")] * 24, 0.0), (5060, [1.0, None], 0.0), (5080, [], 0.0), (None, x[0].tolist(), 0.0), (5100, [1.0, 2.0], 0.0)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score double")
    got = {}
    for y in neighbours.search(frame, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(y["query_id"], []).append((y["vec_id"], y["score"]))
    assert got.keys() == set(range(0, 900, 20))
    wide, hits = x.astype(np.float64), 0
    for q, found in got.items():
        score = (wide * wide[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(900), -score)) if i != q][:20]
        hits += len({i for i, _ in found} & set(order))
        assert all(abs(s - score[i]) < 1e-12 for i, s in found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
    assert hits >= 0.95 * 20 * len(got)
    assert [i for i, _ in got[100]][:20] == [5, *range(101, 120)]
    assert neighbours.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
