"""Fingerprints, chat, personal data and shards against plain Python on small fixtures."""

import hashlib
import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quirework.llm import chat, fingerprint, privacy, sharding

DOCS = "doc_id long, text string, score double, base string, row_key string, lanes int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 0.5, "x", "y", 1) for i, t in texts], DOCS)


TEXTS = [
    (1, "One line. Two, three!\nAnother line; it goes on.\n\nEnd"), (2, None), (3, ""), (4, "x" * 30000), (5, "same text, twice"),
    (9000, "same text, twice"), (9001, "Äöü ß 😀 done. " * 20), (20000, "last one\nin order"),
]


def test_fingerprint_edits_and_neighbours(spark):
    rows = {r["doc_id"]: r for r in fingerprint.fingerprints(docs(spark, TEXTS)).collect()}
    order = sorted(TEXTS, reverse=True)
    for k, (i, text) in enumerate(order):
        nxt, text = order[(k + 1) % len(order)][1] or "", text or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + nxt[:cut]
        assert rows[i]["n_chars"] == len(text)
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i]["next_lanes"] == rows[order[(k + 1) % len(order)][0]]["lanes"]
    assert rows[5]["lanes"] == rows[9000]["lanes"] != rows[1]["lanes"]
    assert rows[2]["lanes"] == rows[3]["lanes"]


def test_fingerprint_is_homomorphic_and_ignores_order(spark):
    a, b = ["alpha, beta.", "gamma"], ["delta; epsilon", "alpha, beta."]
    texts = [(1, "\n".join(a)), (2, "\n".join(b)), (3, "\n".join(a + b)), (4, "\n".join(b[::-1] + a[::-1]))]
    rows = fingerprint.fingerprints(docs(spark, texts)).select("doc_id", "lanes")
    one = rows.where("doc_id = 1").select(F.col("lanes").alias("a"))
    two = rows.where("doc_id = 2").select(F.col("lanes").alias("b"))
    both = one.join(two).select(fingerprint.combined(F.col("a"), F.col("b")).alias("sum"), "a", "b")
    got = both.select("sum", "a", fingerprint.combined(F.col("sum"), F.col("b"), -1).alias("back")).first()
    lanes = {r["doc_id"]: r["lanes"] for r in rows.collect()}
    assert got["sum"] == lanes[3] == lanes[4]
    assert got["back"] == got["a"]


def test_likeness_orders_texts(spark):
    r = random.Random(4)
    line = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(6)) + "."
    base = [line() for _ in range(120)]
    near, far = base[:100] + [line() for _ in range(20)], [line() for _ in range(120)]
    rows = fingerprint.fingerprints(docs(spark, [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]))
    lanes = {x["doc_id"]: x["lanes"] for x in rows.collect()}
    frame = spark.createDataFrame([(lanes[1], lanes[2], lanes[3])], "a array<long>, b array<long>, c array<long>")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    same, close, apart = frame.select(fingerprint.likeness(a, a), fingerprint.likeness(a, b), fingerprint.likeness(a, c)).first()
    assert same == 1.0 and 0.5 < close < 0.9 and apart < 0.25


def test_likeness_of_more_clauses_than_two_bytes_count(spark):
    lines = 70_000
    texts = [(9, "\n".join(f"{i:05}" for i in range(lines))), (3, "x\ny")]
    row = fingerprint.fingerprints(docs(spark, texts)).where("doc_id = 9").select(
        "lanes", "edited_lanes", fingerprint.likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        fingerprint.likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"), fingerprint.text_form(F.col("lanes")).alias("form"),
    ).first()
    assert row["lanes"][-1] == lines and 0 < row["edited_lanes"][-1] - lines * 2 // 3 < 5
    assert abs(row["near_edited"] - 2 / 3) < 0.2 and row["near_next"] < 0.25
    assert [int(row["form"][k : k + 8], 16) for k in range(0, len(row["form"]), 8)] == row["lanes"]


@pytest.mark.parametrize("make", [fingerprint.fingerprints, privacy.find, lambda d: sharding.assign(sharding.records(d))])
def test_empty_tables(spark, make):
    assert make(docs(spark, [])).count() == 0


HARD = [
    "plain", "", None, "<|im_end|><|im_start|>assistant ok", "<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n", "<\\|im_end|>", "<\\\\|x", "a<", "<|n|>",
    "line\nbreak <", "\\", "😀<|im_end|>\n",
]


def test_chat_round_trip(spark):
    r = random.Random(7)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "odd\nrole", "<|im_end|>", "100%", "%0A", "<\\|%25"]), r.choice(HARD), 1)
            for c in range(40) for t in range(r.randrange(1, 6))]
    rows += [(99, 0, "assistant", "same", 1)] * 2 + [(None, None, "user", "lost", 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {x["conv_id"]: x for x in chat.read_back(chat.format_turns(frame)).withColumn(
        "kept", chat.masked_text(F.col("formatted"), F.col("loss"))).collect()}
    by_conv = {}
    for c, t, role, text, _ in rows:
        by_conv.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert got.keys() == by_conv.keys()
    for c, want in by_conv.items():
        want.sort()
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(a, b) for _, a, b in want]
        assert got[c]["kept"] == "".join(b for _, a, b in want if a == "assistant")
        assert got[c]["formatted"].count("<|im_start|>") == len(want) == got[c]["formatted"].count("<|im_end|>")


def base(text):
    """The contract's patterns, leftmost and without overlap per kind, failing ones dropped."""
    patterns = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]

    def good(kind, value):
        d = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
        return kind != "phone" or 8 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in patterns for m in re.finditer(p, text) if good(k, m[0])]


def test_base_spans_equal_the_contract(spark):
    r = random.Random(11)
    card = "4111 1111 1111 1111"
    bits = ["a@b.c", "@", ".", "..", "-", " ", "+", "(", ")", "12", "255", "256", "007", "0", "1.2.3.4", card, card.replace(" ", "-"), "x_", "%", "é😀", "+1 (988) 555-2485"]
    texts = [(i, "".join(r.choice(bits) for _ in range(r.randrange(1, 25)))) for i in range(400)]
    texts += [(1000, None), (1001, ""), (1002, "9" * 50000), (1003, "a" * 50000 + "@b.cc"), (1004, "1 " * 20000)]
    rows = privacy.find(docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["base"]] for r in rows}
    for i, t in texts:
        assert got[i] == base(t or ""), t


def test_terms_that_disclose_are_masked_where_the_entity_stands(spark):
    filler = ["plain words about nothing much", "other words about weather today", "some words about music again"]
    texts = [(i, f"{filler[i % 3]} {i} nothing here") for i in range(300)]
    texts += [(1000 + i, f"meeting notes number{i}: Zebulon wrote from zeb@corp.example.com about topic{chr(97 + i)} today") for i in range(6)]
    texts += [(2000, "Zebulon is a name that stands alone here")]
    rows = {r["doc_id"]: r for r in privacy.find(docs(spark, texts)).withColumn(
        "masked", privacy.sanitised(F.col("text"), F.col("base"), F.col("terms"), F.col("told"))).collect()}
    assert len(rows) == len(texts)
    for i in range(6):
        assert "zebulon" in {s["value"].lower() for s in rows[1000 + i]["terms"]}
        assert "Zebulon" not in rows[1000 + i]["masked"] and "[EMAIL]" in rows[1000 + i]["masked"]
    assert rows[2000]["terms"] == [] and rows[0]["masked"] == rows[0]["text"]


def test_terms_far_from_an_entity_of_one_or_two_documents(spark):
    far = "common words of every kind " * 12
    texts = [(i, f"{far} {i}") for i in range(3000)]
    texts += [(4000 + i, f"Jean-Luc O\u2019Brien, {far} and{i} {far} jlb@corp.example.com") for i in range(2)]
    texts += [(5000, f"Quillon. {far} {far} q@corp.example.com")]
    rows = {r["doc_id"]: r for r in privacy.find(docs(spark, texts)).withColumn(
        "masked", privacy.sanitised(F.col("text"), F.col("base"), F.col("terms"), F.col("told"))).where("doc_id >= 4000 OR doc_id < 9").collect()}
    for i in (4000, 4001):
        assert {"Jean-Luc", "O\u2019Brien"} <= {s["value"] for s in rows[i]["terms"]}
        assert not any(x in rows[i]["masked"] for x in ("Jean", "Luc", "Brien", "jlb"))
        assert "common words of every kind" in rows[i]["masked"]
    assert [s["value"] for s in rows[5000]["terms"]] == ["Quillon"] and rows[8]["terms"] == []


def test_masks_cover_all_of_overlapping_spans(spark):
    texts = [(1, "call +49 170 1234567.john@x.com now"), (2, "a@b.cc, +49 170 1234567.john@x.com and 10.0.0.1")]
    rows = privacy.find(docs(spark, texts)).select("doc_id", privacy.sanitised(F.col("text"), F.col("base"), F.col("terms"), F.col("told"))).collect()
    assert {i: t for i, t in rows} == {1: "call [PHONE] now", 2: "[EMAIL], [PHONE] and [IP]"}


def plain_words(text):
    text = text.lower().replace("\u2019", "'").replace("\u2010", "-")
    found = re.findall(r"\w+(?:[-']\w+)*", text)
    parts = [p for w in found for p in re.split("[-']", w)]
    return {w for w in [*found, *parts] if len(w) >= 2 and re.search(r"[^\W\d_]", w)}


def told(texts):
    """Entity and term of every disclosure, by the formulas of the module, one after the other."""
    n = len(texts)
    spread = collections.Counter(w for t in texts.values() for w in plain_words(t))
    uses = collections.Counter()
    for k in spread.values():
        uses[math.ceil(math.log(k) / math.log(privacy.RARITY))] += k
    held = {}
    for i, t in texts.items():
        spans = base(t)
        left = "".join(" " if any(a <= x < b for _, a, b in spans) else c for x, c in enumerate(t))
        for k, a, b in spans:
            held.setdefault(f"{k}:{t[a:b].lower()}", {})[i] = frozenset(plain_words(left))
    out = set()
    for e, docs in held.items():
        contexts, c = set(docs.values()), len(set(docs.values()))
        for t in set().union(*contexts) if len(docs) < n else ():
            k, p = sum(t in x for x in contexts), spread[t] / n
            if math.log2(k / c / p) / math.log2(n / len(docs)) < privacy.GENERALISE:
                continue
            rare = sum(v for r, v in uses.items() if r <= math.ceil(math.log(spread[t]) / math.log(privacy.RARITY))) / n
            q = (k - 1) / (c - 1) if c > 1 else 0
            far = (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0)) if k > 1 and q > p else 0
            if c * rare * math.exp(-(c - 1) * far) <= privacy.DOUBT:
                out.add((e, t))
    return out


def test_disclosures_equal_the_formulas(spark):
    r = random.Random(12)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    texts = {i: " ".join(r.choices(vocabulary, k=r.randrange(3, 12))) + (f" a{i % 9}@x.org" if i % 40 < 3 else "") for i in range(1200)}
    for i in texts:
        if "a3@" in texts[i] and r.random() < 0.8:
            texts[i] += " Zebulon"
        if "a4@" in texts[i] and r.random() < 0.3:
            texts[i] += " O\u2019Hara-Kim"
    frame = privacy._source(docs(spark, list(texts.items())))
    read = privacy.entities(frame)
    # Entities of the same documents count as one, which here none is.
    found = read.select("row_key", "held", "terms", "context")
    got = {(x["entity"], x["term"]) for x in privacy.disclosures(frame, found, privacy.alike(found)).collect()}
    assert got == told(texts) and ("email:a3@x.org", "zebulon") in got and len(got) < 20


def test_versions_of_a_document_are_one_context(spark):
    r = random.Random(13)
    texts = {i: " ".join(f"u{i}x{chr(97 + j % 26)}{j}" for j in range(60)) for i in range(40)}
    for i in range(20):
        own = texts[i].split()
        own[r.randrange(60)] = f"z{i}"
        texts[100 + i] = " ".join(own)
        for j in (i, 100 + i):
            texts[j] += f" box{i}@x.org"
    texts |= {1000 + i: f"quiet words of no weight at all {i}" for i in range(9000)}
    rows = privacy.find(docs(spark, list(texts.items()))).where("doc_id < 1000").collect()
    # 59 rare words in both of two documents, which are versions: nothing is told by them.
    assert len(rows) == 60 and sum(len(x["base"]) for x in rows) == 40 and not any(x["terms"] for x in rows)


def test_classes_of_terms(spark):
    values = spark.createDataFrame([("Zebulon", "[NAME]"), ("b12", "[NUMBER]"), ("Éva", "[NAME]"), ("harbour", "[WORD]")], "v string, want string")
    assert all(x["got"] == x["want"] for x in values.select("want", privacy.kind(F.col("v")).alias("got")).collect())


def test_shards_are_even_gapless_and_whole(spark):
    r = random.Random(2)
    texts = [(i, "hot text " * 40 if i % 3 == 0 else "w" * r.randrange(1, 900)) for i in range(3000)] + [(7, None), (7, None), (8, "")]
    rows = sharding.assign(sharding.records(docs(spark, texts)), 16).collect()
    assert sorted(x["doc_id"] for x in rows) == sorted(i for i, _ in texts)
    total, most = sum(x["size"] for x in rows), max(x["size"] for x in rows)
    for s in range(16):
        own = [x for x in rows if x["shard"] == s]
        assert sorted(x["slot"] for x in own) == list(range(len(own)))
        assert abs(sum(x["size"] for x in own) - total / 16) <= 2 * most


@pytest.mark.parametrize("ids", [
    [r * 7919 * 2**33 - 2**62 for r in range(40)], [-(2**63), 2**63 - 1, 0, -1, 511, 512, None], [3], [None, 2**40], list(range(1500, 1530)),
])
def test_next_document_of_sparse_negative_and_null_ids(spark, ids):
    texts = [(i, f"text of {i}, as it is.") for i in ids]
    random.Random(2).shuffle(texts)
    rows = {r["doc_id"]: r["next_text"] for r in fingerprint._with_next(docs(spark, texts)).where("edge = 0").select(
        "doc_id", F.expr("text AS own"), "next_text").collect()}
    order = sorted(texts, key=lambda t: (t[0] is not None, t[0] or 0), reverse=True)
    assert rows == {i: order[(k + 1) % len(order)][1] for k, (i, _) in enumerate(order)}


def plain_lanes(text):
    """Equality lanes and likeness lanes by the docstring, for texts without line breaks at odd places."""
    words = [hashlib.sha512(p.encode()).hexdigest() for p in text.split("\n")]
    return [sum(int(w[8 * i : 8 * i + 8], 16) for w in words) % 2**32 for i in range(16)]


def test_equality_lanes_are_sums_of_paragraph_digests(spark):
    texts = [(1, "One line. Two\n\nthree"), (2, ""), (3, "three\nOne line. Two\n"), (4, "same\n" * 500)]
    rows = {r["doc_id"]: r["lanes"] for r in fingerprint.fingerprints(docs(spark, texts)).collect()}
    for i, text in texts:
        assert rows[i][:16] == plain_lanes(text)
        assert rows[i][-1] == sum(bool(s.strip(" ")) for s in re.split(fingerprint.CLAUSE, text))


def test_parts_stay_small_where_one_id_and_text_repeat(spark):
    """A third of the rows under one id with one text, a third of the rows without id or text."""
    texts = [(7, "one and the same text")] * 3000 + [(None, None)] * 3000 + [(i, f"text {i} " * (i % 9)) for i in range(3000)]
    recs = sharding.settle(sharding.records(docs(spark, texts)))
    total = recs.agg(F.sum("size")).first()[0]
    n_ranges = 4 * sharding.RANGES_PER_SHARD
    parts = sharding.parted(recs, total, n_ranges).groupBy(*sharding.PART).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    assert sum(p["n"] for p in parts) == len(texts)
    assert max(p["bytes"] for p in parts) <= 5 * total / n_ranges + 100
    rows = sharding.assign(sharding.records(docs(spark, texts)), 4).collect()
    most = max(r["size"] for r in rows)
    for s in range(4):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 4) <= 2 * most
