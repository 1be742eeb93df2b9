"""Periodic runs, spelling variants and exact dedup against brute force, and the edges of their input."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quirework.llm import exact_dedup, periodic, queries, spelling

DOCS = "doc_id long, text string, score double, row_key string, hash int, runs string, word int, n int, kept string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 0.5, "x", 1, "y", 2, 3, "z") for i, t in texts], DOCS)


def split(text):
    return [w for w in re.split("[\\x20\\x09-\\x0D]+", text or "") if w]


def runs_of(words):
    """All runs: for every period the maximal stretches of matches, the smallest period of each stretch."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1) if j > i else i + 1
    return sorted((a, q, n) for (a, n), q in found.items())


def collapsed(words, runs):
    gone = {i for a, q, n in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def thue_morse(n):
    return ["ab"[bin(i).count("1") & 1] for i in range(n)]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def periodic_texts():
    r = random.Random(4)
    texts = [None, "", " \t", "a", "a " * 11, "a\t\n" * 12, "a " * 2500, " ".join(thue_morse(4100)), " ".join(fibonacci(900)), "ab c " * 41]
    for _ in range(120):
        own, alphabet = [], r.choice(["ab", "abc", "abcdefgh"])
        for _ in range(r.randrange(1, 12)):
            if r.random() < 0.5:
                own += r.choices(alphabet, k=r.randrange(1, 30))
            else:
                block = r.choices(alphabet, k=r.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 64, 100]))
                own += (block * 7)[: int(len(block) * r.uniform(1.2, 6))]
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("tile_words", [8192, 16])
def test_runs_equal_brute_force(spark, tile_words):
    texts = periodic_texts()
    rows = periodic.collapse(docs(spark, [*enumerate(texts), (3, "a"), (None, "b " * 30)]), tile_words=tile_words).collect()
    assert len(rows) == len(texts) + 2
    for x in rows:
        words = split("b " * 30 if x["doc_id"] is None else texts[x["doc_id"]])
        want = runs_of(words)
        assert [(a["start"], a["period"], a["length"]) for a in x["runs"]] == want
        assert x["kept"] == collapsed(words, want) and x["n_words"] == len(words)


def test_long_tails_with_little_and_much_alike(spark):
    """A period of half the text, and many places that look periodic but are not."""
    r = random.Random(5)
    block = [f"w{r.randrange(40)}" for _ in range(6000)]
    near = [*block, *block]
    near[9000] = "other"
    rows = periodic.collapse(docs(spark, [(1, " ".join([*block, *block, "end"])), (2, " ".join(near))])).collect()
    got = {x["doc_id"]: [(a["start"], a["period"], a["length"]) for a in x["runs"] if a["period"] > 100] for x in rows}
    assert got == {1: [(0, 6000, 12000)], 2: []}


def test_query_of_periodic_runs(spark, tmp_path):
    r = random.Random(6)
    texts = {i: " ".join(r.choices("abcdefgh", k=r.choice([0, 5, 40, 300]))) for i in range(60)} | {60: None}
    docs(spark, list(texts.items())).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {x["doc_id"]: x for x in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        words, h = split(t), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (k - a) % p] if k >= a else w for k, w in enumerate(words)]
        want = runs_of(words)
        best = min(want, key=lambda x: (-x[2], x[0], x[1]), default=None)
        x = rows[i]
        assert x["n_runs"] == len(want)
        assert (x["start"], x["period"], x["length"]) == (best or (None,) * 3)
        assert x["exponent_milli"] == (1000 * best[2] // best[1] if best else None)
        assert x["runs_sha256"] == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, q, n in want).encode()).hexdigest()
        assert x["collapsed_sha256"] == hashlib.sha256(collapsed(words, want).encode()).hexdigest()


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v.encode()), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def test_variants_equal_brute_force(spark):
    r = random.Random(7)
    words = {"a" * k for k in range(7, 40)} | {"b" * 3000, "b" * 1500 + "c" + "b" * 1499, "b" * 2999}
    for _ in range(40):
        seed = "".join(r.choices("abc", k=r.choice([6, 7, 8, 9, 12, 20])))
        for _ in range(10):
            w, k = list(seed), r.randrange(len(seed) + 1)
            w[k : k + r.randrange(2)] = r.choices("abcéÿ", k=r.randrange(2))
            words.add("".join(w))
    counts = {w: r.choice([2, 3, 30, 400, 5000]) for w in sorted(words) if len(w) >= 7}
    rows = [(w, n - 1, "x") for w, n in counts.items()] + [(w, 1, "y") for w in counts]
    got = spelling.group(spark.createDataFrame(rows, "word string, n long, node string"))
    want = grouped(counts)
    assert {x["word"]: (x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in got.collect()} == want
    assert any(f and want[f][0] for f, *_ in want.values())
    assert spelling.group(spark.createDataFrame([], "word string, n long")).count() == 0


def test_query_of_spelling_variants(spark, tmp_path):
    r = random.Random(8)
    forms = ["harbour", "Lanterns", "ÉCLAIRAGES", "quietness", "über\u00d7maß", "smallww"]
    texts = {i: " ".join(r.choices(forms, [40, 30, 20, 10, 9, 5], k=r.randrange(40))) + ("," if i % 2 else "9Quietnes") for i in range(80)} | {80: None, 81: ""}
    docs(spark, list(texts.items())).write.parquet(f"{tmp_path}/documents.parquet")
    counts = {}
    for i, t in texts.items():
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] = counts.get(run, 0) + 1
    want = grouped({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    rows = queries.op12_spelling_variants(spark, str(tmp_path)).collect()
    assert {x["word"]: (x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in rows} == want


@pytest.mark.parametrize("weak", [False, True])
def test_groups_of_equal_texts(spark, weak):
    r = random.Random(9)
    bases = ["", "abc", "ab c", "éa\xa0b", "x" * 30000, "abd"]
    texts = []
    for i in range(300):
        text = r.choice(bases)
        k = r.randrange(len(text) + 1)
        texts.append((i, text[:k] + r.choice(["", " ", "\t\n", "\x0b\x0c\r"]) + text[k:]))
    texts += [(300, None), (300, None), (7, texts[7][1]), (7, texts[7][1]), (None, "abc"), (None, " a b c   "), (None, None)]
    texts += [(1000 + i, "hot copy") for i in range(200)]
    # A hash of one byte of the length puts different texts into one group; their bytes tell them apart.
    hashed = (lambda c: F.substring(F.hex(F.length(c)), -1, 1).cast("binary")) if weak else exact_dedup.content_hash
    rows = exact_dedup.groups(docs(spark, texts), hashed=hashed).collect()
    assert len(rows) == len(texts)
    norm = lambda t: re.sub("[\\x20\\x09-\\x0D]", "", t or "")
    want = {}
    for i, t in texts:
        want.setdefault(hashlib.sha256(norm(t).encode()).hexdigest(), []).append((-len(t or ""), i is None, i or 0))
    by_text = {}
    for x in rows:
        by_text.setdefault(x["text_sha256"], []).append(x)
    assert by_text.keys() == want.keys()
    for k, own in by_text.items():
        _, no_id, best = min(want[k])
        assert {x["keep_id"] for x in own} == {None if no_id else best} and {x["group_size"] for x in own} == {len(want[k])} == {len(own)}
        assert [x["doc_id"] for x in own if x["kept"]] == [None if no_id else best]


@pytest.mark.parametrize("make", [periodic.collapse, exact_dedup.groups, lambda d: spelling.group(spelling.vocabulary(spelling.runs(d).withColumnRenamed("run", "word")))])
def test_empty_tables(spark, make):
    assert make(docs(spark, [])).collect() == []


def test_words_are_made_once_on_their_way_to_the_vocabulary(spark):
    """A filter on their length was moved below the count, and every word was made for it and made again."""
    made = spelling.vocabulary(queries.misspelt(docs(spark, [(1, "letters wording wording words")])))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert sum("crc32" in line for line in plan.splitlines()) == 1
    short = spelling.vocabulary(spark.createDataFrame([("wording",), ("wording",), ("words",), ("words",)], "word string"), least_count=0)
    assert [tuple(r) for r in short.collect()] == [("wording", 2)]
