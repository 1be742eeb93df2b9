import random

from pyspark.sql import functions as F

from quirework.operators import normalize as nz


def texts(df, col="text"):
    return [r[col] for r in df.orderBy("doc_id", "seq").collect()]


def test_scalar_steps_on_special_signs(blocks):
    df = blocks([
        {"text": "“ﬁne” – oﬄine… x"},
        {"text": "a\u0007b​c\nd\te"},
        {"text": "  one   two \r\n\r\n\r\n\r\n three\t four  \n"},
        {"text": "infor-\nmation ré-\nal real-time"},
    ])
    t = nz.scalar_trace(df)
    assert texts(t, "t1")[0] == '"fine" - offline... x'
    assert texts(t, "t2")[1] == "abc\nd\te"
    assert texts(t, "t3")[2] == "one two\n\nthree four"
    assert texts(t.select("doc_id", "seq", nz.rejoin_hyphens(F.col("t3")).alias("r")), "r")[3] == "information réal real-time"


def test_hyphen_merges_across_blocks_and_pairs_off(blocks):
    df = blocks([
        {"text": "This is a compu-"}, {"text": "ter book."}, {"text": "real-time"},
        {"text": "a-"}, {"text": "b-"}, {"text": "c-"}, {"text": "d"},
    ])
    for rows in (1 << 16, 2, 3):
        t = nz.hyphen_trace(nz.scalar_trace(df), nz.NormalizeParams(chunk_rows=rows))
        assert texts(t.where("dropped_by IS NULL"), "t4") == ["This is a computer book.", "real-time", "ab-", "cd"]


def test_paragraph_merge_same_and_next_page(blocks):
    df = blocks([
        {"text": "This book explains software", "y0": 100, "y1": 112},
        {"text": "testing principles used in industry.", "y0": 115, "y1": 127},
        {"text": "Another one goes", "y0": 600},
        {"text": "on overleaf.", "page": 2, "y0": 40},
        {"text": "Far away", "y0": 60, "page": 2}, {"text": "below", "y0": 300, "page": 2},
    ])
    out = texts(nz.normalize(df))
    assert out[0] == "This book explains software testing principles used in industry."
    assert out[1] == "Another one goes on overleaf."
    assert out[2:] == ["Far away", "below"]


def test_soft_breaks(blocks):
    df = blocks([{"text": "one\ntwo\nThree.\nfour\n\nfive"}])
    assert texts(df.select("doc_id", "seq", nz.soften_breaks(F.col("text")).alias("t")), "t") == ["one two\nThree.\nfour\n\nfive"]


def headers():
    rows = []
    for p in (1, 2):
        rows += [{"text": "Course Notes", "page": p, "y0": 20, "y1": 32}, {"text": f"Body {p} text.", "page": p, "y0": 400},
                 {"text": f"Page {p}", "page": p, "y0": 780, "y1": 792}]
    return rows


def test_running_headers_remove_and_classify(blocks):
    df = blocks(headers())
    assert texts(nz.normalize(df)) == ["Body 1 text.", "Body 2 text."]
    t = nz.trace(df, nz.NormalizeParams(header_footer_mode="classify"))
    assert texts(t, "block_type") == ["HEADER", "PARAGRAPH", "PAGE_NUMBER"] * 2
    one = blocks([{"text": "Only once", "y0": 20, "y1": 32}])
    assert texts(nz.normalize(one)) == ["Only once"]


def test_empty_blocks_ledger_and_disabled_steps(blocks):
    df = blocks([{"text": " \t "}, {"text": "X\u00a0y."}])
    t = nz.trace(df)
    led = {(r.block_id, r.step_name, r.action) for r in nz.ledger(t).collect()}
    assert ("d0", nz.EMPTY, "deleted") in led and ("d1", nz.UNICODE, "modified") in led
    m = {r.step_name: r for r in nz.stage_metrics(t).collect()}
    assert m[nz.EMPTY].removed == 1 and m[nz.UNICODE].modified == 1
    off = nz.trace(df, nz.NormalizeParams(disabled=frozenset({nz.EMPTY, nz.WHITESPACE})))
    assert texts(off.where("dropped_by IS NULL"), "t6")[0] == " \t "


def test_second_run_changes_nothing(blocks):
    df = blocks(headers() + [{"text": "Some “quoted” text", "page": 3}, {"text": "goes on.", "page": 3, "y0": 215}])
    once = nz.normalize(df)
    assert nz.ledger(nz.trace(once)).count() == 0


def serial_merge(rows):
    """The rule written as a plain loop."""
    def open_(t):
        return not t.strip().rstrip("\"')").endswith((".", "!", "?"))
    out, i = [], 0
    while i < len(rows):
        h = rows[i]
        text, x0, y1, j = h["text"], h["x0"], h["y1"], i + 1
        while j < len(rows):
            n = rows[j]
            low = n["text"].strip()[:1]
            ok = h["size"] == n["size"] and abs(x0 - n["x0"]) <= 5 and open_(text) and low and (low.islower() or low in ",;:-")
            if not (ok and ((n["page"] == h["page"] and 0 <= n["y0"] - y1 <= 15) or n["page"] == h["page"] + 1)):
                break
            text, x0, y1, j = f"{text} {n['text']}", min(x0, n["x0"]), max(y1, n["y1"]), j + 1
        out.append(text)
        i = j
    return out


def test_paragraph_chain_equals_loop_for_any_chunk_size(blocks):
    rnd = random.Random(5)
    rows = []
    for k in range(120):
        y = 100 + 14 * (k % 10)
        rows.append({"doc_id": f"doc{k // 40}", "text": rnd.choice(["go on", "Start here", "stop.", "and more", ", so"]),
                     "x0": 50 + rnd.choice([0, 0, 4, 7]), "page": 1 + (k % 40) // 10, "y0": y, "y1": y + rnd.choice([8, 12]),
                     "size": rnd.choice([10.0, 10.0, 12.0])})
    want = []
    for d in ("doc0", "doc1", "doc2"):
        want += serial_merge([r for r in rows if r["doc_id"] == d])
    df = blocks(rows)
    for n in (1 << 16, 7):
        p = nz.NormalizeParams(chunk_rows=n)
        t = nz.paragraph_trace(nz.hyphen_trace(nz.scalar_trace(df, p), p), p)
        assert texts(t.where("dropped_by IS NULL"), "t6") == want


def test_stored_trace_keeps_a_text_once(spark, blocks):
    """Steps that leave a text alone store nothing for it, and what is read back is whole."""
    df = blocks([{"text": "Running Title", "y0": 20, "page": p} if k == 0 else {"text": "plain words.", "y0": 300, "page": p} for p in (1, 2) for k in (0, 1)])
    t = nz.trace(df)
    raw = spark.read.parquet(t.settled_at)
    assert raw.where("t0 IS NOT NULL OR t1 IS NOT NULL OR t2 IS NOT NULL OR t3 IS NOT NULL OR t4 IS NOT NULL").count() == 0
    assert texts(t, "t0") == texts(t, "t6") == ["Running Title", "plain words."] * 2
    whole = nz.running_trace(nz.paragraph_trace(nz.hyphen_trace(nz.scalar_trace(df))))
    assert texts(t, "running_type") == texts(whole, "running_type") == ["HEADER", None] * 2
