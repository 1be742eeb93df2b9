import random

import pytest
from pyspark.sql import functions as F

from quirework.operators import assembly as asm
from quirework.operators import context as cx
from quirework.operators import jobs as jb
from quirework.operators import ocr
from quirework.operators import search as se


def world(spark):
    ents = spark.createDataFrame(
        [("1", "v", "CONCEPT", "Graph", "Graph", "s1"), ("2", "v", "CONCEPT", "Graph theory", "x", "s2"),
         ("3", "v", "THEOREM", "On graph cuts", "y", "s3"), ("4", "v", "PROOF", "Cut", "uses a graph", "s4"),
         ("5", "w", "CONCEPT", "Graph", "Graph", "s5"), ("6", "v", "PROOF", "Lonely", "z", "s6")],
        "entity_id string, version_id string, entity_type string, title string, content string, stable_id string")
    rels = spark.createDataFrame(
        [("v", "6", "1", "EXPLAINS", 0.5), ("v", "4", "3", "PROVES", 0.7), ("v", "9", "1", "EXPLAINS", 0.9)],
        "version_id string, source_entity_id string, target_entity_id string, relationship_type string, confidence double")
    q = spark.createDataFrame([("q", " Graph ", "v", 10, 1, None, None)],
                              "query_id string, query string, version_id string, top_k int, depth int, entity_types array<string>, relationship_types array<string>")
    return ents, rels, se.normalize_queries(q)


def test_match_ladder_and_isolation(spark):
    ents, _, q = world(spark)
    got = {r.entity_id: r.match_reason for r in se.lexical_match(q, ents).collect()}
    assert got == {"1": "title_exact", "2": "title_prefix", "3": "title_contains", "4": "content_contains"}


def test_match_equals_brute_force(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5)))
    ents = [(str(i), "v", "T", f"{word()} {word()}", word(), f"s{i}") for i in range(60)]
    terms = [word() for _ in range(25)]
    e = spark.createDataFrame(ents, "entity_id string, version_id string, entity_type string, title string, content string, stable_id string")
    q = spark.createDataFrame([(t, t, "v", None) for t in set(terms)], "query_id string, query string, version_id string, entity_types array<string>")
    got = {(r.query_id, r.entity_id) for r in se.lexical_match(se.normalize_queries(q), e).collect()}
    assert got == {(t, x[0]) for t in terms for x in ents if t in x[3] or t in x[4]}


def test_expand_skips_dangling_and_respects_types(spark):
    ents, rels, q = world(spark)
    c, r = se.expand(q, se.lexical_match(q, ents), ents, rels)
    assert {x.entity_id: x.hop for x in c.collect()} == {"1": 0, "2": 0, "3": 0, "4": 0, "6": 1}
    assert {(x.source_entity_id, x.hop) for x in r.collect()} == {("6", 1), ("4", 1)}
    only = q.withColumn("relationship_types", F.array(F.lit("PROVES")))
    assert se.expand(only, se.lexical_match(only, ents), ents, rels)[0].where("hop = 1").count() == 0


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        se.shares({"title": 0.5})
    assert se.shares({"title": 0.2, "content": 0.2})["coverage"] == 0.15


def test_context_skips_what_does_not_fit(spark):
    ranked = spark.createDataFrame(
        [("q", 1, "a", "T" * 4, "C", "x" * 4, "s1", 0.9), ("q", 2, "b", "T" * 4, "C", "y" * 30, "s2", 0.8), ("q", 3, "c", "T" * 4, "C", "z", "s3", 0.7)],
        "query_id string, rank int, entity_id string, title string, entity_type string, content string, stable_id string, total_score double")
    ps = spark.createDataFrame([("q", "a", "b1", "p" * 3, "NOTE"), ("q", "c", "b1", "p" * 3, "NOTE")],
                               "query_id string, entity_id string, block_id string, text string, block_type string"
                               ).withColumn("passage_order", F.struct(F.lit("a"), F.lit(1), F.col("block_id")))
    got = [(r.citation_id, r.entity_id, r.provenance) for r in cx.pack_context(ranked, ps, 22).orderBy("cite").collect()]
    assert got == [("S1", "a", "ENTITY_CONTENT"), ("S2", "a", "NOTE"), ("S3", "c", "ENTITY_CONTENT")]
    none = cx.prompts(spark.createDataFrame([("z", "why")], "query_id string, query string"), cx.pack_context(ranked, ps)).first().prompt
    assert cx.NO_CONTEXT in none and none.endswith("USER QUERY: why")


def test_merge_equals_serial_greedy(spark):
    rnd = random.Random(4)
    pairs = sorted({(rnd.randint(0, 9), rnd.randint(0, 9)) for _ in range(35)})
    used, want = set(), set()
    for n in range(10):
        for o in sorted(b for a, b in pairs if a == n):
            if o not in used:
                used.add(o)
                want.add((n, o))
                break
    df = spark.createDataFrame([("d", 1, a, b) for a, b in pairs], "doc_id string, page_number int, n_seq long, o_seq long")
    assert {(r.n_seq, r.o_seq) for r in ocr.greedy_pairs(df).collect()} == want


def test_screening_and_status(spark, blocks):
    pages = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, page_number int")
    b = blocks([{"text": "x" * 60}])
    assert [r.needs_ocr for r in ocr.screen_pages(pages, b).orderBy("page_number").collect()] == [False, True]
    runs = spark.createDataFrame([("a", "failed"), ("b", "failed"), ("b", "done"), ("c", "done")], "doc_id string, outcome string")
    assert {r.doc_id: r.ocr_status for r in ocr.ocr_status(runs).collect()} == {"a": "skipped", "b": "failed", "c": "completed"}


def test_words_scale_to_points(spark):
    w = spark.createDataFrame([("d", 1, 1, 0, 1, "world", 300., 100., 400., 140., 0.8, 1200, 1600), ("d", 1, 1, 0, 0, "Hello", 100., 100., 200., 140., 0.6, 1200, 1600)],
                              "doc_id string, page_number int, block_num int, line_num int, word_ord long, text string, x0 double, y0 double, x1 double, y1 double, confidence double, img_w int, img_h int")
    p = spark.createDataFrame([("d", 1, 600., 800.)], "doc_id string, page_number int, width double, height double")
    r = ocr.words_to_blocks(w, p).first()
    assert (r.text, r.x0, r.x1, r.y0, r.font_size) == ("Hello world", 50.0, 200.0, 50.0, 20.0) and abs(r.ocr_confidence - 0.7) < 1e-12


def test_job_transitions(spark):
    ev = spark.createDataFrame([("j", 1, "queued", "2024-01-01 00:00:00"), ("j", 2, "processing", "2024-01-02 00:00:00"), ("j", 3, "completed", "2024-01-02 01:00:00"), ("j", 4, "queued", "2024-01-05 00:00:00")],
                               "job_id string, event_id int, status string, updated_at string").withColumn("updated_at", F.to_timestamp("updated_at"))
    assert [(r.previous, r.valid) for r in jb.transitions(ev).orderBy("event_id").collect()] == [(None, True), ("queued", True), ("processing", True), ("completed", False)]


def test_pages_are_judged_by_the_pages_up_to_them(spark, blocks):
    """A running leader by characters, ties to the size seen first, at any length of a chunk."""
    rnd = random.Random(5)
    rows = [{"page": 1 + i // 3, "size": rnd.choice([9.0, 10.0, 12.0, 30.0]), "text": "x" * rnd.choice([5, 10, 20])} for i in range(60)]
    counts, want = {}, {}
    for i, r in enumerate(rows):
        counts[r["size"]] = counts.get(r["size"], 0) + len(r["text"])
        want[r["page"]] = max(counts, key=counts.get)
    assert len(set(want.values())) > 1
    for chunk in (2, 7, 1000):
        got = asm.dominant_so_far(blocks(rows), chunk)
        assert {r.page_number: r.dominant_size for r in got.collect()} == want


def test_heading_levels_of_recognised_pages_are_their_own(spark, blocks):
    big = {"bold": True, "text": "CHAPTER"}
    plain = [{"page": p, "size": 10.0, "text": "plain body text that goes on for a while. " * 6} for p in (1, 2)]
    rows = [plain[0], {"page": 1, "size": 30.0} | big, {"page": 1, "size": 20.0} | big, plain[1], {"page": 2, "size": 20.0} | big]
    got = asm.first_pass(blocks(rows), by_page=True).where("block_type = 'HEADING'").collect()
    assert {(r.page_number, r.font_size): r.heading_level for r in got} == {(1, 30.0): 1, (1, 20.0): 2, (2, 20.0): 1}
    same = asm.first_pass(blocks(rows)).where("block_type = 'HEADING'").collect()
    assert {(r.page_number, r.font_size): r.heading_level for r in same} == {(1, 30.0): 1, (1, 20.0): 2, (2, 20.0): 2}


def test_evidence_and_passages_of_every_request(spark, tmp_path):
    """Requests that leave evidence, passages or relationships out of their answers are looked up all the same."""
    from quirework.plans.queries_search import QUERIES

    d = str(tmp_path)
    names = ["abcde fghij", "abcd efghi", "abc efghi"]  # 11, 10 and 9 characters
    part = [(4 * (k + 5) + v, n, "STEEL") for k, n in enumerate(names, 1) for v in range(4)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_type string").withColumn("p_brand", F.lit("B")).write.parquet(f"{d}/part.parquet")
    lines = [(o, k, n) for o, (a, b) in enumerate((a, b) for a in range(24, 36) for b in range(a + 4, 36, 4)) for n, k in ((1, a), (2, b))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k, "one\ntwo\nthree") for k in range(20)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    ev = {r.query_id for r in QUERIES["evidence"](spark, d).collect()}
    assert set(names) <= ev
    assert {"abcde fghij", "abcd efghi"} <= {r.query_id for r in QUERIES["passages"](spark, d).collect()}


def test_words_are_grouped_once(spark):
    """Numbering the blocks reads stored rows: words appear in no plan behind them."""
    words = spark.createDataFrame(
        [("d", 1, 0, 0, i, w, 10.0 * i, 10.0 * i + 8, 0.0, 12.0, 0.9, 1190, 880) for i, w in enumerate("ab")],
        "doc_id string, page_number int, block_num int, line_num int, word_ord long, text string, x0 double, x1 double, y0 double, y1 double, confidence double, img_w int, img_h int")
    got = ocr.words_to_blocks(words, spark.createDataFrame([("d", 1, 595.0, 440.0)], "doc_id string, page_number int, width double, height double"))
    assert [r.text for r in got.collect()] == ["a b"]
    assert "word_ord" not in got._jdf.queryExecution().optimizedPlan().toString()
