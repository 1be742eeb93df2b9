import random
import re

import pytest

import hashlib

from pyspark.sql import functions as F

from quirework.operators import academic as ac
from quirework.operators import classify as cl
from quirework.operators import features as ft
from quirework.operators import hierarchy as hi
from quirework.operators import order as ro
from quirework.operators import quality as q
from quirework.operators.settle import settle
from quirework.operators.ordered import dense_position, near, running
from quirework.plans.pipeline import classified, structured


def rows_of(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.orderBy("doc_id", "seq").collect()]


def test_ordered_helpers_do_not_depend_on_chunk_size(spark):
    rnd = random.Random(1)
    data = [(d, s, rnd.choice([None, rnd.randint(0, 9)])) for d in "ab" for s in range(37)]
    df = spark.createDataFrame(data, "doc_id string, seq long, v int")

    def run(n):
        a = near(df, lambda w: {"p": F.lag("v").over(w), "n": F.lead("v", 2).over(w)}, width=2, rows=n)
        b = running(a, {"last": ("last", F.col("v")), "sum": ("sum", F.col("v")), "max": ("max", F.col("v"))}, rows=n)
        c = running(df, {"before": ("last", F.col("v"))}, rows=n, before=True)
        return rows_of(b, "doc_id", "seq", "p", "n", "last", "sum", "max"), rows_of(c, "before")

    assert run(1000) == run(4) == run(5)


def test_dense_position(spark):
    df = spark.createDataFrame([("a", p, o) for p in (3, 1, 9000) for o in (2, 1)], "doc_id string, page_number int, o int")
    got = [(r.page_number, r.o, r.seq) for r in dense_position(df, ["o"]).orderBy("seq").collect()]
    assert got == [(1, 1, 0), (1, 2, 1), (3, 1, 2), (3, 2, 3), (9000, 1, 4), (9000, 2, 5)]


def test_features(blocks):
    df = ft.extract(blocks([{"text": "TITLE ÉTÉ", "x0": 200, "x1": 400}, {"text": "Hello, World 12!", "y0": 140}]))
    a, b = df.orderBy("seq").collect()
    assert a.all_caps and not a.title_case and a.alignment == "center" and a.space_below == 28.0 and a.is_at_top
    assert b.title_case and b.ends_punct and b.word_count == 3 and abs(b.digit_ratio - 2 / 16) < 1e-12
    assert b.prev_block_id == "d0" and b.next_block_id is None


def test_heading_levels_and_rules(blocks):
    body = "This is a long ordinary sentence that carries the body size of the whole document and ends here."
    df = classified(blocks([
        {"text": "Chapter 1 Basics", "size": 20.0, "bold": True, "y0": 100}, {"text": body, "y0": 150},
        {"text": "1.1 Details", "size": 15.0, "bold": True, "y0": 200}, {"text": body, "y0": 250},
        {"text": "• first item", "y0": 280}, {"text": "Note: mind the gap in this text", "y0": 300},
        {"text": "Figure 3 A caption", "y0": 320}, {"text": "a    b    c\nd    e    f", "y0": 340},
        {"text": "def f(x): return x;", "family": "Courier", "y0": 380}, {"text": "x = 1 + 2 * 3", "y0": 400},
        {"text": "***", "y0": 420}, {"text": '"To be or not to be"', "y0": 440},
    ]))
    got = rows_of(df, "block_type", "heading_level")
    assert got[0] == ("HEADING", 1) and got[2] == ("HEADING", 2)
    assert [g[0] for g in got[4:]] == ["LIST", "NOTE", "CAPTION", "TABLE", "CODE", "EQUATION", "EQUATION", "QUOTE"]


def test_two_columns(blocks):
    df = blocks([
        {"block_id": "left2", "x0": 50, "x1": 250, "y0": 200}, {"block_id": "right1", "x0": 350, "x1": 550, "y0": 110},
        {"block_id": "title", "x0": 50, "x1": 550, "y0": 50}, {"block_id": "left1", "x0": 50, "x1": 250, "y0": 100},
        {"block_id": "right2", "x0": 350, "x1": 550, "y0": 210},
    ])
    got = ro.reading_links(ro.reading_order(df))
    assert rows_of(got, "block_id") == ["title", "left1", "left2", "right1", "right2"]
    assert rows_of(got, "column_index") == [0, 0, 0, 1, 1]
    assert rows_of(got, "original_parser_order") == [2, 3, 0, 1, 4]
    assert rows_of(got, "previous_block_id") == [None, "title", "left1", "left2", "right1"]


def typed(blocks, items):
    df = blocks([{"text": f"T{i}", "type": t, "x0": x} for i, (t, _, x) in enumerate(items)])
    lv = "CASE seq " + " ".join(f"WHEN {i} THEN {l or 'NULL'}" for i, (_, l, _) in enumerate(items)) + " END"
    return df.withColumn("heading_level", F.expr(f"CAST({lv} AS INT)")).withColumn("margin_left", F.col("x0"))


def test_hierarchy_case(blocks):
    df = typed(blocks, [("HEADING", 1, 50), ("HEADING", 3, 50), ("PARAGRAPH", None, 50), ("TABLE", None, 50), ("CAPTION", None, 50)])
    h = hi.hierarchy(df)
    assert rows_of(h, "parent_block_id") == [None, "d0", "d1", "d1", "d3"]
    r = {x.block_id: x for x in hi.hierarchy_rows(h).collect()}
    assert r["d0"].subtree_size == 5 and r["d0"].last_descendant == "d4" and r["d0"].first_descendant == "d1"
    b = {x.block_id: x.breadcrumb for x in hi.breadcrumbs(h).collect()}
    assert b["d2"] == ["T0", "T1"]
    v = hi.validate(h).first()
    assert v.heading_jumps == 1 and v.orphan_count == 0 and v.max_depth == 3
    kinds = sorted(e.edge_type for e in hi.reading_edges(h).collect())
    assert kinds.count("READING_FLOW") == 4 and kinds.count("CAPTION_ASSOCIATION") == 1 and kinds.count("SIBLING") == 1


def stack_parents(items):
    """The nesting rule as a plain stack machine."""
    targets, stack, parents = ("TABLE", "EQUATION", "CODE"), [], []
    for i, (t, lv, m) in enumerate(items):
        if t == "CAPTION":
            near_ = [j for j in (i - 1, i + 1) if 0 <= j < len(items) and items[j][0] in targets]
            if near_:
                parents.append(near_[0])
                continue
        while stack:
            tt, tl, tm = items[stack[-1]]
            if t == "HEADING":
                pop = tt != "HEADING" or tl >= lv
            elif tt == "LIST":
                pop = not m > tm + 10 if t == "LIST" else m < tm - 5
            else:
                pop = tt != "HEADING"
            if not pop:
                break
            stack.pop()
        parents.append(stack[-1] if stack else None)
        if t in ("HEADING", "LIST"):
            stack.append(i)
    return parents


def test_nesting_equals_stack_machine_for_any_chunk_size(blocks):
    rnd = random.Random(11)
    items = []
    for _ in range(160):
        t = rnd.choice(["LIST"] * 5 + ["PARAGRAPH"] * 3 + ["HEADING", "CAPTION", "TABLE"])
        items.append((t, rnd.randint(1, 4) if t == "HEADING" else None, rnd.choice([50, 57, 65, 80, 95])))
    df = typed(blocks, items)
    want = [None if p is None else f"d{p}" for p in stack_parents(items)]
    for n in (1 << 16, 9, 4):
        assert rows_of(hi.hierarchy(df, rows=n), "parent_block_id") == want


def naive_subtrees(rows):
    """Size, first child and last descendant in preorder of every node with children."""
    own = {r.seq: [x.seq for x in r.path] + [r.seq] for r in rows}
    out = {}
    for r in rows:
        below = [s for s, p in own.items() if r.seq in p[:-1]]
        if below:
            kids = [s for s in below if own[s][-2] == r.seq]
            out[r.seq] = (len(below) + 1, len(kids), f"d{min(kids)}", f"d{max(below, key=lambda s: own[s])}")
    return out


def test_subtrees_equal_a_count_over_paths_for_any_chunk_size(blocks):
    for seed in (3, 5):
        rnd = random.Random(seed)
        kinds = ["LIST"] * 4 + ["PARAGRAPH"] * 3 + ["HEADING"] * 2 + ["CAPTION", "TABLE", "CODE"] * 2
        items = []
        for _ in range(150):
            t = rnd.choice(kinds)
            items.append((t, rnd.randint(1, 6) if t == "HEADING" else None, rnd.choice([50, 57, 65, 80, 95])))
        df = typed(blocks, items)
        for n in (1 << 16, 5):
            h = hi.hierarchy(df, rows=n).cache()
            got = {r.node_seq: (r.subtree_size, r.child_count, r.first_descendant, r.last_descendant) for r in hi.subtrees(h, rows=n).collect()}
            assert got == naive_subtrees(h.collect())
            h.unpersist()


def test_too_small_a_bound_of_rows_is_an_error(blocks):
    df = typed(blocks, [("HEADING", 1, 50)] + [("PARAGRAPH", None, 50)] * 9).withColumn("doc_rows", F.lit(3).cast("long"))
    with pytest.raises(Exception, match="doc_rows is below"):
        hi.hierarchy(df, rows=4).select("parent_block_id").collect()


def test_quality_codes(blocks):
    df = blocks([
        {"text": "xkcdfgh 1a2b bcdfgx", "conf": 0.4, "x0": 50, "x1": 300, "y0": 100, "y1": 140},
        {"text": "", "y0": 300}, {"text": "w0rd c0de", "conf": 0.5, "x0": 60, "x1": 310, "y0": 110, "y1": 150},
        {"text": "plain", "y0": 500},
    ]).withColumn("semantic_conf", F.lit(0.9)).withColumn("heading_level", F.lit(None).cast("int")).withColumn("margin_left", F.col("x0"))
    h = hi.hierarchy(df)
    s = q.overall(q.ocr_score(h), q.layout_score(h), q.semantic_score(h), q.hierarchy_score(hi.validate(h)), q.reading_score(h, hi.reading_edges(h)))
    codes = {r.code for r in q.quality_notes(s, q.odd_blocks(h)).collect()}
    assert {"POOR_OCR_CONFIDENCE", "OVERLAPPING_LAYOUT_ELEMENTS", "RERUN_OCR_RECOMMENDED"} <= codes
    r = s.first()
    assert abs(r.overall_quality - (r.ocr_quality * r.layout_quality * r.semantic_quality * r.hierarchy_quality * r.reading_quality) ** 0.2) < 1e-12


def test_academic_graph_and_anchors(blocks):
    df = typed(blocks, [("HEADING", 1, 50), ("HEADING", 2, 50), ("PARAGRAPH", None, 50), ("PARAGRAPH", None, 50), ("PARAGRAPH", None, 50)])
    names = ["Intro: Basics!", "Part Two", "Definition 1 A set.", "Definition 1 A set.", "Summary of it"]
    df = df.withColumn("text", F.expr("element_at(array(" + ",".join(f"'{n}'" for n in names) + "), CAST(seq AS INT) + 1)"))
    ann = settle(ac.annotations(settle(hi.hierarchy(df))))
    anc = settle(ac.anchors(ann))
    got = {(r.block_id, r.academic_type): r for r in anc.collect()}
    assert {k[1] for k in got} == {"UNIT", "CHAPTER", "DEFINITION", "SUMMARY"}
    d2, d3 = got[("d2", "DEFINITION")], got[("d3", "DEFINITION")]
    assert d2.section_path == "intro-basics/part-two" and (d2.ordinal, d3.ordinal) == (0, 1) and d2.anchor_key != d3.anchor_key
    assert rows_of(ac.anchors(ann, rows=2), "ordinal") == rows_of(anc, "ordinal")
    e = {(r.source_node_id, r.target_node_id) for r in ac.contains_edges(anc).collect()}
    assert e == {("an_d0", "an_d1"), ("an_d1", "an_d2"), ("an_d1", "an_d3"), ("an_d1", "an_d4")}
    n = ac.nodes(anc)
    f1 = ac.graph_fingerprint(n, ac.contains_edges(anc)).first().fingerprint
    f2 = ac.graph_fingerprint(n.withColumn("title", F.concat("title", F.lit("x"))), ac.contains_edges(anc)).first().fingerprint
    assert f1 != f2


def test_fingerprint_is_one_rule_at_every_size(spark):
    """More lines than any chunk: still the plain digest of the sorted lines."""
    n = 70_000
    ns = spark.range(n).selectExpr(
        "IF(id = 0, 'small', 'big') AS doc_id", "concat('n', id) AS node_id", "'CONCEPT' AS category", "concat('Title ', id % 7) AS title",
        "concat('a', id) AS anchor_key", "1 AS ann_ord", "id AS seq",
    )
    es = spark.range(3).selectExpr(
        "'big' AS doc_id", "concat('n', id + 1) AS source_node_id", "concat('n', id + 2) AS target_node_id",
        "IF(id = 0, 'CONTAINS', 'EXPLAINS') AS edge_type", "1D AS confidence", "1 AS ann_ord", "id AS seq",
    )
    got = {r.doc_id: r.fingerprint for r in ac.graph_fingerprint(ns, es).collect()}
    line = lambda i: f"a{i}:CONCEPT:{'a1' if i == 2 else ''}:Title {i % 7}"
    digest = lambda nodes, edges: hashlib.sha256("\n".join(sorted(nodes)).encode() + b"\n---\n" + "\n".join(sorted(edges)).encode()).hexdigest()
    assert got == {"small": digest([line(0)], []), "big": digest([line(i) for i in range(1, n)], ["a2->EXPLAINS->a3", "a3->EXPLAINS->a4"])}


def test_classified_blocks_are_stored_once_and_carry_one_text(spark, blocks):
    """Each pass looks at its own neighbours: their texts are neither stored nor moved on."""
    import os

    at = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(at))
    done = classified(blocks([{"text": "Chapter 1 Basics", "size": 20.0, "bold": True}, {"text": "Some body text that goes on."}, {"text": "- item"}]))
    assert done.settled_at.split("/")[-1] in os.listdir(at) and len(set(os.listdir(at)) - before) == 1
    assert not {"t", "prev_text", "next_text"} & set(done.columns) and "semantic_conf" in done.columns
    tree = structured(done)
    assert not {"contributors", "sig_size", "word_count"} & set(tree.columns) and done.count() == tree.count() == 3
    assert [r.parent_block_id for r in tree.orderBy("seq").collect()] == [None, "d0", "d0"]


def test_per_document_values_come_to_rows_dealt_out_otherwise(blocks):
    """The same values whether rows are dealt out for them or stay in their groups, hot documents included."""
    df = ft.extract(blocks([{"doc_id": d, "text": "x" * (i + 1), "size": 10.0 + i % 3, "page": 1 + i // 4} for d in "ab" for i in range(9)]), 2)
    plain = cl.heading_scores(df, rows=2)
    for keys in (["doc_id", "doc_rows", "chunk"], ["doc_id", "page_number"]):
        held = cl.heading_scores(df, rows=2, dealt_by=keys)
        assert rows_of(held, "doc_id", "dominant_size", "c2_conf") == rows_of(plain, "doc_id", "dominant_size", "c2_conf")


def test_links_of_a_hierarchy_are_found_without_the_other_columns(blocks):
    df = blocks([{"text": f"t{i}", "type": "LIST" if i % 3 else "PARAGRAPH", "x0": 50 + 15 * (i % 4)} for i in range(20)])
    h = hi.hierarchy(df.withColumn("note", F.concat(F.lit("n"), "block_id")).withColumn("heading_level", F.lit(None).cast("int")), rows=5)
    plan = h._jdf.queryExecution().optimizedPlan()
    windows = [n for n in _nodes(plan) if n.nodeName() == "Window"]
    assert windows and not [n for n in windows if "note#" in n.output().mkString(",")]
    assert sorted(r.note for r in h.collect()) == sorted(f"nd{i}" for i in range(20))


def _nodes(plan):
    out, todo = [], [plan]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [n.children().apply(i) for i in range(n.children().size())]
    return out


def test_suspicious_words_of_a_text_with_a_very_long_word(blocks):
    import time

    texts = ["ab1 1a a-1 12 bcdfg abcdf xbcdfgx ok\u00a0a1\tb2", "-- 1", "strngths 3x", "ae" * 150000]
    want = [["ab1", "1a", "bcdfg", "xbcdfgx", "a1", "b2"], [], ["strngths", "3x"], []]
    sizes = [10, 2, 2, 1]
    began = time.time()
    for t, w, n in zip(texts, want, sizes):
        assert q.ocr_score(blocks([{"text": t}])).first().r_suspicious == len(w) / n, t
    # Trying every tail of the long word again would take minutes.
    assert time.time() - began < 40


def test_formula_and_code_rules_where_texts_are_not_searched(blocks):
    long = "x = 1 + 2 * (3 - 4) "
    rows = [(t, k, fam) for t, k, fam in (
        ("+ - * /", "PARAGRAPH", "Times"), ("+ - * /", "HEADING", "Times"), (long * 6, "PARAGRAPH", "Times"), ("{;} return", "PARAGRAPH", "Times"),
        ("words that return nothing at all here", "PARAGRAPH", "Times"), ("words that return nothing at all here", "PARAGRAPH", "Courier"),
        (r"\alpha \beta \gamma", "PARAGRAPH", "Times"), ("12345 678", "UNKNOWN", "Times"), ("9" * 120, "PARAGRAPH", "Times"), ("", "PARAGRAPH", "Courier"))]
    df = blocks([{"text": t, "type": k, "family": f} for t, k, f in rows]).withColumn("f_family", F.col("font_family"))
    got = rows_of(cl.code_formula(df.withColumn("word_count", F.expr("size(filter(split(text, ' '), w -> w <> ''))"))), "c7_type")
    assert got == ["EQUATION", None, None, "CODE", None, "CODE", "EQUATION", "EQUATION", None, None]


def test_list_paths_pass_no_null_lists_to_python(blocks, monkeypatch):
    """A null list makes the writer go over all null lists before it, so time grew with the square of a batch."""
    plain = hi._open_lists

    def strict(batches):
        def seen():
            for pdf in batches:
                assert not pdf[["c_seq", "c_margin", "c_id", "c_title"]].isna().any().any()
                yield pdf

        yield from plain(seen())

    monkeypatch.setattr(hi, "_open_lists", strict)
    rows = [{"text": t, "x0": x, "y0": 100 + 20 * i} for i, (t, x) in enumerate((("- one", 50), ("- inside", 80), ("- two", 50), ("some words", 90)))]
    for chunk in (2, 100):
        h = structured(classified(blocks(rows), chunk), chunk)
        assert rows_of(h, "parent_block_id") == [None, "d0", None, "d2"]


def test_stored_rows_leave_no_shuffle_files(spark):
    """What led to stored rows is never read again, so its shuffle files go with the write."""
    from quirework.operators.settle import CLEANUP, discard, settle

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", manager.getAllFiles().mkString(" ")))
    before, setting = files(), spark.conf.get(CLEANUP)
    rows = settle(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    assert not files() - before and spark.conf.get(CLEANUP) == setting
    assert rows.count() == 7
    discard(rows)


def test_classified_texts_are_dealt_out_once(spark, blocks):
    """The order is found without the types of the heading pass and equals the one found with them; a page
    boundary parts neighbours; texts meet one exchange, those of headings one more."""
    rows = [{"text": f"Chapter {i} Basics" if i % 4 == 0 else f"some body text {i}, going on", "size": 20.0 if i % 4 == 0 else 10.0, "bold": i % 4 == 0,
             "page": 1 + i // 6, "x0": 50 if i % 2 else 320, "x1": 280 if i % 2 else 550, "y0": 100 + 37 * (i * 5 % 6)} for i in range(24)]
    given = blocks(rows)
    old = cl.heading_scores(ft.extract(given, 9), rows=9)
    old = cl.list_quote_note(ro.reading_order(cl.heading_levels(old, rows=9)), 9)
    old = cl.annotate(cl.code_formula(cl.table_caption(old)))
    shown = ["block_id", "seq", "block_type", "heading_level", "semantic_conf", "space_above", "space_below", "is_at_top", "is_at_bottom", "column_index"]
    done = classified(given, 9)
    assert sorted(map(tuple, done.select(*shown).collect())) == sorted(map(tuple, old.select(*shown).collect()))
    plan = cl.heading_scores(ft.extract(given, 9, by_page=True), rows=9, dealt_by=["doc_id", "page_number"])
    plan = ro.reading_order(plan.withColumn("block_type", F.lit("PARAGRAPH")))._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.split("\n") if "Exchange hashpartitioning(doc_id" in x and "page_number" in x]
    assert moved and "chunk" not in plan
