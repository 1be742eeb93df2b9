"""Joins whose sides Spark would take for small: nothing of them may be collected by the driver."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quirework.llm import spelling
from quirework.operators import graph as gr
from quirework.operators import knowledge as kn
from quirework.operators import search as se
from quirework.operators import settle as settling
from quirework.plans import pipeline, queries_review, queries_search, queries_structure

from test_search_ocr import world


@pytest.fixture
def plans(spark, monkeypatch):
    """The plans of the rows that a module stores, as Spark makes them before it knows their size."""

    def watch(module):
        seen, store = [], module.settle

        def settle(df):
            seen.append(planned(df))
            return store(df)

        monkeypatch.setattr(module, "settle", settle)
        return seen

    return watch


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_and_states_are_not_collected(spark, plans, monkeypatch):
    """Words that compress well were taken for small, and all their prefixes and first states were sent to every task."""
    seen = plans(spelling)
    monkeypatch.setattr(spelling, "FEW", 0, raising=False)
    words = [("wording", 40), ("wordings", 3), ("wordinx", 2), ("letters", 9), ("lettrs", 2), ("letterz", 1)]
    rows = spelling.group(spark.createDataFrame(words, "word string, n long"))
    assert {r.word: r.form for r in rows.collect()} == {
        "wording": None, "wordings": "wording", "wordinx": "wording", "letters": None, "lettrs": None, "letterz": None}
    assert len(seen) > 8 and not [p for p in [*seen, planned(rows)] if "Broadcast" in p]


@pytest.fixture
def search(spark, plans, monkeypatch):
    """Entities, relationships and requests from stored rows, which Spark takes for small, with no table counted as of few rows."""
    monkeypatch.setattr(settling, "FEW", 0, raising=False)
    ents, rels, q = (settling.settle(df) for df in world(spark))
    return ents, rels, q, [plans(m) for m in (se, gr)]


def check(want, *frames, seen=()):
    """The rows of the last frame; none of the plans sends a table to all tasks."""
    got = {tuple(r) for r in frames[-1].collect()}
    assert got == want
    assert not [p for p in [*(p for s in seen for p in s), *map(planned, frames)] if "Broadcast" in p]


def test_entities_are_not_collected_for_matching(search):
    """A table of names compresses well: its entities were sent to every task of the term search."""
    ents, _, q, seen = search
    check({("1", "title_exact"), ("2", "title_prefix"), ("3", "title_contains"), ("4", "content_contains")},
          se.lexical_match(q, ents).select("entity_id", "match_reason"), seen=seen)


SEARCHES = ["lexical_match", "graph_expand", "graph_relationships", "evidence", "passages", "search_scores", "search_ranked_topk", "search_package", "search_provenance",
            "package_outgoing", "package_incoming", "package_evidence", "package_passages", "context_packing", "context_packing_small", "prompts"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small tables for the whole search: parts of one version beside each other in orders, with evidence in documents."""
    d = str(tmp_path_factory.mktemp("tables"))
    part = [(4 * (k + 5) + v, n, "STEEL") for k, n in enumerate(["abcde fghij", "abcd efghi", "abc efghi"], 1) for v in range(4)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_type string").withColumn("p_brand", F.lit("B")).write.parquet(f"{d}/part.parquet")
    lines = [(o, k, n) for o, (a, b) in enumerate((a, b) for a in range(24, 36) for b in range(a + 4, 36, 4)) for n, k in ((1, a), (2, b))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k, "one\ntwo\nthree") for k in range(20)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", SEARCHES)
def test_no_table_of_the_search_is_collected(spark, plans, monkeypatch, tables, name):
    monkeypatch.setattr(settling, "FEW", 0, raising=False)
    seen = [plans(m) for m in (pipeline, se, gr)]
    rows = queries_search.QUERIES[name](spark, tables)
    assert rows.count() > 0
    assert not [p for p in [*(p for s in seen for p in s), planned(rows)] if "Broadcast" in p]


def test_no_knowledge_table_is_collected(spark):
    """Entities are found by the nodes at the ends of an edge and by their blocks."""
    ents = settling.settle(spark.createDataFrame([("v", "d", f"n{i}", f"e{i}", "T", f"s{i}", f"b{i}", "OCR") for i in (1, 2)],
                           "version_id string, doc_id string, node_id string, entity_id string, title string, stable_id string, target_block_id string, provenance string"))
    edges = settling.settle(spark.createDataFrame([("v", "d", "n1", "n2", "CONTAINS", 0.5)],
                            "version_id string, doc_id string, source_node_id string, target_node_id string, edge_type string, confidence double"))
    blocks = settling.settle(spark.createDataFrame([("d", "b1", 1, 0.0, 0.0, 1.0, 1.0, "text", "OCR", [("HEADING", "Title")])],
                             "doc_id string, block_id string, page_number int, x0 double, y0 double, x1 double, y1 double, text string, provenance string, path array<struct<kind string, title string>>"))
    rels, ev = kn.relationships(edges, ents), kn.evidence(ents, blocks)
    assert [(r.source_entity_id, r.target_entity_id) for r in rels.collect()] == [("e1", "e2")]
    assert {(r.entity_id, r.section_title) for r in ev.collect()} == {("e1", "Title"), ("e2", None)}
    assert "Broadcast" not in planned(rels) + planned(ev)


def test_scores_are_found_one_by_one(spark, tables):
    """All scores in one plan read, sorted and shuffled the blocks of a corpus a dozen times at once."""
    rows = queries_structure.QUERIES["quality_overall"](spark, tables)
    plan = planned(rows)
    assert plan.count("Scan parquet") == 5 and "Broadcast" not in plan
    assert rows.count() == 20 and all(0 <= r.overall_quality <= 1 for r in rows.collect())
    assert queries_structure.QUERIES["quality_warnings"](spark, tables).where("kind = 'recommendation'").count() > 0


def test_a_report_joins_what_is_stored(spark, tables):
    """Annotation counts and academic scores of all documents were taken for small."""
    rows = queries_review.QUERIES["document_report"](spark, tables)
    assert {r.total_nodes for r in rows.collect()} == {3} and rows.count() == 20
    assert not re.search(r"BroadcastHashJoin \[doc_id#\d+L?\], ", planned(rows))


@pytest.mark.parametrize("serial", [1 << 17, 7, 0])
def test_cycles_of_small_and_large_documents(spark, monkeypatch, serial):
    """Every document alone, all together, and both ways: the edges whose ends reach each other."""
    r = random.Random(3)
    edges = {(d, r.randrange(9), r.randrange(9)) for d in range(12) for _ in range(d)} | {(None, 1, 2), (None, 2, 1), (None, 3, 3), (4, 5, None), (4, None, 5)}
    reach = {(d, s, t) for d, s, t in edges if None not in (d, s, t)}
    while more := {(d, s, u) for d, s, t in reach for e, v, u in reach if d == e and t == v} - reach:
        reach |= more
    want = {(d, s, t) for d, s, t in edges if None not in (s, t) and (s == t or (d, t, s) in reach)}
    rows = spark.createDataFrame([*edges, *edges], "doc_id long, source_node_id long, target_node_id long")
    got = [tuple(x) for x in gr.cyclic_edges(rows, serial=serial).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_small_documents_take_no_rounds(spark, monkeypatch):
    """A knot of edges in each of many documents took a round of jobs for every colour and step."""
    r = random.Random(4)
    rows = spark.createDataFrame([(d, r.randrange(20), r.randrange(20)) for d in range(50) for _ in range(60)], "doc_id long, source_node_id long, target_node_id long")
    stored, store = [], gr.settle
    monkeypatch.setattr(gr, "settle", lambda df: stored.append(1) or store(df))
    assert gr.cyclic_documents(rows).count() == 50 and len(stored) <= 5
