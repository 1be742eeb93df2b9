import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirework.operators.settle import settle
from quirework.operators import graph as gr
from quirework.operators import overlay as ov
from quirework.operators import review as rv

NODE = ("doc_id string, node_id string, category string, title string, target_block_id string, anchor_key string, "
        "review_state string, provenance string, ann_ord int, seq long, page_number int")
EDGE = "doc_id string, source_node_id string, target_node_id string, edge_type string, confidence double, ann_ord int, seq long"
OVR = "doc_id string, override_id string, target_anchor_key string, action_type string, payload string, is_active boolean, created_at double"


def graph(spark):
    ns = [("d", f"n{i}", c, f"T{i}", f"b{i}", f"a{i}", "UNREVIEWED", "X", 1, i, 1)
          for i, c in enumerate(["UNIT", "CHAPTER", "CHAPTER", "DEFINITION"])]
    es = [("d", "n0", "n1", "CONTAINS", 0.9, 1, 1), ("d", "n0", "n2", "CONTAINS", 0.9, 1, 2), ("d", "n1", "n3", "CONTAINS", 0.9, 1, 3)]
    return spark.createDataFrame(ns, NODE), spark.createDataFrame(es, EDGE)


def overrides(spark, items):
    return spark.createDataFrame(
        [("d", f"o{i}", a, k, json.dumps(p), True, float(i)) for i, (a, k, p) in enumerate(items)], OVR)


def run(spark, items):
    n, e = graph(spark)
    st = ov.override_status(n, e, overrides(spark, items))
    nodes, edges = ov.drop_rejected(ov.resolved_nodes(n, st), ov.resolved_edges(e, st))
    out = {r.override_id: (r.outcome, r.error) for r in st.collect()}
    return out, {r.node_id: r for r in nodes.collect()}, {(r.source_node_id, r.target_node_id, r.edge_type): r.confidence for r in edges.collect()}


def test_field_actions_and_revival(spark):
    out, ns, es = run(spark, [
        ("a3", "CHANGE_CATEGORY", {"new_category": "THEOREM"}), ("a3", "RENAME_TITLE", {"new_title": "  New "}),
        ("a1", "DELETE_NODE", {}), ("a1", "ACCEPT_NODE", {}), ("a2", "DELETE_NODE", {}),
        ("zz", "ACCEPT_NODE", {}), ("a0", "RENAME_TITLE", {"new_title": " "}), ("a0", "CHANGE_CATEGORY", {"new_category": "NOPE"}),
    ])
    assert ns["n3"].category == "THEOREM" and ns["n3"].title == "New" and ns["n3"].review_state == "MODIFIED"
    assert ns["n1"].review_state == "ACCEPTED" and "n2" not in ns
    assert out["o5"][0] == "STALE" and out["o6"] == ("ERROR", "TITLE") and out["o7"] == ("ERROR", "CATEGORY")
    assert ("n0", "n2", "CONTAINS") not in es


def test_conflicts_created_nodes_and_edges(spark):
    out, ns, es = run(spark, [
        ("a3", "RENAME_TITLE", {"new_title": "A"}), ("a3", "RENAME_TITLE", {"new_title": "B"}),
        ("x", "CREATE_NODE", {"category": "CONCEPT", "title": "C", "anchor_key": "made"}),
        ("made", "ACCEPT_NODE", {}), ("a1", "UPDATE_EDGE", {"source_anchor": "a1", "target_anchor": "made", "confidence": 0.3}),
        ("a1", "CHANGE_CATEGORY", {"new_category": "SECTION", "note": "x"}), ("x", "CREATE_NODE", {"category": "BAD"}),
    ])
    assert out["o0"][0] == out["o1"][0] == "CONFLICTED" and ns["n3"].title == "T3"
    assert ns["an_manual_o2"].review_state == "ACCEPTED" and out["o6"][0] == "ERROR"
    assert es[("n1", "an_manual_o2", "PREREQUISITE_OF")] == 0.3


def test_reparent(spark):
    out, ns, es = run(spark, [
        ("a3", "REPARENT_NODE", {"new_parent_id": "n2"}), ("a0", "REPARENT_NODE", {"new_parent_id": "n3"}),
        ("a2", "REPARENT_NODE", {"new_parent_anchor": "a1"}), ("a1", "REPARENT_NODE", {"new_parent_id": "n1"}),
        ("a1", "REPARENT_NODE", {"new_parent_id": "n1"}),
    ])
    assert out["o0"][0] == "APPLIED" and out["o1"] == ("ERROR", "CYCLE") and out["o2"][0] == "APPLIED"
    assert out["o3"] == ("ERROR", "SELF_PARENT")
    assert ("n2", "n3", "CONTAINS") in es and ("n1", "n2", "CONTAINS") in es


def test_moves_equal_serial_replay(spark):
    rnd = random.Random(3)
    base = {i: i // 2 for i in range(1, 12)}
    moves = [(o, rnd.randint(0, 11), rnd.randint(0, 11)) for o in range(14)]
    moves = [m for m in moves if m[1] != m[2]]
    parent, bad = dict(base), set()
    for o, n, p in moves:
        x = p
        while x is not None and x != n:
            x = parent.get(x)
        if x == n:
            bad.add(o)
        else:
            parent[n] = p
    ps = spark.createDataFrame([("d", str(c), str(p)) for c, p in base.items()], "doc_id string, node_id string, parent_id string")
    ms = spark.createDataFrame([("d", o, str(n), str(p)) for o, n, p in moves], "doc_id string, ord int, node_id string, parent_id string")
    assert bad and {r.ord for r in gr.rejected_moves(ps, ms).collect()} == bad


@pytest.mark.parametrize("batch", [4096, 5])
def test_moves_of_many_documents_and_rings(spark, batch):
    """Batches of any length decide alike; a ring in the base graph that no move touches ends the walk."""
    rnd = random.Random(4)
    base, moves, bad = [], [], set()
    for d in "abcdef":
        up = {i: rnd.randrange(i) for i in range(1, 25)}
        base += [(d, str(c), str(p)) for c, p in up.items()] + [(d, "90", "91"), (d, "91", "90")]
        for o in range(50):
            n, p = rnd.sample(range(27), 2)
            moves.append((d, o, str(n), str(p)))
            x = p
            while x is not None and x != n:
                x = up.get(x)
            if x == n:
                bad.add((d, o))
            else:
                up[n] = p
    ps = spark.createDataFrame(base, "doc_id string, node_id string, parent_id string")
    ms = spark.createDataFrame(moves, "doc_id string, ord int, node_id string, parent_id string")
    assert len(bad) > 30 and {(r.doc_id, r.ord) for r in gr.rejected_moves(ps, ms, batch=batch).collect()} == bad
    assert gr.rejected_moves(ps, ms.limit(0)).count() == 0


def test_many_rejections_in_a_deep_tree_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(gr, "settle", lambda df: rounds.append(1) or settle(df))
    ps = spark.range(1, 4000).selectExpr("'d' AS doc_id", "CAST(id AS STRING) AS node_id", "CAST(id - 1 AS STRING) AS parent_id")
    ms = spark.range(400).selectExpr("'d' AS doc_id", "CAST(id AS INT) AS ord", "CAST(1 + id AS STRING) AS node_id", "CAST(3999 - id AS STRING) AS parent_id")
    assert gr.rejected_moves(ps, ms).count() == 400 and len(rounds) <= 12 + 8


def test_cycle_edges_are_those_on_cycles(spark):
    rnd = random.Random(6)
    rows, want = [], set()
    for d in range(25):
        n = rnd.randint(2, 20)
        edges = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(int(n * rnd.choice([1, 1.5, 3])))}
        rows += [(d, a, b) for a, b in edges]
        reach = {a: {a} for a in range(n)}
        for _ in range(n):
            for a, b in edges:
                for x in reach.values():
                    if a in x:
                        x.add(b)
        want |= {(d, a, b) for a, b in edges if a in reach[b]}
    e = spark.createDataFrame(rows, "doc_id int, source_node_id int, target_node_id int")
    got = [tuple(r) for r in gr.cyclic_edges(e).collect()]
    assert set(got) == want and len(got) == len(want) > 20


def test_cycles_in_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(gr, "settle", lambda df: rounds.append(1) or settle(df))
    chain = spark.range(100000).selectExpr("1 AS doc_id", "id AS source_node_id", "id + 1 AS target_node_id")
    assert gr.cyclic_edges(chain).count() == 0 and len(rounds) <= 40


def test_cycles(spark):
    e = spark.createDataFrame([("a", "1", "2"), ("a", "2", "3"), ("a", "3", "1"), ("a", "3", "4"), ("b", "1", "2"), ("b", "2", "3"), ("b", None, "3")],
                              "doc_id string, source_node_id string, target_node_id string")
    assert [(r.doc_id, r.n) for r in gr.cyclic_documents(e).collect()] == [("a", 3)]


def test_replay_equals_loop(spark):
    rnd = random.Random(9)
    acts = [(d, i, rnd.randint(0, 6)) for d in "xy" for i in range(60)]
    rev, want = {}, set()
    for d, i, r in acts:
        if rev.get(d, 0) == r:
            rev[d] = r + 1
            want.add((d, i))
    df = spark.createDataFrame(acts, "doc_id string, ord int, expected_version long")
    got = rv.replay_actions(df)
    assert {(r.doc_id, r.ord) for r in got.where("accepted").collect()} == want
    assert {r.doc_id: r.revision for r in rv.revisions(got).collect()} == rev


def test_snapshot_versions_and_invalidation(spark):
    snaps = spark.createDataFrame([("d", 1, "f1"), ("d", 2, "f2")], "doc_id string, approval_version int, resolved_graph_fingerprint string")
    assert rv.snapshot_at(snaps).first().approval_version == 2
    assert rv.snapshot_at(snaps, "v1").first().resolved_graph_fingerprint == "f1"
    docs = spark.createDataFrame([("d", "APPROVED"), ("e", "APPROVED"), ("f", "NEEDS_REVIEW")], "doc_id string, review_state string")
    over = spark.createDataFrame([("d", "f2", "CLEAN"), ("e", "zz", "CLEAN")], "doc_id string, resolved_graph_fingerprint string, reconciliation_status string")
    ns = spark.createDataFrame([("d", "ACCEPTED")], "doc_id string, review_state string")
    got = {r.doc_id: r.review_state for r in rv.rerun_invalidation(docs, snaps, over, ns).collect()}
    assert got == {"d": "APPROVED", "e": "NEEDS_REVIEW"}


def test_replay_of_a_long_log_takes_few_rounds(spark, monkeypatch):
    """2,000 versions whose retries arrive behind them: rounds grow with the logarithm."""
    acts = [("d", 3 * i + k, i + k % 2) for i in range(2000) for k in range(3)]
    rev, want = 0, set()
    for _, o, r in acts:
        if r == rev:
            rev += 1
            want.add(o)
    rounds = []
    monkeypatch.setattr(rv, "settle", lambda df: rounds.append(1) or settle(df))
    df = spark.createDataFrame(acts, "doc_id string, ord int, expected_version long")
    assert {r.ord for r in rv.replay_actions(df).where("accepted").collect()} == want
    assert len(want) >= 2000 and len(rounds) <= 3 + 3 * 13


def test_audit_states_are_those_of_the_time(spark):
    ns = spark.createDataFrame(
        [("d", "n1", "CONCEPT", "Base", "a1", "UNREVIEWED", 1, 1), ("d", "n2", "SECTION", "Top", "a2", "UNREVIEWED", 1, 0)],
        "doc_id string, node_id string, category string, title string, anchor_key string, review_state string, ann_ord int, seq long")
    es = spark.createDataFrame([("d", "n2", "n1", "CONTAINS", 1.0, 1, 1)],
                               "doc_id string, source_node_id string, target_node_id string, edge_type string, confidence double, ann_ord int, seq long")
    log = [
        ("RENAME_TITLE", "a1", '{"new_title":"One"}'), ("ACCEPT_NODE", "a1", "{}"), ("CHANGE_CATEGORY", "a1", '{"new_category":"THEOREM"}'),
        ("RENAME_TITLE", "a1", '{"new_title":"One"}'), ("RENAME_TITLE", "a1", '{"new_title":"Two"}'), ("RENAME_TITLE", "a1", '{"new_title":"One"}'),
        ("REPARENT_NODE", "a1", '{"new_parent_id":"n9"}'), ("REPARENT_NODE", "a1", '{"new_parent_id":"n9"}'), ("ACCEPT_NODE", "made", "{}"),
        ("CREATE_NODE", "x", '{"category":"EXAMPLE","title":"New","anchor_key":"made"}'), ("RENAME_TITLE", "made", '{"new_title":"Newer"}'),
        ("UPDATE_EDGE", "a2", '{"edge_type":"EXPLAINS"}'), ("DELETE_NODE", "a1", "{}"),
    ]
    acts = spark.createDataFrame([("d", i, f"o{i}", a, k, p, True) for i, (k, a, p) in enumerate(log)],
                                 "doc_id string, ord int, override_id string, target_anchor_key string, action_type string, payload string, accepted boolean")
    got = [(r.ord, r.node_id, r.previous_state, r.new_state) for r in rv.audit_rows(acts, ns, es).orderBy("ord").collect()]
    assert got == [
        (0, "n1", '{"title":"Base"}', '{"title":"One"}'), (1, "n1", '{"review_state":"MODIFIED"}', '{"review_state":"ACCEPTED"}'),
        (2, "n1", '{"category":"CONCEPT"}', '{"category":"THEOREM"}'), (3, "n1", '{"title":"One"}', '{"title":"One"}'),
        (4, "n1", '{"title":"One"}', '{"title":"Two"}'), (5, "n1", '{"title":"Base"}', '{"title":"One"}'),
        (6, "n1", '{"parent_id":"n2"}', '{"parent_id":"n9"}'), (7, "n1", '{"parent_id":"n2"}', '{"parent_id":"n9"}'),
        (9, "an_manual_o9", "{}", '{"category":"EXAMPLE","title":"New","target_block_id":null}'),
        (10, "an_manual_o9", '{"title":"New"}', '{"title":"Newer"}'), (11, "n2", "{}", '{"edge_type":"EXPLAINS"}'),
        (12, "n1", '{"review_state":"MODIFIED"}', '{"review_state":"REJECTED"}'),
    ]


CATEGORY = {"UNIT", "CHAPTER", "SECTION", "CONCEPT", "THEOREM"}
STATE = {"ACCEPT_NODE": "ACCEPTED", "DELETE_NODE": "REJECTED"}


def resolved_serially(nodes, parents, log):
    """The graph after a log, corrections taken one by one: (nodes with values, parents)."""
    ns = {i: dict(n, ids=[]) for i, n in nodes.items()}
    up, first = dict(parents), {}
    for o, kind, anchor, payload in log:
        if kind != "CREATE_NODE":
            first.setdefault((kind, anchor), payload)
    clash = {(k, a) for _, k, a, p in log if k != "CREATE_NODE" and first[k, a] != p}
    for o, kind, anchor, payload in log:
        if kind == "CREATE_NODE":
            if payload.get("category") in CATEGORY and isinstance(payload.get("title", ""), str):
                ns[f"an_manual_o{o}"] = {"anchor": payload["anchor_key"], "category": payload["category"], "title": payload.get("title", "Human Created Node"),
                                         "state": "MODIFIED", "ids": [o]}
            continue
        hit = [i for i, n in ns.items() if n["anchor"] == anchor]
        if (kind, anchor) in clash or len(hit) != 1:
            continue
        i = hit[0]
        n = ns[i]
        if kind == "CHANGE_CATEGORY" and payload["new_category"] in CATEGORY:
            n["category"] = payload["new_category"]
        elif kind == "RENAME_TITLE" and isinstance(payload["new_title"], str) and payload["new_title"].strip():
            n["title"] = payload["new_title"].strip()
        elif kind == "REPARENT_NODE" and payload["new_parent_id"] in ns and payload["new_parent_id"] != i:
            x = payload["new_parent_id"]
            while x is not None and x != i:
                x = up.get(x)
            if x == i:
                continue
            up[i] = payload["new_parent_id"]
        elif kind not in STATE:
            continue
        n["state"] = STATE.get(kind, "MODIFIED")
        n["ids"].append(o)
    return ns, up


def test_audit_and_details_equal_serial_replays(spark):
    """Deletes before renames, moves that fail and moves that stop to count, verdicts in conflict, created
    nodes that share an anchor, nested payloads: every audit row against a replay of all before it."""
    rnd = random.Random(21)
    all_nodes, all_edges, all_log, want, details = [], [], [], {}, {}
    for d in range(14):
        doc = f"d{d}"
        nodes = {f"n{i}": {"anchor": f"a{min(i, 5)}", "category": "CONCEPT", "title": f"T{i}", "state": "UNREVIEWED"} for i in range(7)}
        parents = {f"n{i}": f"n{rnd.randrange(i)}" for i in range(1, 6)}
        all_nodes += [(doc, i, n["category"], n["title"], f"b{i}", n["anchor"], n["state"], "X", 1, k, 1) for k, (i, n) in enumerate(nodes.items())]
        all_edges += [(doc, p, c, "CONTAINS", 1.0, 1, int(c[1:])) for c, p in parents.items()]
        log = []
        for o in range(28):
            kind = rnd.choice(["CHANGE_CATEGORY", "RENAME_TITLE", "REPARENT_NODE", "REPARENT_NODE", "ACCEPT_NODE", "DELETE_NODE", "CREATE_NODE"])
            anchor = rnd.choice(["a0", "a1", "a2", "a3", "a4", "a5", "m0", "m1"])
            payload = {
                "CHANGE_CATEGORY": lambda: {"new_category": rnd.choice(["THEOREM", "THEOREM", "NOPE", "SECTION"])},
                "RENAME_TITLE": lambda: {"new_title": rnd.choice([" One", " One", " One", "Two", " ", 5])},
                "REPARENT_NODE": lambda: {"new_parent_id": rnd.choice(["n1", "n2", "n2", "n3", "n9"])},
                "CREATE_NODE": lambda: {"category": rnd.choice(["CONCEPT", "BAD"]), "title": rnd.choice(["New", 7]), "anchor_key": rnd.choice(["m0", "m1"])},
            }.get(kind, lambda: rnd.choice([{}, {}, {}, {}, {"note": {"a": 1, "b": [2]}}, {"note": {"b": [2.0], "a": 1}}, {"note": {"a": "1", "b": [2]}}]))()
            log.append((o, kind, anchor, payload))
        all_log += [(doc, o, f"o{o}", a, k, json.dumps(p), True) for o, k, a, p in log]
        for o, kind, anchor, payload in log:
            ns, up = resolved_serially(nodes, parents, log[:o])
            if kind == "CREATE_NODE":
                want[doc, o] = (f"an_manual_o{o}", {})
                continue
            i = next((i for i, n in ns.items() if n["anchor"] == anchor and n["state"] != "REJECTED"), None)
            if i is None:
                continue
            parent = up.get(i)
            parent = None if parent is None or ns[parent]["state"] == "REJECTED" else parent
            n = ns[i]
            want[doc, o] = (i, {"CHANGE_CATEGORY": {"category": n["category"]}, "RENAME_TITLE": {"title": n["title"]}, "REPARENT_NODE": {"parent_id": parent}}.get(
                kind, {"review_state": n["state"]}))
        ns, up = resolved_serially(nodes, parents, log)
        for i, n in ns.items():
            gone = n["state"] == "REJECTED"
            if gone and i not in nodes:
                continue
            parent = up.get(i)
            shown = nodes[i] | {"ids": []} if gone else n
            details[doc, i] = (shown["category"], shown["title"], shown["state"], None if gone or parent is None or ns[parent]["state"] == "REJECTED" else parent,
                               [f"o{o}" for o in shown["ids"]], gone)
    ns, es = spark.createDataFrame(all_nodes, NODE), spark.createDataFrame(all_edges, EDGE)
    acts = spark.createDataFrame(all_log, "doc_id string, ord int, override_id string, target_anchor_key string, action_type string, payload string, accepted boolean")
    audit = rv.audit_rows(acts, ns, es)
    got = {(r.doc_id, r.ord): (r.node_id, json.loads(r.previous_state)) for r in audit.collect()}
    assert got == want
    log = acts.withColumns({"is_active": F.lit(True), "created_at": F.col("ord").cast("double")}).drop("ord", "accepted")
    st = ov.override_status(ns, es, log)
    rn, re_ = ov.drop_rejected(ov.resolved_nodes(ns, st), ov.resolved_edges(es, st))
    shown = rv.node_details(ns, rn, re_, st)
    ids = {}
    for r in rv.node_overrides(rn, st).orderBy("position").collect():
        ids.setdefault((r.doc_id, r.node_id), []).append(r.override_id)
    assert {(r.doc_id, r.node_id): (r.category, r.title, r.review_state, r.parent_id, ids.get((r.doc_id, r.node_id), []), r.deleted) for r in shown.collect()} == details
    trail = rv.node_audit(shown, audit).groupBy("doc_id", "node_id").agg(F.count("*").alias("n"), F.max("position").alias("p")).collect()
    assert sum(r.n for r in trail) == sum((d, i) in details for (d, _), (i, _) in want.items()) and all(r.n == r.p for r in trail)


def test_payloads_are_compared_as_values(spark):
    same = ['{"a":{"x":1,"y":[1,2]},"b":null}', '{"b":null,"a":{"y":[1.0,2],"x":1.00}}']
    other = ['{"a":{"x":"1","y":[1,2]},"b":null}', '{"a":{"x":1,"y":[2,1]},"b":null}', '{"a":{"x":1,"y":[1,2]}}', "no json", None, '{"b":1,"b":2}']
    rows = spark.createDataFrame([(p,) for p in same + other], "payload string")
    forms = [r.canonical for r in ov.parsed(rows).select("canonical").collect()]
    assert forms[0] == forms[1] and len(set(forms)) == 1 + len(other)


def test_moves_are_decided_in_one_pass_over_sorted_rows():
    """Links come first in a group, groups reach over batches, and an id that is null is a group of its own."""
    def batch(*rows):
        doc, n, node, top = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(node, pa.string()), pa.array(top, pa.string())], ["doc_id", "n", "node_id", "top"])

    first = batch((None, 0, "a", "b"), (None, 1, "b", "a"), (1, None, "b", "a"), (1, 0, "a", "b"), (1, 1, "b", None))
    out = [b.to_pylist() for b in gr._decide(iter([first, batch((1, 2, "a", "b"), (2, 0, "b", "a"))]))]
    assert [(r["doc_id"], r["n"], r["bad"]) for r in sum(out, [])] == [
        (None, 0, False), (None, 1, True), (1, 0, True), (1, 1, False), (1, 2, False), (2, 0, False)]
