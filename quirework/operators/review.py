"""Review state over resolved graphs: replay, summaries, readiness, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .history import GROUP, as_of, conflict_places, effects, targets
from .overlay import created_nodes, first_parents, judged, parsed
from .settle import discard, settle


def replay_actions(actions: DataFrame) -> DataFrame:
    """Optimistic replay: an action is accepted when its expected version is the current one.

    ``actions``: doc_id, ord, expected_version.  The accepted action of version r is the
    first one expecting r after the accepted one of r-1, so every action points at the
    one that would follow it, and the accepted ones are the path from the first that
    expects 0.  Pointers are doubled, so the rounds grow with the logarithm of the log.
    """
    acts = settle(actions.select("doc_id", "ord", F.col("expected_version").alias("r")).where("r >= 0"))
    nothing = F.lit(None).cast(acts.schema["ord"].dataType)
    seek = acts.select("doc_id", (F.col("r") + 1).alias("r"), "ord", F.col("ord").alias("at"), nothing.alias("goal"))
    goal = acts.select("doc_id", "r", "ord", nothing.alias("at"), F.col("ord").alias("goal"))
    later = Window.partitionBy("doc_id", "r").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    links = seek.unionByName(goal).withColumn("to", F.last("goal", ignorenulls=True).over(later))
    links = settle(links.where("at IS NOT NULL AND to IS NOT NULL").select("doc_id", "at", "to"))
    taken = settle(acts.where("r = 0").groupBy("doc_id").agg(F.min("ord").alias("at")))
    while True:
        fresh = settle(taken.join(links, ["doc_id", "at"]).select("doc_id", F.col("to").alias("at")))
        if fresh.isEmpty():
            break
        more = settle(taken.unionByName(fresh))
        double = settle(
            links.alias("x").join(links.alias("y"), (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.to") == F.col("y.at")))
            .select("x.doc_id", "x.at", "y.to")
        )
        discard(taken, links, fresh)
        taken, links = more, double
    discard(links, fresh, acts)
    hit = taken.select("doc_id", F.col("at").alias("ord"), F.lit(True).alias("_t"))
    return actions.join(hit, ["doc_id", "ord"], "left").withColumns(
        {
            "accepted": F.coalesce("_t", F.lit(False)),
            "new_version": F.when(F.col("_t"), F.col("expected_version") + 1),
        }
    ).drop("_t")


def revisions(replayed: DataFrame) -> DataFrame:
    return replayed.groupBy("doc_id").agg(F.count_if("accepted").alias("revision"))


def audit_rows(replayed: DataFrame, ns: DataFrame, es: DataFrame) -> DataFrame:
    """Audit entry of every accepted action: target node, its state before and after.

    The state before is that of the resolved graph of the time (see :mod:`history`): the first
    node with the anchor that is not deleted, with what the accepted actions before amount to. An
    action whose target does not exist at its time leaves no entry. A parent that is deleted at the time
    counts as none.
    """
    acts = settle(parsed(replayed.where("accepted").select("doc_id", "ord", "override_id", "target_anchor_key", "action_type", "payload")))
    created = created_nodes(acts)
    plain = judged(ns, acts)
    changes = effects(es, acts, plain)
    aimed = acts.where("action_type <> 'CREATE_NODE'").join(targets(ns, created), ["doc_id", "target_anchor_key"])
    aimed = aimed.withColumn("_first_id", F.col("first.node_id"))
    here = lambda n: F.col(n).isNotNull() & F.coalesce(F.col(f"{n}.since") < F.col("ord"), F.col(f"{n}.since").isNull())
    seen = as_of(aimed, changes, "_first_id")
    alive = here("first") & ~F.col("as_of.review_state").eqNullSafe("REJECTED")
    found = seen.withColumn("_own", alive).withColumn("t", F.when(alive, F.col("first")).when(here("second"), F.col("second"))).where("t IS NOT NULL")
    now = lambda f: F.coalesce(F.when(F.col("_own"), F.col(f"as_of.{f}")), F.col(f"t.{f}"))
    found = found.select(
        *acts.columns, F.col("t.node_id").alias("node_id"), now("category").alias("_category"), now("title").alias("_title"),
        now("review_state").alias("_state"), F.when(F.col("_own"), F.col("as_of.parent_id")).alias("_moved"))
    # The parent of a node to be moved: where an earlier move put it, else its own, else the first that an edge gave it.
    own = first_parents(es).withColumnRenamed("parent_id", "_base")
    given = plain.where("outcome = 'APPLIED' AND action_type = 'UPDATE_EDGE' AND p_edge_type = 'CONTAINS'").join(
        conflict_places(acts), GROUP, "left").select("doc_id", F.col("edge_target").alias("node_id"), F.col("ord").alias("_since"), "until", "edge_source")
    moving = found.where("action_type = 'REPARENT_NODE'").join(own, ["doc_id", "node_id"], "left")
    late = moving.where("_moved IS NULL AND _base IS NULL").select("doc_id", "node_id", "ord").join(given, ["doc_id", "node_id"]).where(
        "_since < ord AND (until IS NULL OR ord <= until)").groupBy("doc_id", "node_id", "ord").agg(F.min_by("edge_source", "_since").alias("_given"))
    moving = moving.join(late, ["doc_id", "node_id", "ord"], "left").withColumn("_parent", F.coalesce("_moved", "_base", "_given")).drop("_moved", "_base", "_given")
    shown = as_of(moving, changes, "_parent").withColumn(
        "_parent", F.when(~F.col("as_of.review_state").eqNullSafe("REJECTED"), F.col("_parent"))).drop("as_of")
    still = found.where("action_type <> 'REPARENT_NODE'").drop("_moved").withColumn("_parent", F.lit(None).cast("string"))
    fresh = acts.where("action_type = 'CREATE_NODE'").withColumn("node_id", F.concat(F.lit("an_manual_"), "override_id"))
    known = shown.unionByName(still).unionByName(fresh, allowMissingColumns=True)
    one = lambda name, value: f"to_json(named_struct('{name}', {value}), map('ignoreNullFields', 'false'))"
    previous = (
        f"CASE action_type WHEN 'CHANGE_CATEGORY' THEN {one('category', '_category')} WHEN 'RENAME_TITLE' THEN {one('title', '_title')} "
        f"WHEN 'REPARENT_NODE' THEN {one('parent_id', '_parent')} "
        f"WHEN 'ACCEPT_NODE' THEN {one('review_state', '_state')} WHEN 'DELETE_NODE' THEN {one('review_state', '_state')} ELSE '{{}}' END"
    )
    new = (
        f"CASE action_type WHEN 'CHANGE_CATEGORY' THEN {one('category', 'p_new_category')} WHEN 'RENAME_TITLE' THEN {one('title', 'p_new_title')} "
        f"WHEN 'REPARENT_NODE' THEN {one('parent_id', 'p_new_parent_id')} WHEN 'ACCEPT_NODE' THEN '{{\"review_state\":\"ACCEPTED\"}}' "
        "WHEN 'DELETE_NODE' THEN '{\"review_state\":\"REJECTED\"}' WHEN 'CREATE_NODE' THEN to_json(named_struct('category', p_category, "
        "'title', p_title, 'target_block_id', p_target_block_id), map('ignoreNullFields', 'false')) ELSE payload END"
    )
    return known.select("doc_id", "ord", "action_type", "override_id", "node_id", F.expr(previous).alias("previous_state"), F.expr(new).alias("new_state"))


def page_of(df: DataFrame, order: list, offset: int, limit: int, by: str = "doc_id") -> DataFrame:
    """Rows [offset, offset + limit) of every document; the top-k limit is applied before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).where(
        (F.col("position") <= offset + limit) & (F.col("position") > offset)
    )


def review_summary(base_nodes: DataFrame, ns: DataFrame, overlay: DataFrame, readiness: DataFrame) -> DataFrame:
    counts = ns.groupBy("doc_id").agg(
        F.count("*").alias("total_nodes"),
        *[F.expr(f"count_if(review_state = '{s}')").alias(f"{s.lower()}_count")
          for s in ("UNREVIEWED", "ACCEPTED", "MODIFIED")],
    )
    gone = base_nodes.join(ns.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_anti").groupBy(
        "doc_id").agg(F.count("*").alias("rejected_count"))
    ready = readiness.groupBy("doc_id").agg(F.expr("bool_and(passed OR severity <> 'BLOCKER')").alias("approval_readiness"))
    df = overlay.select("doc_id", "reconciliation_status", "stale_count", "conflicted_count")
    for side in (counts, gone, ready):
        df = df.join(side, "doc_id", "left")
    return df.fillna(0, ["total_nodes", "unreviewed_count", "accepted_count", "modified_count", "rejected_count"])


def resolved_graph_page(ns: DataFrame, es: DataFrame, *, category: str | None = None, review_state: str | None = None,
                        low_confidence: bool | None = None, orphan: bool | None = None, offset: int = 0,
                        limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Filtered nodes of every document, one page of them with the number of all that pass
    (``total_count``), and the edges that touch the page."""
    df = ns
    if category:
        df = df.where(F.col("category") == category)
    if review_state:
        df = df.where(F.col("review_state") == review_state)
    if low_confidence is not None:
        conf = F.col("node_confidence") if "node_confidence" in ns.columns else F.lit(1.0)
        df = df.where((conf < 0.65) == F.lit(low_confidence))
    if orphan is not None:
        kids = es.where("edge_type = 'CONTAINS'").select("doc_id", F.col("target_node_id").alias("node_id")).distinct()
        df = df.join(kids, ["doc_id", "node_id"], "left_anti" if orphan else "left_semi")
    totals = df.groupBy("doc_id").agg(F.count("*").alias("total_count"))
    page = page_of(df, [F.col("ann_ord"), F.col("seq"), F.col("node_id")], offset, limit).join(totals, "doc_id")
    ids = page.select("doc_id", "node_id").distinct()
    tagged = es.withColumn("_e", F.explode(F.array("source_node_id", "target_node_id")))
    touch = tagged.join(ids.withColumnRenamed("node_id", "_e"), ["doc_id", "_e"], "left_semi").drop("_e").distinct()
    return page, touch


def node_details(base: DataFrame, ns: DataFrame, es: DataFrame, status: DataFrame) -> DataFrame:
    """Node with parent, child count, original values and number of overrides. ``ns`` and ``es``
    are the resolved graph; a base node that was deleted is shown as it was in the base graph,
    without edges and overrides. Override ids and audit entries are rows of
    :func:`node_overrides` and :func:`node_audit`."""
    con = es.where("edge_type = 'CONTAINS'")
    parent = con.groupBy("doc_id", F.col("target_node_id").alias("node_id")).agg(
        F.min_by("source_node_id", F.struct("ann_ord", "seq")).alias("parent_id"))
    kids = con.groupBy("doc_id", F.col("source_node_id").alias("node_id")).agg(F.count("*").alias("child_count"))
    shown = ["doc_id", "node_id", "category", "title", "review_state", "provenance", "anchor_key", "target_block_id"]
    gone = base.join(ns.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_anti").select(
        *shown, F.lit(None).cast("string").alias("original_category"), F.lit(None).cast("string").alias("original_title"),
        F.lit(0).cast("long").alias("override_count"), F.lit(True).alias("deleted"))
    df = ns.select(*shown, "original_category", "original_title", "override_count", F.lit(False).alias("deleted")).unionByName(gone)
    for side in (parent, kids):
        df = df.join(side, ["doc_id", "node_id"], "left")
    return df.fillna(0, ["child_count"]).withColumns(
        {
            "original_category": F.coalesce("original_category", "category"),
            "original_title": F.coalesce("original_title", "title"),
        }
    )


def original_parents(edges: DataFrame, status: DataFrame) -> DataFrame:
    """(doc_id, node_id, original_parent_id, moves) of moved nodes: the parent in the base graph; one
    that had none is first moved away from where the first move put it."""
    moves = status.where("outcome = 'APPLIED' AND action_type = 'REPARENT_NODE'").groupBy("doc_id", "node_id").agg(
        F.count("*").alias("moves"), F.min_by("new_parent", "ord").alias("_to"))
    return moves.join(first_parents(edges), ["doc_id", "node_id"], "left").select(
        "doc_id", "node_id", F.coalesce("parent_id", F.when(F.col("moves") > 1, F.col("_to"))).alias("original_parent_id"), "moves")


def node_overrides(ns: DataFrame, status: DataFrame) -> DataFrame:
    """(doc_id, node_id, position, override_id): the applied overrides of the nodes of a resolved graph, in order."""
    applied = status.where("outcome = 'APPLIED' AND action_type <> 'UPDATE_EDGE'").join(ns.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_semi")
    line = Window.partitionBy("doc_id", "node_id").orderBy("ord")
    return applied.select("doc_id", "node_id", F.row_number().over(line).alias("position"), "override_id", "action_type")


def node_audit(details: DataFrame, audit: DataFrame) -> DataFrame:
    """The audit entries of every node of ``details``, newest last."""
    line = Window.partitionBy("doc_id", "node_id").orderBy("ord")
    return audit.join(details.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_semi").withColumn("position", F.row_number().over(line))


def readiness_checks(ns: DataFrame, es: DataFrame, overlay: DataFrame, documents: DataFrame) -> DataFrame:
    """Eight approval checks per document as rows."""
    nodes = ns.groupBy("doc_id").agg(F.expr("count_if(review_state = 'UNREVIEWED')").alias("unreviewed"))
    kids = es.where("edge_type = 'CONTAINS'").select("doc_id", F.col("target_node_id").alias("node_id")).distinct()
    loose = ns.where("category <> 'UNIT'").join(kids, ["doc_id", "node_id"], "left_anti").groupBy("doc_id").agg(
        F.count("*").alias("orphans"))
    df = documents.select("doc_id", "status")
    for side in (nodes, loose, overlay.select("doc_id", "stale_count", "conflicted_count", "error_count", "has_cycle")):
        df = df.join(side, "doc_id", "left")
    df = df.fillna(0, ["unreviewed", "orphans", "stale_count", "conflicted_count", "error_count"]).fillna(False, ["has_cycle"])
    checks = (
        ("UNREVIEWED_NODES", "unreviewed = 0", "BLOCKER"),
        ("STALE_OVERRIDES", "stale_count = 0", "BLOCKER"),
        ("OVERRIDE_CONFLICT", "conflicted_count = 0", "BLOCKER"),
        ("GRAPH_CYCLE", "NOT has_cycle", "BLOCKER"),
        ("INVALID_GRAPH", "error_count = 0 AND NOT has_cycle", "BLOCKER"),
        ("INVALID_PIPELINE_RUN", "coalesce(status = 'processed', false)", "BLOCKER"),
        ("ORPHAN_ACADEMIC_NODE", "orphans = 0", "WARNING"),
        ("ACADEMIC_WARNING", "stale_count + conflicted_count = 0", "WARNING"),
    )
    items = ", ".join(f"named_struct('code', '{c}', 'passed', {p}, 'severity', '{s}')" for c, p, s in checks)
    return df.select("doc_id", F.expr(f"inline(array({items}))"))


def new_snapshots(eligible: DataFrame, overlay: DataFrame, existing: DataFrame, revision: DataFrame) -> DataFrame:
    """Header of the next snapshot of every eligible document: version max+1, revision moves on by one."""
    top = existing.groupBy("doc_id").agg(F.max("approval_version").alias("_v"))
    df = eligible.select("doc_id").join(overlay, "doc_id").join(top, "doc_id", "left").join(revision, "doc_id", "left")
    return df.select(
        "doc_id",
        F.expr("coalesce(_v, 0) + 1").alias("approval_version"),
        F.expr("coalesce(revision, 0L)").alias("approved_revision"),
        F.expr("coalesce(revision, 0L) + 1").alias("next_revision"),
        "base_graph_fingerprint", "resolved_graph_fingerprint",
        F.expr("sha2(concat(CAST(doc_id AS STRING), ':', coalesce(_v, 0) + 1), 256)").alias("snapshot_id"),
    )


def snapshot_items(headers: DataFrame, ns: DataFrame, es: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge rows of the snapshots (rows instead of one array, so size is unbounded)."""
    h = headers.select("doc_id", "snapshot_id", "approval_version")
    return h.join(ns, "doc_id"), h.join(es, "doc_id")


def snapshot_at(snapshots: DataFrame, version: str | None = None) -> DataFrame:
    """Snapshot by version ('v3' or '3'), else the latest of every document."""
    if version is not None:
        return snapshots.where(F.col("approval_version") == int(version.lower().removeprefix("v")))
    top = snapshots.groupBy("doc_id").agg(F.max("approval_version").alias("approval_version"))
    return snapshots.join(top, ["doc_id", "approval_version"], "left_semi")


def rerun_invalidation(approved: DataFrame, snapshots: DataFrame, overlay: DataFrame, ns: DataFrame) -> DataFrame:
    """Approved documents that fall back to NEEDS_REVIEW after a rerun."""
    last = snapshot_at(snapshots).select("doc_id", F.col("resolved_graph_fingerprint").alias("_approved"))
    un = ns.groupBy("doc_id").agg(F.expr("count_if(review_state = 'UNREVIEWED')").alias("_un"))
    df = approved.where("review_state = 'APPROVED'").select("doc_id").join(last, "doc_id", "left").join(
        overlay.select("doc_id", "resolved_graph_fingerprint", "reconciliation_status"), "doc_id", "left"
    ).join(un, "doc_id", "left")
    valid = (
        "_approved IS NOT NULL AND _approved <=> resolved_graph_fingerprint AND coalesce(_un, 0) = 0 "
        "AND reconciliation_status <=> 'CLEAN'"
    )
    return df.select("doc_id", F.expr(f"IF({valid}, 'APPROVED', 'NEEDS_REVIEW')").alias("review_state"))


def new_base_graphs(documents: DataFrame, built: DataFrame) -> DataFrame:
    """Documents whose base graph is not stored for their extraction time yet."""
    return documents.join(built, ["doc_id", "extraction_timestamp"], "left_anti")
