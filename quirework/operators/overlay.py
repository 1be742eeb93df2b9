"""Human corrections replayed over a base academic graph, for all documents at once.

Order is the pair (created_at, override_id).  "The state so far" is never rebuilt row by
row: a field keeps the value of its last applied override (``max_by``), an anchor is
looked up against base nodes plus nodes created earlier, and moves are tested with
parent links as of their own time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .academic import CATEGORIES, graph_fingerprint
from .graph import cyclic_documents, rejected_moves
from .settle import discard, settle

PAYLOAD = (
    "new_category", "new_title", "new_parent_id", "new_parent_anchor", "source_node_id", "target_node_id",
    "source_anchor", "target_anchor", "edge_type", "confidence", "category", "title", "target_block_id", "anchor_key",
)
_CATS = "(" + ", ".join(f"'{c}'" for c in CATEGORIES) + ")"


def parsed(actions: DataFrame) -> DataFrame:
    """Adds the fields of the payload and its ``canonical`` form, in which payloads are equal as
    values: the order of keys, at any depth, and the writing of numbers don't matter, types do.
    ``t_title``, ``t_new_title`` and ``t_block`` are the types of fields that must be texts."""
    df = actions.withColumn("_v", F.try_parse_json("payload"))
    kind = lambda k: F.expr(f"schema_of_variant(variant_get(_v, '$.{k}', 'variant'))")
    df = df.withColumns({
        "canonical": F.coalesce(F.to_json("_v"), "payload", F.lit("")), "t_title": kind("title"), "t_new_title": kind("new_title"),
        "t_block": kind("target_block_id"), **{f"p_{k}": F.try_variant_get("_v", f"$.{k}", "string") for k in PAYLOAD},
    })
    return df.drop("_v")


def active_overrides(overrides: DataFrame) -> DataFrame:
    """Active overrides with their order key and parsed payload."""
    return parsed(overrides.where("is_active").withColumn("ord", F.struct("created_at", "override_id")))


def conflict_groups(active: DataFrame) -> DataFrame:
    """(document, anchor, action) groups whose payloads differ; all their overrides are skipped."""
    return (
        active.where("action_type <> 'CREATE_NODE'")
        .groupBy("doc_id", "target_anchor_key", "action_type")
        .agg(F.count("*").alias("n"), F.min("canonical").alias("_a"), F.max("canonical").alias("_b"))
        .where("_a <> _b").select("doc_id", "target_anchor_key", "action_type", "n")
    )


# A title that is given, and a block id that is not null, must be texts.
_CREATE_ERROR = (f"CASE WHEN coalesce(p_category, '') NOT IN {_CATS} THEN 'CATEGORY' WHEN coalesce(t_title, 'STRING') <> 'STRING' "
                 "OR coalesce(t_block, 'VOID') NOT IN ('STRING', 'VOID') THEN 'TYPE' END")


def created_nodes(active: DataFrame) -> DataFrame:
    return active.where(f"action_type = 'CREATE_NODE' AND ({_CREATE_ERROR}) IS NULL").select(
        "doc_id", "ord", "override_id",
        F.concat(F.lit("an_manual_"), "override_id").alias("node_id"),
        F.col("p_category").alias("category"),
        F.coalesce("p_title", F.lit("Human Created Node")).alias("title"),
        F.col("p_target_block_id").alias("target_block_id"),
        F.expr("coalesce(nullif(p_anchor_key, ''), concat('anc_manual_', override_id))").alias("anchor_key"),
    )


def _anchor_index(nodes: DataFrame, created: DataFrame) -> DataFrame:
    """Per anchor: base node count, one base node, and the two earliest created nodes."""
    base = nodes.where("coalesce(anchor_key, '') <> ''").groupBy("doc_id", "anchor_key").agg(
        F.count("*").alias("nb"), F.min("node_id").alias("base_node")
    )
    w = Window.partitionBy("doc_id", "anchor_key").orderBy("ord")
    two = created.select("doc_id", "anchor_key", "ord", "node_id", F.row_number().over(w).alias("rn")).where("rn <= 2")
    made = two.groupBy("doc_id", "anchor_key").agg(
        F.expr("min(ord) FILTER (WHERE rn = 1)").alias("c1"), F.expr("min(node_id) FILTER (WHERE rn = 1)").alias("c1_node"),
        F.expr("min(ord) FILTER (WHERE rn = 2)").alias("c2"),
    )
    return base.join(made, ["doc_id", "anchor_key"], "full_outer")


def _resolve(df: DataFrame, index: DataFrame, anchor: str, out: str) -> DataFrame:
    """Adds ``out`` (the only node with that anchor at that time) and ``out``_n (how many there are)."""
    side = index.withColumnRenamed("anchor_key", anchor)
    j = df.join(side, ["doc_id", anchor], "left")
    n = "coalesce(nb, 0) + IF(c1 < ord, 1, 0) + IF(c2 < ord, 1, 0)"
    return j.withColumns(
        {f"{out}_n": F.expr(n), out: F.expr(f"IF({n} = 1, IF(nb = 1, base_node, c1_node), NULL)")}
    ).drop("nb", "base_node", "c1", "c1_node", "c2")


def _exists_at(df: DataFrame, known: DataFrame, col: str, out: str) -> DataFrame:
    side = known.select("doc_id", F.col("node_id").alias(col), F.col("since").alias("_since"), F.lit(True).alias("_k"))
    j = df.join(side, ["doc_id", col], "left")
    return j.withColumn(out, F.expr("coalesce(_k, false) AND (_since IS NULL OR _since < ord)")).drop("_since", "_k")


def judged(nodes: DataFrame, active: DataFrame) -> DataFrame:
    """Every override of ``active`` (parsed, with ``ord``) with the node it hits and its outcome, APPLIED,
    STALE, CONFLICTED (an ambiguous anchor) or ERROR, as far as it does not depend on others of its
    kind: neither conflicts of payloads nor cycles are looked at."""
    created = created_nodes(active)
    index = settle(_anchor_index(nodes, created))
    known = nodes.select("doc_id", "node_id").distinct().withColumn("since", F.lit(None).cast(active.schema["ord"].dataType))
    known = settle(known.unionByName(created.select("doc_id", "node_id", F.col("ord").alias("since"))))
    df = _resolve(active, index, "target_anchor_key", "hit")
    df = _resolve(df, index, "p_new_parent_anchor", "by_parent")
    df = _resolve(df, index, "p_source_anchor", "by_source")
    df = _resolve(df, index, "p_target_anchor", "by_target")
    df = df.withColumns(
        {
            "new_parent": F.expr("coalesce(nullif(p_new_parent_id, ''), by_parent)"),
            "edge_source": F.expr("coalesce(nullif(p_source_node_id, ''), by_source)"),
            "edge_target": F.expr("coalesce(nullif(p_target_node_id, ''), by_target)"),
        }
    )
    for col in ("new_parent", "edge_source", "edge_target"):
        df = _exists_at(df, known, col, f"{col}_ok")
    error = f"""CASE action_type
        WHEN 'CREATE_NODE' THEN {_CREATE_ERROR}
        WHEN 'CHANGE_CATEGORY' THEN IF(coalesce(p_new_category, '') NOT IN {_CATS}, 'CATEGORY', NULL)
        WHEN 'RENAME_TITLE' THEN IF(coalesce(t_new_title, '') <> 'STRING' OR btrim(coalesce(p_new_title, '')) = '', 'TITLE', NULL)
        WHEN 'REPARENT_NODE' THEN CASE WHEN NOT new_parent_ok THEN 'PARENT_NOT_FOUND' WHEN new_parent = hit THEN 'SELF_PARENT' END
        WHEN 'UPDATE_EDGE' THEN CASE WHEN edge_source IS NULL OR edge_target IS NULL THEN 'ENDPOINT_MISSING'
            WHEN NOT edge_source_ok OR NOT edge_target_ok THEN 'ENDPOINT_NOT_FOUND'
            WHEN edge_source = edge_target THEN 'SELF_EDGE' END
        END"""
    df = df.withColumn(
        "outcome",
        F.expr(
            f"CASE WHEN action_type = 'CREATE_NODE' THEN IF(({error}) IS NULL, 'APPLIED', 'ERROR') "
            f"WHEN hit_n = 0 THEN 'STALE' WHEN hit_n > 1 THEN 'CONFLICTED' WHEN ({error}) IS NOT NULL THEN 'ERROR' ELSE 'APPLIED' END"
        ),
    ).withColumns(
        {
            "error": F.expr(f"IF(outcome = 'ERROR', {error}, NULL)"),
            "node_id": F.expr("IF(action_type = 'CREATE_NODE', concat('an_manual_', override_id), hit)"),
        }
    )
    out = settle(
        df.select(
            "doc_id", "override_id", "ord", "target_anchor_key", "action_type", "payload", "outcome", "error",
            "node_id", "new_parent", "edge_source", "edge_target", "p_new_category", "p_new_title", "p_edge_type",
            "p_confidence", "p_category", "p_title", "p_target_block_id", "p_anchor_key",
        )
    )
    discard(index, known)
    return out


def override_status(nodes: DataFrame, edges: DataFrame, overrides: DataFrame) -> DataFrame:
    """Every active override with its outcome: APPLIED, STALE, CONFLICTED or ERROR, and its node."""
    active = settle(active_overrides(overrides))
    groups = conflict_groups(active).withColumn("_c", F.lit(True)).drop("n")
    plain = judged(nodes, active)
    df = settle(plain.join(groups, ["doc_id", "target_anchor_key", "action_type"], "left").withColumns(
        {"outcome": F.expr("IF(_c, 'CONFLICTED', outcome)"), "error": F.expr("IF(_c, NULL, error)")}
    ).drop("_c"))
    discard(active, plain)
    return _reject_cycles(df, edges)


def first_parents(edges: DataFrame) -> DataFrame:
    """The containment edge a move rewrites: the first one of the child in edge order."""
    return edges.where("edge_type = 'CONTAINS'").groupBy("doc_id", F.col("target_node_id").alias("node_id")).agg(
        F.min_by("source_node_id", F.struct("ann_ord", "seq")).alias("parent_id")
    )


def _reject_cycles(status: DataFrame, edges: DataFrame) -> DataFrame:
    moves = status.where("action_type = 'REPARENT_NODE' AND outcome = 'APPLIED'").select(
        "doc_id", "ord", "node_id", F.col("new_parent").alias("parent_id")
    )
    bad = rejected_moves(first_parents(edges), moves).withColumn("_cycle", F.lit(True))
    return status.join(bad, ["doc_id", "ord"], "left").withColumns(
        {"outcome": F.expr("IF(_cycle, 'ERROR', outcome)"), "error": F.expr("IF(_cycle, 'CYCLE', error)")}
    ).drop("_cycle")


def resolved_nodes(nodes: DataFrame, status: DataFrame) -> DataFrame:
    """Base and created nodes with the last applied value of every field; rejected ones included."""
    ok = status.where("outcome = 'APPLIED'")
    made = ok.where("action_type = 'CREATE_NODE'").select(
        "doc_id", "node_id", F.col("p_category").alias("category"),
        F.coalesce("p_title", F.lit("Human Created Node")).alias("title"),
        F.col("p_target_block_id").alias("target_block_id"),
        F.expr("coalesce(nullif(p_anchor_key, ''), concat('anc_manual_', override_id))").alias("anchor_key"),
        F.lit("MODIFIED").alias("review_state"), F.lit("HUMAN_OVERRIDE").alias("provenance"),
        F.lit(9).alias("ann_ord"), F.lit(None).cast("long").alias("seq"), F.lit(1).alias("created"),
    )
    base = nodes.select(*made.columns[:-1], F.lit(0).alias("created"))
    last = lambda v, cond: F.expr(f"max_by({v}, ord) FILTER (WHERE {cond})")
    state = (
        "CASE action_type WHEN 'ACCEPT_NODE' THEN 'ACCEPTED' WHEN 'DELETE_NODE' THEN 'REJECTED' ELSE 'MODIFIED' END"
    )
    changes = ok.where("action_type NOT IN ('CREATE_NODE', 'UPDATE_EDGE')").groupBy("doc_id", "node_id").agg(
        last("p_new_category", "action_type = 'CHANGE_CATEGORY'").alias("_cat"),
        last("btrim(p_new_title)", "action_type = 'RENAME_TITLE'").alias("_title"),
        F.expr(f"max_by({state}, ord)").alias("_state"),
        F.count("*").alias("_n"),
    )
    return (
        base.unionByName(made).join(changes, ["doc_id", "node_id"], "left")
        .withColumns(
            {
                "original_category": F.expr("IF(_cat IS NOT NULL, category, NULL)"),
                "original_title": F.expr("IF(_title IS NOT NULL, title, NULL)"),
                "override_count": F.expr("coalesce(_n, 0L) + created"),
            }
        )
        .withColumns(
            {
                "category": F.coalesce("_cat", "category"),
                "title": F.coalesce("_title", "title"),
                "review_state": F.coalesce("_state", "review_state"),
            }
        )
        .drop("_cat", "_title", "_state", "_n", "created")
    )


def resolved_edges(edges: DataFrame, status: DataFrame) -> DataFrame:
    """Base edges with moves applied, then last-wins upserts; touching rejected nodes not yet removed."""
    ok = status.where("outcome = 'APPLIED'")
    moves = ok.where("action_type = 'REPARENT_NODE'").groupBy("doc_id", "node_id").agg(
        F.max_by("new_parent", "ord").alias("_to")
    )
    e = edges.select("doc_id", "source_node_id", "target_node_id", "edge_type", "confidence", "ann_ord", "seq")
    firsts = e.where("edge_type = 'CONTAINS'").groupBy("doc_id", "target_node_id").agg(
        F.min(F.struct("ann_ord", "seq")).alias("_first")
    )
    m = moves.withColumnRenamed("node_id", "target_node_id")
    moved = e.join(firsts.join(m, ["doc_id", "target_node_id"]), ["doc_id", "target_node_id"], "left").withColumn(
        "source_node_id",
        F.expr("IF(edge_type = 'CONTAINS' AND _first = struct(ann_ord, seq), coalesce(_to, source_node_id), source_node_id)"),
    ).drop("_first", "_to")
    fresh = m.join(firsts, ["doc_id", "target_node_id"], "left_anti").selectExpr(
        "doc_id", "_to AS source_node_id", "target_node_id", "'CONTAINS' AS edge_type", "1D AS confidence",
        "8 AS ann_ord", "CAST(NULL AS BIGINT) AS seq",
    )
    key = ["doc_id", "source_node_id", "target_node_id", "edge_type"]
    ups = ok.where("action_type = 'UPDATE_EDGE'").select(
        "doc_id", F.col("edge_source").alias("source_node_id"), F.col("edge_target").alias("target_node_id"),
        F.coalesce("p_edge_type", F.lit("PREREQUISITE_OF")).alias("edge_type"),
        F.expr("coalesce(CAST(p_confidence AS DOUBLE), 1D)").alias("_c"), "ord",
    ).groupBy(*key).agg(F.max_by("_c", "ord").alias("_conf"))
    old = moved.unionByName(fresh)
    # Only the first of equal edges is updated.
    lead = old.groupBy(*key).agg(F.min(F.struct("ann_ord", "seq")).alias("_f"))
    hit = ups.join(lead, key, "left")
    changed = old.join(hit.where("_f IS NOT NULL"), key, "left").withColumn(
        "confidence", F.expr("IF(_conf IS NOT NULL AND _f <=> struct(ann_ord, seq), _conf, confidence)")
    ).drop("_conf", "_f")
    added = hit.where("_f IS NULL").select(
        *key, F.col("_conf").alias("confidence"), F.lit(9).alias("ann_ord"), F.lit(None).cast("long").alias("seq")
    )
    return changed.unionByName(added)


def drop_rejected(ns: DataFrame, es: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ns.where("review_state = 'REJECTED'").select("doc_id", "node_id").distinct()
    keep = ns.where("review_state <> 'REJECTED'")
    for side in ("source_node_id", "target_node_id"):
        es = es.join(gone.withColumnRenamed("node_id", side), ["doc_id", side], "left_anti")
    return keep, es


def overlay_summary(base_nodes: DataFrame, base_edges: DataFrame, status: DataFrame, ns: DataFrame, es: DataFrame,
                    documents: DataFrame) -> DataFrame:
    """Fingerprints, outcome counts, cycle flag and reconciliation status per document.

    Override ids are rows of ``override_status`` rather than arrays.
    """
    cycles = cyclic_documents(es.where("edge_type = 'CONTAINS'")).select("doc_id", F.lit(True).alias("has_cycle"))
    counts = status.groupBy("doc_id").agg(
        *[F.expr(f"count_if(outcome = '{o}')").alias(f"{o.lower()}_count")
          for o in ("APPLIED", "STALE", "CONFLICTED", "ERROR")]
    )
    before = graph_fingerprint(base_nodes, base_edges).withColumnRenamed("fingerprint", "base_graph_fingerprint")
    after = graph_fingerprint(ns, es).withColumnRenamed("fingerprint", "resolved_graph_fingerprint")
    df = documents.select("doc_id").distinct()
    for side in (counts, cycles, before, after):
        df = df.join(side, "doc_id", "left")
    df = df.fillna(0, ["applied_count", "stale_count", "conflicted_count", "error_count"]).fillna(False, ["has_cycle"])
    # The digest of an empty graph.
    blank = F.sha2(F.lit("\n---\n"), 256)
    return df.withColumns(
        {
            "base_graph_fingerprint": F.coalesce("base_graph_fingerprint", blank),
            "resolved_graph_fingerprint": F.coalesce("resolved_graph_fingerprint", blank),
            "reconciliation_status": F.expr(
                "CASE WHEN error_count > 0 OR has_cycle THEN 'INVALID_GRAPH' WHEN conflicted_count > 0 THEN 'CONFLICTS' "
                "WHEN stale_count > 0 THEN 'STALE_OVERRIDES' ELSE 'CLEAN' END"
            ),
        }
    )


# The two sentences shown to reviewers.
_STALE = "Target anchor key not found in the newly generated base graph (likely content deleted or renamed)."
_COLLISION = "Ambiguous matching or logical collision with other active user actions."


def reconciliation(status: DataFrame) -> DataFrame:
    """Stale and conflicted overrides with the reason shown to reviewers."""
    return status.where("outcome IN ('STALE', 'CONFLICTED')").select(
        "doc_id", "override_id", F.col("target_anchor_key").alias("anchor_key"), "action_type", "payload", "outcome",
        F.when(F.col("outcome") == "STALE", _STALE).otherwise(_COLLISION).alias("reason"),
    )
