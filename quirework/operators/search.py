"""Ranked, graph-expanded search for many queries in one job."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.geometry import bands, band_of
from .graph import expand_hops
from .settle import dealt, discard, few_or_dealt, settle

GRAM, BAND = 3, 64.0


# What share of the score each signal has.
WEIGHTS = {
    "title": 0.30, "content": 0.10, "coverage": 0.15, "type": 0.10, "relationship": 0.10, "evidence": 0.10, "passage": 0.10, "confidence": 0.05,
}


def shares(changes: Mapping[str, float]) -> dict[str, float]:
    """The shares of the signals with some of them changed; together they are the whole score."""
    out = WEIGHTS | dict(changes)
    unknown = out.keys() - WEIGHTS.keys()
    if unknown or not math.isclose(math.fsum(out.values()), 1, abs_tol=1e-6):
        raise ValueError(f"unknown signals {sorted(unknown)}" if unknown else f"the shares of the signals make {math.fsum(out.values()):.3f} of a score")
    return out


def normalize_queries(queries: DataFrame) -> DataFrame:
    """Lower-cased query and its distinct alphanumeric terms in order."""
    return queries.withColumn("normalized", F.expr(f"lower({tx.sql_strip('query')})")).withColumn(
        "terms", F.expr("array_distinct(filter(split(normalized, '[^a-zA-Z0-9]+'), x -> x <> ''))")
    )


def validate_requests(queries: DataFrame) -> DataFrame:
    """``reject_reason`` is the first rule a request breaks, or null."""
    rules = (
        (f"{tx.sql_strip(chr(96) + 'query' + chr(96))} = '' OR query IS NULL", "EMPTY_QUERY"),
        ("length(query) > 2048", "QUERY_TOO_LONG"),
        ("top_k NOT BETWEEN 1 AND 100", "TOP_K_RANGE"),
        ("depth NOT BETWEEN 0 AND 3", "DEPTH_RANGE"),
        ("strategy <> 'LEXICAL'", "UNSUPPORTED_STRATEGY"),
    )
    return queries.withColumn("reject_reason", F.expr("CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r in rules) + " END"))


def resolve_scope(queries: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Version each query searches, or the reason it cannot be resolved.

    ``documents``: document_id, upload_id.  ``versions``: version_id, upload_id, status, approval_version.
    """
    latest = versions.where("status = 'FINALIZED'").groupBy("upload_id").agg(
        F.max_by("version_id", "approval_version").alias("_latest")
    )
    docs = documents.select("document_id", F.col("upload_id").alias("_doc_upload"))
    asked = versions.select(F.col("version_id"), F.col("upload_id").alias("_v_upload"), F.col("status").alias("_status"))
    df = queries.join(docs, "document_id", "left").join(asked, "version_id", "left").join(
        latest.withColumnRenamed("upload_id", "_doc_upload"), "_doc_upload", "left"
    )
    error = (
        "CASE WHEN _doc_upload IS NULL THEN 'DOCUMENT_NOT_FOUND' WHEN version_id IS NOT NULL THEN "
        "CASE WHEN _status IS NULL THEN 'VERSION_NOT_FOUND' WHEN _status <> 'FINALIZED' THEN 'VERSION_NOT_FINALIZED' "
        "WHEN _v_upload <> _doc_upload THEN 'VERSION_OF_OTHER_DOCUMENT' END "
        "WHEN _latest IS NULL THEN 'NO_FINALIZED_VERSION' END"
    )
    return df.withColumn("scope_error", F.expr(error)).withColumn(
        "resolved_version_id", F.expr("IF(scope_error IS NULL, coalesce(version_id, _latest), NULL)")
    ).drop("_doc_upload", "_v_upload", "_status", "_latest")


def _grams(c: str, n: int) -> str:
    return (
        f"IF(length({c}) < {n}, CAST(array() AS array<string>), "
        f"array_distinct(transform(sequence(1, length({c}) - {n - 1}), i -> substring({c}, i, {n}))))"
    )


def match_terms(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(version_id, term, entity_id) for every term contained in a title or content.

    Terms are matched once however many queries use them.  Each term is looked up by its
    rarest three-letter piece (shorter terms by themselves), so only entities holding
    that piece are compared; no query meets every entity of its version.
    """
    terms = queries.select("version_id", F.explode("terms").alias("term")).distinct()
    pieces = terms.withColumn("gram", F.explode(F.expr(f"IF(length(term) < {GRAM}, array(term), {_grams('term', GRAM)})")))
    wanted = settle(pieces.select("version_id", "gram").distinct())
    text = entities.select(
        "version_id", "entity_id", F.lower("title").alias("title_l"), F.lower(F.coalesce("content", F.lit(""))).alias("content_l")
    )
    # Grams travel without the texts; the texts meet the few candidates at the end.
    both = [f"concat({_grams('title_l', n)}, {_grams('content_l', n)})" for n in (1, 2, 3)]
    grams = text.select("version_id", "entity_id", F.explode(F.expr(f"array_distinct(concat({', '.join(both)}))")).alias("gram"))
    index = settle(grams.join(few_or_dealt(wanted), ["version_id", "gram"], "left_semi"))
    discard(wanted)
    sizes = index.groupBy("version_id", "gram").agg(F.count("*").alias("n"))
    # A piece that occurs nowhere means no match, so an inner join may drop it; the term then has
    # fewer pieces than it should and is dropped as a whole.
    counted = settle(pieces.join(dealt(sizes), ["version_id", "gram"], "left").groupBy("version_id", "term").agg(
        F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n")
    ).where("n > 0").drop("n"))
    return (
        few_or_dealt(counted).join(index, ["version_id", "gram"]).select("version_id", "term", "entity_id").join(dealt(text), ["version_id", "entity_id"])
        .where("contains(title_l, term) OR contains(content_l, term)")
        .select("version_id", "term", "entity_id")
    )


def lexical_match(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """Direct hits with match reason, score and matched terms.

    ``queries`` carry version_id (resolved), normalized, terms and entity_types.
    """
    hits = match_terms(queries, entities)
    q = queries.select("query_id", "version_id", "normalized", "terms", "entity_types")
    asked = q.select("query_id", "version_id", F.explode("terms").alias("term"))
    pairs = few_or_dealt(asked).join(hits, ["version_id", "term"]).select("query_id", "version_id", "entity_id").distinct()
    e = entities.select(
        "version_id", "entity_id", "entity_type", "title", "content", "stable_id",
        F.lower("title").alias("title_l"), F.lower(F.coalesce("content", F.lit(""))).alias("content_l"),
    )
    df = pairs.join(dealt(e), ["version_id", "entity_id"]).join(few_or_dealt(q.drop("version_id")), "query_id").where(
        "entity_types IS NULL OR size(entity_types) = 0 OR array_contains(entity_types, entity_type)"
    )
    df = df.withColumn("_tt", F.expr("filter(terms, t -> contains(title_l, t))"))
    df = df.withColumn(
        "match_reason",
        F.expr(
            "CASE WHEN title_l = normalized THEN 'title_exact' WHEN startswith(title_l, normalized) THEN 'title_prefix' "
            "WHEN contains(title_l, normalized) THEN 'title_contains' WHEN size(_tt) > 0 THEN 'title_term' "
            "ELSE 'content_contains' END"
        ),
    )
    return df.withColumns(
        {
            "match_score": F.expr(
                "CASE match_reason WHEN 'title_exact' THEN 1D WHEN 'title_prefix' THEN 0.8D WHEN 'title_contains' THEN 0.6D "
                "WHEN 'title_term' THEN 0.4D ELSE 0.2D END"
            ),
            "matched_terms": F.expr(
                "CASE match_reason WHEN 'title_exact' THEN terms WHEN 'content_contains' THEN "
                "filter(terms, t -> contains(content_l, t)) ELSE _tt END"
            ),
        }
    ).select("query_id", "version_id", "entity_id", "match_score", "match_reason", "matched_terms")


def expand(queries: DataFrame, hits: DataFrame, entities: DataFrame, relationships: DataFrame, max_depth: int = 3):
    """Direct hits plus neighbours up to each query's depth, and the relationships met on the way."""
    have = entities.select("version_id", "entity_id")
    e = relationships
    for side in ("source_entity_id", "target_entity_id"):
        e = e.join(dealt(have.withColumnRenamed("entity_id", side)), ["version_id", side], "left_semi")
    both = e.select(
        F.col("version_id").alias("edge_version"), "relationship_type",
        F.explode(
            F.array(
                F.struct(F.col("source_entity_id").alias("src"), F.col("target_entity_id").alias("dst")),
                F.struct(F.col("target_entity_id").alias("src"), F.col("source_entity_id").alias("dst")),
            )
        ).alias("p"),
    ).select("edge_version", "relationship_type", "p.src", "p.dst").distinct()
    q = few_or_dealt(queries.select("query_id", F.col("depth").alias("max_depth"), "relationship_types"))
    seeds = hits.select("query_id", "version_id", "entity_id").join(q, "query_id")
    seen = expand_hops(seeds, both, max_depth, ["query_id", "version_id"])
    cands = seen.join(dealt(hits.drop("version_id")), ["query_id", "entity_id"], "left").withColumns(
        {
            "match_score": F.coalesce("match_score", F.lit(0.0)),
            "match_reason": F.coalesce("match_reason", F.lit("graph_neighbor")),
            "matched_terms": F.expr("coalesce(matched_terms, CAST(array() AS array<string>))"),
        }
    )
    opened = seen.join(q, "query_id").where("hop < max_depth")
    touched = e.withColumn("_end", F.explode(F.array("source_entity_id", "target_entity_id")))
    rels = (
        opened.join(dealt(touched), (touched["version_id"] == opened["version_id"]) & (F.col("_end") == opened["entity_id"]))
        .where("relationship_types IS NULL OR size(relationship_types) = 0 OR array_contains(relationship_types, relationship_type)")
        .groupBy("query_id", "source_entity_id", "target_entity_id", "relationship_type")
        .agg((F.min("hop") + 1).alias("hop"), F.max(F.coalesce("confidence", F.lit(1.0))).alias("confidence"))
    )
    return cands, rels


def evidence_of(cands: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence of the candidates; without a page it is stale."""
    return cands.select("query_id", "entity_id").join(dealt(evidence), "entity_id").dropDuplicates(
        ["query_id", "evidence_id"]).withColumn("is_stale", F.col("page_number").isNull())


def locate(evidence: DataFrame, blocks: DataFrame, band: float = BAND) -> DataFrame:
    """Block under each fresh evidence box: largest overlap, then reading order, then id.

    Independent of any query, so it is computed once per evidence row.
    """
    ev = evidence.where("page_number IS NOT NULL AND x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL")
    a = ev.select("evidence_id", "document_id", "page_number", *[F.col(c).alias(f"e{c}") for c in ("x0", "y0", "x1", "y1")]
                  ).withColumn("_band", F.explode(bands(F.col("ey0"), F.col("ey1"), band)))
    b = blocks.select(
        F.col("doc_id").alias("document_id"), "page_number", "block_id", "reading_order", "x0", "y0", "x1", "y1"
    ).withColumn("_band", F.explode(bands(F.col("y0"), F.col("y1"), band)))
    w = "least(ex1, x1) - greatest(ex0, x0)"
    h = "least(ey1, y1) - greatest(ey0, y0)"
    hit = a.join(dealt(b), ["document_id", "page_number", "_band"]).where(f"{w} > 0 AND {h} > 0").where(
        F.col("_band") == band_of(F.greatest("ey0", "y0"), band)
    )
    return hit.withColumn("_area", F.expr(f"round(({w}) * ({h}), 6)")).groupBy("evidence_id", "document_id").agg(
        F.min_by("block_id", F.struct(-F.col("_area"), F.col("reading_order"), F.col("block_id"))).alias("block_id")
    )


def passages(ev: DataFrame, located: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per (query, block, entity) with block text, neighbours and section title of the first evidence."""
    here = blocks.select(F.col("doc_id").alias("document_id"), "block_id", "seq", "page_number", "text", "block_type", "x0", "y0", "x1", "y1")
    # Only located blocks and the two beside each of them are read; texts move once.
    spots = here.select("document_id", "block_id", "seq").join(
        dealt(located.select("document_id", "block_id").distinct()), ["document_id", "block_id"], "left_semi")
    wanted = spots.select("document_id", F.col("block_id").alias("_spot"), F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_side"), "seq")
    wanted = wanted.withColumn("seq", F.col("seq") + F.col("_side"))
    side = lambda k, c: F.max(F.when(F.col("_side") == k, F.col(c)))
    around = wanted.join(dealt(here), ["document_id", "seq"]).groupBy("document_id", F.col("_spot").alias("block_id")).agg(
        side(-1, "text").alias("previous_text"), side(1, "text").alias("next_text"),
        *[side(0, c).alias(c) for c in ("page_number", "text", "block_type", "x0", "y0", "x1", "y1")],
    )
    on = ev.where("NOT is_stale").select(
        "query_id", "entity_id", "evidence_id", F.col("section_title"), F.col("page_number").alias("_page")
    ).join(dealt(located), "evidence_id")
    order = F.struct("entity_id", "_page", "evidence_id")
    first = on.groupBy("query_id", "document_id", "block_id").agg(
        F.min_by("section_title", order).alias("section_title"), F.min(order).alias("passage_order")
    )
    links = on.select("query_id", "document_id", "block_id", "entity_id").distinct()
    return links.join(dealt(first), ["query_id", "document_id", "block_id"]).join(dealt(around), ["document_id", "block_id"])


def score(queries: DataFrame, cands: DataFrame, rels: DataFrame, ev: DataFrame, passes: DataFrame, entities: DataFrame,
          changes: Mapping[str, float] = {}) -> DataFrame:
    """Eight signals and their weighted sum for every candidate; ``changes`` are shares that differ."""
    e = ev.groupBy("query_id", "entity_id").agg(F.bool_or(~F.col("is_stale")).alias("_fresh"))
    p = passes.select("query_id", "entity_id").distinct().withColumn("_pass", F.lit(True))
    c = rels.select(
        "query_id", "confidence", F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id")
    ).groupBy("query_id", "entity_id").agg(F.greatest(F.max("confidence"), F.lit(0.0)).alias("_conf"))
    q = queries.select("query_id", "terms", "entity_types", "top_k")
    df = cands.join(dealt(entities.select("version_id", "entity_id", "entity_type", "title", "content", "stable_id")), ["version_id", "entity_id"])
    for side in (e, p, c):
        df = df.join(dealt(side), ["query_id", "entity_id"], "left")
    df = df.join(few_or_dealt(q), "query_id")
    body, head = (f"lower({tx.sql_strip(f'coalesce({x}, {chr(39)}{chr(39)})')})" for x in ("content", "title"))
    df = df.withColumns({"_body": F.expr(body), "_head": F.expr(head)})
    parts = {
        "title": "CASE match_reason WHEN 'title_exact' THEN 1D WHEN 'title_prefix' THEN 0.8D WHEN 'title_contains' THEN 0.6D "
                 "WHEN 'title_term' THEN 0.4D ELSE 0D END",
        "content": "CASE WHEN _body = '' OR _body = _head THEN 0D WHEN match_reason = 'content_contains' "
                   "OR exists(terms, t -> contains(_body, t)) THEN 1D ELSE 0D END",
        "coverage": "IF(size(terms) > 0, size(matched_terms) / CAST(size(terms) AS DOUBLE), 0D)",
        "type": "IF(coalesce(array_contains(entity_types, entity_type), false), 1D, 0D)",
        "relationship": "1D / (hop + 1)",
        "evidence": "CASE WHEN _fresh THEN 1D WHEN NOT _fresh THEN 0.5D ELSE 0D END",
        "passage": "IF(_pass, 1D, 0D)",
        "confidence": "coalesce(_conf, 0D)",
    }
    df = df.withColumns({f"{k}_score": F.expr(v) for k, v in parts.items()})
    share = shares(changes)
    total = " + ".join(f"{share[k]}D * {k}_score" for k in parts)
    return df.withColumn("total_score", F.expr(total)).drop("_fresh", "_pass", "_conf", "_body", "_head")


OPTIONS = ("include_relationships", "include_evidence", "include_passages")


def with_options(queries: DataFrame) -> DataFrame:
    """What a request wants, as it takes effect: absent or null options mean yes, a request
    without relationships is not expanded, one without evidence has no passages either."""
    given = queries.withColumns({o: F.coalesce(F.col(o), F.lit(True)) if o in queries.columns else F.lit(True) for o in OPTIONS})
    return given.withColumns({
        "depth": F.when(F.col("include_relationships"), F.col("depth")).otherwise(0),
        "include_passages": F.col("include_passages") & F.col("include_evidence"),
    })


def wanted(rows: DataFrame, queries: DataFrame, option: str) -> DataFrame:
    """The rows of the requests that want them."""
    return rows.join(few_or_dealt(queries.where(F.col(option)).select("query_id")), "query_id", "left_semi")


def provenance(queries: DataFrame, ranked: DataFrame, versions: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per request: what was searched (version, approval, document), how (strategy, terms),
    and how much there was to find. ``versions``: version_id, approval_version, document_id."""
    seen = ranked.groupBy("query_id").agg(F.max("total_candidates").alias("total_candidates_considered"), F.bool_or("has_more").alias("has_more"))
    whole = entities.groupBy("version_id").agg(F.count("*").alias("total_entity_count"))
    out = queries.select("query_id", "version_id", F.col("strategy").alias("strategy_used"), F.col("terms").alias("query_terms"))
    out = out.join(dealt(versions.select("version_id", "approval_version", "document_id")), "version_id", "left")
    out = out.join(dealt(whole), "version_id", "left").join(dealt(seen), "query_id", "left")
    return out.fillna(0, ["approval_version", "total_entity_count", "total_candidates_considered"]).fillna(False, ["has_more"])


def accepted(queries: DataFrame) -> DataFrame:
    """The requests that break no rule."""
    return validate_requests(queries).where("reject_reason IS NULL").drop("reject_reason")


def largest_top_k(queries: DataFrame) -> int:
    return queries.agg(F.max("top_k")).first()[0] or 0


def rank(scored: DataFrame, largest: int) -> DataFrame:
    """Best ``top_k`` per query in a total order; no request asks for more than ``largest``, so
    that many rows per query and task are enough before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(
        F.desc("total_score"), F.desc("match_score"), "hop", "stable_id", "entity_id"
    )
    totals = scored.groupBy("query_id").agg(F.count("*").alias("total_candidates"))
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= largest).where("rank <= top_k")
    return top.join(dealt(totals), "query_id").withColumn("has_more", F.col("total_candidates") > F.col("top_k"))


def package(ranked: DataFrame, rels: DataFrame, ev: DataFrame, passes: DataFrame) -> dict[str, DataFrame]:
    """Relationship, evidence and passage rows of the ranked entities only."""
    key = few_or_dealt(ranked.select("query_id", "entity_id", "rank"))
    return {
        "outgoing": key.join(rels.withColumnRenamed("source_entity_id", "entity_id"), ["query_id", "entity_id"]),
        "incoming": key.join(rels.withColumnRenamed("target_entity_id", "entity_id"), ["query_id", "entity_id"]),
        "evidence": key.join(ev, ["query_id", "entity_id"]),
        "passages": key.join(passes, ["query_id", "entity_id"]),
    }


def package_counts(ranked: DataFrame, rels: DataFrame, ev: DataFrame, passes: DataFrame) -> DataFrame:
    df = ranked.select("query_id", "rank", "entity_id", "total_candidates", "has_more")
    for name, rows in package(ranked, rels, ev, passes).items():
        n = rows.groupBy("query_id", "entity_id").agg(F.count("*").alias(f"n_{name}"))
        df = df.join(dealt(n), ["query_id", "entity_id"], "left").fillna(0, [f"n_{name}"])
    return df
