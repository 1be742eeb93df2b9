"""Views that give plain text tables the shape of parsed documents.

The text lines of ``documents`` become layout blocks with arithmetic geometry, 20
lines per page.  Everything is a projection of the stored table: no collect, no
generated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.settle import dealt

LINES_PER_PAGE = 20
PAGE_WIDTH, PAGE_HEIGHT = 595.0, 440.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _d(c):
    return c.cast("double")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block per text line, single column."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    split = documents.select("doc_id", F.split("text", "\n", -1).alias("_lines"))
    lines = split.select(
        "doc_id", F.size("_lines").cast("long").alias("doc_rows"), F.posexplode("_lines").alias("seq", "text")
    )
    n, s = F.length("text"), F.col("seq")
    left = F.lit(50) + F.lit(15) * (n % 3)
    row = s % LINES_PER_PAGE
    return lines.select(
        "doc_id",
        F.concat(F.lit("b"), F.col("doc_id").cast("string"), F.lit("_"), s.cast("string")).alias("block_id"),
        s.cast("long").alias("seq"),
        (F.lit(1) + F.floor(s / LINES_PER_PAGE)).cast("int").alias("page_number"),
        row.cast("int").alias("reading_order"),
        F.lit("PARAGRAPH").alias("block_type"),
        "text",
        _d(left).alias("x0"),
        _d(F.lit(20) + F.lit(20) * row).alias("y0"),
        _d(F.least(left + F.lit(5) * n, F.lit(560))).alias("x1"),
        _d(F.lit(32) + F.lit(20) * row).alias("y1"),
        _d(F.when(row == 0, 18).when(s % 7 == 0, 14).otherwise(10)).alias("font_size"),
        F.lit("Times").alias("font_family"),
        (s % 7 == 0).alias("bold"),
        F.lit(False).alias("italic"),
        (F.lit(1.0) - F.lit(0.1) * (n % 5)).alias("confidence"),
        F.lit("NATIVE").alias("provenance"),
        F.lit(PAGE_WIDTH).alias("page_width"),
        F.lit(PAGE_HEIGHT).alias("page_height"),
        "doc_rows",
    )


def two_column_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same lines laid out in two columns with full-width rows and vertical overlaps."""
    k = F.col("seq") % 5
    return blocks(spark, sf_dir).withColumns(
        {
            "x0": _d(F.when(k.isin(0, 1, 2), 50).otherwise(320)),
            "x1": _d(F.when(k == 0, 550).when(k.isin(1, 2), 280).otherwise(550)),
            "y1": _d(F.lit(44) + F.lit(20) * (F.col("seq") % LINES_PER_PAGE)),
        }
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_lines = F.size(F.split("text", "\n", -1))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.explode(F.sequence(F.lit(1), F.ceil(n_lines / LINES_PER_PAGE).cast("int"))).alias("page_number"),
        F.lit(PAGE_WIDTH).alias("width"),
        F.lit(PAGE_HEIGHT).alias("height"),
    )


def wrapped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines again, roughened so that sentences wrap, words break and signs need folding."""
    s, t = F.col("seq"), F.col("text")
    low = F.when(s % 3 != 0, F.lower(t)).otherwise(t)
    open_end = F.rtrim(low, F.lit("."))
    ended = (
        F.when((s % 5).isin(1, 2), F.concat(open_end, F.lit("-")))
        .when(s % 4 != 3, open_end)
        .otherwise(low)
    )
    broken = (
        F.when(s % 6 == 4, F.replace(ended, F.lit(", "), F.lit(",\n")))
        .when(s % 6 == 2, F.replace(ended, F.lit(" th"), F.lit(" t-\nh")))
        .otherwise(ended)
    )
    noisy = (
        F.when(s % 8 == 5, F.replace(broken, F.lit("e "), F.lit("e\t ")))
        .when(s % 8 == 6, F.replace(broken, F.lit("fi"), F.lit("\ufb01")))
        .when(s % 8 == 7, F.replace(broken, F.lit(" an"), F.lit(" \u2013 an\u0007")))
        .when(s % 11 == 0, F.lit(" \t"))
        .otherwise(broken)
    )
    return blocks(spark, sf_dir).withColumn("text", noisy)


def headed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds a running title, a running foot line and page numbers to the wrapped lines."""
    s = F.col("seq")
    number = F.col("page_number").cast("string")
    return wrapped_blocks(spark, sf_dir).withColumns(
        {
            "text": F.when(s % 20 == 0, F.lit("Running Title"))
            .when(s % 20 == 19, F.concat(F.lit("Page "), number))
            .when((s % 20 == 18) & (F.col("doc_id") % 2 == 0), F.lit("Foot Line"))
            .otherwise(F.col("text")),
            "x0": F.when((s % 20).isin(0, 18, 19), F.lit(50.0)).otherwise(F.col("x0")),
            "font_size": F.when((s % 20).isin(18, 19), F.lit(9.0)).otherwise(F.col("font_size")),
        }
    )


def rich_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with prefixes, signs and fonts that make every classification rule fire somewhere."""
    k = "seq % 23"
    text = f"""CASE {k}
        WHEN 3 THEN concat('- ', text) WHEN 4 THEN concat('  (a) ', text) WHEN 5 THEN concat('Note: ', text)
        WHEN 6 THEN concat('"', text, '"') WHEN 7 THEN concat('Table ', seq, ' ', text)
        WHEN 8 THEN 'a | b | c\\nd    e    f' WHEN 9 THEN 'return {{ x; }}; class;'
        WHEN 10 THEN 'x = 1 + 2 * (3 - 4)' WHEN 11 THEN concat('12 ', text) WHEN 12 THEN concat('Chapter ', seq)
        WHEN 13 THEN concat('Definition ', seq, ' ', text) WHEN 14 THEN concat('Theorem 3 ', text)
        WHEN 15 THEN concat('Summary of ', text) WHEN 16 THEN concat('Exercise 4 ', text)
        WHEN 17 THEN concat('1. ', text) WHEN 18 THEN '***' ELSE text END"""
    return blocks(spark, sf_dir).withColumns(
        {
            "text": F.expr(text),
            "x0": F.expr(f"CASE WHEN {k} IN (3, 17) THEN x0 + 20 * (seq % 4) ELSE x0 END"),
            "x1": F.expr(f"CASE WHEN {k} IN (3, 17) THEN x1 + 80 ELSE x1 END"),
            "font_size": F.expr(f"CASE WHEN {k} = 11 THEN 8D WHEN {k} = 12 THEN 22D ELSE font_size END"),
            "font_family": F.expr(f"CASE WHEN {k} = 9 THEN 'Courier' ELSE font_family END"),
            "italic": F.expr("seq % 17 = 0"),
        }
    )


def overrides(spark: SparkSession, sf_dir: str, nodes: DataFrame, moves: bool = False) -> DataFrame:
    """Correction events aimed at the academic nodes of all documents, derived from ``events``.

    An event belongs to a document by its ids, and to one of that document's nodes. Three of four
    events of a document expect the version that the ones before them lead to, the others one more.
    Verdicts come with notes, nested and in several orders of keys. With ``moves`` one in seven events
    moves a node under another one, of the same document but for some that move it nowhere.
    """
    n_docs = table(spark, sf_dir, "documents").count()
    ev = table(spark, sf_dir, "events").selectExpr(
        "event_id", f"(event_id * 7919 + user_id) % {n_docs} AS doc_id",
        "CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS DOUBLE) / 1000000 AS created_at",
        "event_id % 3 <> 0 AS is_active", "CAST(event_id % 4 <> 0 AS BIGINT) AS in_turn",
    )
    log = Window.partitionBy("doc_id").orderBy("created_at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    ev = ev.withColumn("expected_version", F.coalesce(F.sum("in_turn").over(log), F.lit(0)) + 1 - F.col("in_turn"))
    places = Window.partitionBy("doc_id").orderBy("seq")
    at = nodes.groupBy("doc_id", "seq").agg(F.max_by("anchor_key", "ann_ord").alias("_a")).select(
        "*", (F.row_number().over(places) - 1).cast("long").alias("k"), F.lead("seq").over(places).alias("_next")
    )
    per_doc = at.groupBy("doc_id").agg(F.count("*").alias("_n"), F.min("seq").alias("_first"))
    ev = ev.join(per_doc, "doc_id", "left").withColumn("k", F.expr("CASE WHEN event_id % 8 <> 7 THEN event_id % _n END"))
    kind = (
        "CASE event_id % 7 WHEN 0 THEN 'CHANGE_CATEGORY' WHEN 1 THEN 'RENAME_TITLE' WHEN 2 THEN 'ACCEPT_NODE' "
        "WHEN 3 THEN 'DELETE_NODE' WHEN 4 THEN 'UPDATE_EDGE' WHEN 5 THEN IF(event_id % 35 = 5, 'CREATE_NODE', 'ACCEPT_NODE') "
        f"ELSE {"'REPARENT_NODE'" if moves else "'ACCEPT_NODE'"} END"
    )
    payload = r"""CASE action_type
        WHEN 'CHANGE_CATEGORY' THEN concat('{"new_category":"', CASE WHEN event_id % 29 = 0 THEN 'BOGUS'
            WHEN event_id % 41 = 0 THEN 'THEOREM' WHEN seq % 2 = 0 THEN 'CONCEPT' ELSE 'EXAMPLE' END, '"}')
        WHEN 'RENAME_TITLE' THEN concat('{"new_title":"', IF(event_id % 31 = 0, ' ', concat(' Title ', event_id % 3)), '"}')
        WHEN 'UPDATE_EDGE' THEN concat('{"source_node_id":"an_b', doc_id, '_', seq, '","target_node_id":"an_b', doc_id,
            '_', first_seq, '","edge_type":"', IF(seq % 2 = 0, 'EXPLAINS', 'PREREQUISITE_OF'), '","confidence":0.5}')
        WHEN 'CREATE_NODE' THEN concat('{"category":"', IF(event_id % 3 = 1, 'CONCEPT', 'NOPE'), '","title":"Made ', event_id,
            '","anchor_key":"made_', event_id % 2, '"}')
        WHEN 'REPARENT_NODE' THEN concat('{"new_parent_id":"an_b', doc_id, '_',
            CASE event_id % 5 WHEN 0 THEN first_seq WHEN 1 THEN -1 ELSE coalesce(_next, first_seq) END, '"}')
        ELSE CASE event_id % 43 WHEN 0 THEN '{"note":{"a":1,"b":[2]}}' WHEN 1 THEN '{"note":{"b":[2],"a":1.0}}'
            WHEN 2 THEN '{"note":{"a":"1","b":[2]}}' ELSE '{}' END END"""
    return (
        ev.join(at, ["doc_id", "k"], "left")
        .withColumns({"action_type": F.expr(kind), "seq": F.expr("coalesce(seq, 0L)"), "first_seq": F.expr("coalesce(_first, 0L)")})
        .selectExpr(
            "doc_id", "concat('ov', lpad(CAST(event_id AS STRING), 12, '0')) AS override_id",
            "coalesce(_a, concat('made_', event_id % 2)) AS target_anchor_key", "action_type", f"{payload} AS payload",
            "is_active", "created_at", "expected_version",
        )
    )


VERSIONS = 4


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS entity_id", f"concat('v', p_partkey % {VERSIONS}) AS version_id", "p_type AS entity_type", "p_name AS title",
        "concat(p_type, ' ', p_brand) AS content", "concat('anc_', p_partkey) AS stable_id", "p_partkey",
    )


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one version on neighbouring lines of an order; every part points at one of them."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    nxt = li.selectExpr("l_orderkey", "l_partkey AS dst", "l_linenumber - 1 AS l_linenumber")
    pairs = li.join(dealt(nxt), ["l_orderkey", "l_linenumber"]).where(f"l_partkey <> dst AND l_partkey % {VERSIONS} = dst % {VERSIONS}").groupBy(
        F.col("l_partkey").alias("src")).agg(F.min("dst").alias("dst"))
    return pairs.selectExpr(
        f"concat('v', src % {VERSIONS}) AS version_id", "CAST(src AS STRING) AS source_entity_id", "CAST(dst AS STRING) AS target_entity_id",
        "element_at(array('CONTAINS', 'PREREQUISITE_OF', 'EXPLAINS', 'PROVES', 'ILLUSTRATES'), CAST((src + dst) % 5 AS INT) + 1) "
        "AS relationship_type",
        "CAST((src + dst) % 10 AS DOUBLE) / 10 AS confidence",
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evidence row per part on some block of some document, some stale, some without a box."""
    n_docs = table(spark, sf_dir, "documents").count()
    b = blocks(spark, sf_dir).select("doc_id", "seq", "doc_rows", "page_number", "x0", "y0", "x1", "y1")
    rows = b.where("seq = 0").select("doc_id", F.col("doc_rows").alias("_n"))
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", f"(p_partkey * 31) % {n_docs} AS doc_id").join(dealt(rows), "doc_id")
    p = p.withColumn("seq", F.expr("p_partkey % _n")).join(dealt(b.drop("doc_rows")), ["doc_id", "seq"])
    box = lambda e: f"IF(p_partkey % 7 = 0 OR p_partkey % 11 = 0, NULL, {e})"
    return p.selectExpr(
        "concat('e', p_partkey) AS evidence_id", "CAST(p_partkey AS STRING) AS entity_id", f"concat('v', p_partkey % {VERSIONS}) AS version_id",
        "doc_id AS document_id", "IF(p_partkey % 7 = 0, NULL, page_number) AS page_number",
        "concat('Section ', p_partkey % 3) AS section_title",
        f"{box('x0')} AS x0", f"{box('y0 + 5')} AS y0", f"{box('x1')} AS x1", f"{box('y1 + 25')} AS y1",
    )


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names, their first words, part types and word-type pairs as queries of one version each.
    One in 13 asks for more than is allowed; some want no relationships, evidence or passages."""
    p = table(spark, sf_dir, "part").select("p_name", "p_type").distinct()
    q = p.select(
        F.explode(F.expr("array(p_name, split(p_name, ' ')[0], lower(p_type), concat(split(p_name, ' ')[0], ' ', lower(p_type)))"))
        .alias("query")
    ).distinct()
    return q.selectExpr(
        "query AS query_id", "concat(' ', upper(query), ' ') AS query", f"concat('v', length(query) % {VERSIONS}) AS version_id",
        "IF(length(query) % 13 = 0, 101, 10) AS top_k",
        "CASE length(query) % 7 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE length(query) % 2 END AS depth",
        "IF(length(query) % 4 = 0, array('PROMO', 'SMALL'), NULL) AS entity_types",
        "IF(length(query) % 5 = 0, array('CONTAINS', 'EXPLAINS'), NULL) AS relationship_types", "'LEXICAL' AS strategy",
        "length(query) % 9 <> 0 AS include_relationships", "IF(length(query) % 11 = 0, false, NULL) AS include_evidence",
        "length(query) % 10 <> 0 AS include_passages",
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the text lines with pixel boxes, two pixels per point."""
    b = blocks(spark, sf_dir).select("doc_id", "page_number", "seq", "x0", "y0", "y1", F.posexplode(F.split("text", " ", -1)).alias("i", "text"))
    return b.where("text <> ''").selectExpr(
        "doc_id", "page_number", "CAST(seq AS INT) AS block_num", "0 AS line_num", "CAST(seq * 100000 + i AS BIGINT) AS word_ord", "text",
        "2 * (x0 + 40 * i) AS x0", "2 * (x0 + 40 * i) + 10 * length(text) AS x1", "2 * y0 AS y0", "2 * y1 AS y1",
        "1D - 0.05D * (length(text) % 10) AS confidence", "1190 AS img_w", "880 AS img_h",
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END"
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS job_id", "event_id", f"{status} AS status", "ts AS updated_at", "upper(event_type) AS current_stage", "CAST(event_id * 7 % 101 AS INT) AS progress",
        "IF(event_type = 'error', concat('E', event_id % 5), IF(event_id % 2 = 0, '', NULL)) AS error",
        "IF(event_type = 'click', concat('d', event_id), NULL) AS document_id")
