"""Oracle SQL for the chain from documents to prompts."""

from .cte import build, view
from .search_sql import GROUNDING, NO_CONTEXT, OUTPUT_FORMAT, lit, search_chain

view("k_qry", "", """SELECT * EXCLUDE (ts), list_filter(ts, lambda x, i: list_position(ts, x) = i) AS terms FROM (
 SELECT doc_id AS query_id, ' Title THE Definition-'||(doc_id%10) AS query, 'title the definition-'||(doc_id%10) AS normalized,
  ['title','the','definition',CAST(doc_id%10 AS VARCHAR)] AS ts, concat('v', doc_id) AS version_id, 5 AS top_k, CASE WHEN doc_id%3=0 THEN 3 ELSE 1 END AS depth,
  true AS include_evidence, true AS include_passages,
  CAST(NULL AS VARCHAR[]) AS entity_types, CASE WHEN doc_id%4=0 THEN ['CONTAINS'] END AS relationship_types
 FROM documents WHERE doc_id%17<>0 AND doc_id%11<>0 AND doc_id%5<>0)""")
view("k_ent", "ent_k", """SELECT version_id, entity_id, min(n).node_id AS node_id, min(n).doc_id AS doc_id, min(n).category AS entity_type, min(n).title AS title, min(n).title AS content, min(n).stable_id AS stable_id,
 min(n).target_block_id AS target_block_id FROM (SELECT version_id, sha256(concat_ws(':', version_id, stable_id, category)) AS entity_id,
 struct_pack(node_id:=node_id, doc_id:=doc_id, category:=category, title:=title, stable_id:=stable_id, target_block_id:=target_block_id) AS n FROM ent_k) GROUP BY 1, 2""")
view("k_one", "k_ent", "SELECT version_id, node_id, max(entity_id) AS entity_id FROM k_ent GROUP BY 1, 2")
view("k_rel", "re k_one", """SELECT a.version_id, a.entity_id AS source_entity_id, b.entity_id AS target_entity_id, edge_type AS relationship_type, confidence FROM re r
 JOIN k_one a ON a.version_id=concat('v', r.doc_id) AND a.node_id=r.source_node_id JOIN k_one b ON b.version_id=a.version_id AND b.node_id=r.target_node_id
 WHERE a.entity_id<>b.entity_id AND edge_type IN ('CONTAINS','PREREQUISITE_OF','EXPLAINS','PROVES','ILLUSTRATES')""")
view("k_evd", "k_ent hx hclo", """SELECT sha256(concat_ws(':', e.entity_id, e.node_id)) AS evidence_id, e.entity_id, e.doc_id AS document_id, b.page_number,
 CASE WHEN b.seq IS NOT NULL THEN (SELECT arg_max(h.text, h.depth) FROM hclo c JOIN hx h ON h.doc_id=c.doc_id AND h.seq=c.anc AND h.block_type='HEADING' WHERE c.doc_id=b.doc_id AND c.seq=b.seq) END AS section_title,
 b.x0, b.y0, b.x1, b.y1 FROM k_ent e LEFT JOIN hx b ON b.doc_id=e.doc_id AND b.block_id=e.target_block_id WHERE e.target_block_id IS NOT NULL""")
search_chain("k_", "k_ent", "k_rel", "k_qry", "k_evd", "hx")

SQL = {
    "knowledge_constraints": build("ent_k k_rel k_evd k_ent hx", """SELECT 'entity_unique' AS "check", version_id||'|'||stable_id AS key, count(*) AS n FROM ent_k GROUP BY 2 HAVING count(*)>1
       UNION ALL SELECT 'relationship_unique', concat_ws('|', version_id, source_entity_id, target_entity_id, relationship_type), count(*) FROM k_rel GROUP BY 2 HAVING count(*)>1
       UNION ALL SELECT 'evidence_entity', entity_id, count(*) FROM k_evd v WHERE NOT EXISTS (SELECT 1 FROM k_ent e WHERE e.entity_id=v.entity_id AND e.entity_type<>'EXAMPLE') GROUP BY 2
       UNION ALL SELECT 'block_page', doc_id||'|'||page_number, count(*) FROM hx WHERE page_number%7=0 GROUP BY 2
       UNION ALL SELECT 'title_length', node_id, 1 FROM k_ent WHERE length(title)>42"""),
    "classified_statistics": build("hx blk", """SELECT doc_id, page_count, word_count, headings_count, paragraphs_count, lists_count, 3*page_count AS images_count, page_count AS tables_count FROM (
       SELECT doc_id, sum(len(list_filter(regexp_split_to_array(text,'\\s+'), lambda x: x<>'')))::BIGINT AS word_count, count(*) FILTER (block_type='HEADING') AS headings_count,
        count(*) FILTER (block_type='PARAGRAPH') AS paragraphs_count, count(*) FILTER (block_type='LIST') AS lists_count FROM hx GROUP BY 1)
       JOIN (SELECT doc_id, max(page_number)::BIGINT AS page_count FROM blk GROUP BY 1) USING (doc_id)"""),
    "chain_scope": build("k_qry", "SELECT query_id, version_id FROM k_qry"),
    "search_on_knowledge": build("k_hit k_ent", "SELECT query_id, version_id, entity_id, match_reason FROM k_hit JOIN k_ent USING (entity_id)"),
    "scoped_search": build("k_rnk k_ent", """SELECT query_id, rank, e.version_id, r.entity_id, hop, round(total_score,9) AS total_score, total_candidates
       FROM k_rnk r JOIN k_ent e USING (entity_id)"""),
    "chain_context": build("k_srcs", "SELECT query_id, 'S'||cite AS citation_id, entity_id, block_id, CASE WHEN block_id IS NULL THEN 'ENTITY_CONTENT' ELSE block_type END AS provenance FROM k_srcs"),
    "chain_prompts": build("k_qry k_srcs", f"""SELECT q.query_id, {lit(GROUNDING)} || chr(10)||chr(10)||'SUPPLIED CONTEXT SOURCES:'||chr(10) || coalesce(s.c, '{NO_CONTEXT}') || chr(10)||chr(10) || {lit(OUTPUT_FORMAT)} || chr(10)||chr(10)||'USER QUERY: ' || q.query AS prompt
       FROM k_qry q LEFT JOIN (SELECT query_id, string_agg('Source ID: S'||cite||chr(10)||'Title: '||title||' (Type: '||entity_type||')'||chr(10)||'Content: '||content||chr(10)||CASE WHEN text IS NULL THEN '' ELSE 'Verbatim Passage: '||text||chr(10) END||'---', chr(10) ORDER BY cite) AS c
       FROM k_srcs GROUP BY 1) s USING (query_id)"""),
}
