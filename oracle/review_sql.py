"""Oracle SQL for the academic graph, the overlay, review and the knowledge build."""

from . import structure_sql  # noqa: F401
from .cte import build, view
from .text_sql import WS

W = r"\p{L}\p{N}_"
MATH = rf"(^|[^{W}])[xXyYzZ]($|[^{W}])|[+\-*/=<>()]\s*[0-9]+|(^|[^{W}])\d+\s*[+\-*/=]|[∀-⋿]"
I = {
    "starts_with_definition": r"^(?i:Definition|Def\.)\s+\d+", "starts_with_theorem": r"^(?i:Theorem|Thm\.)\s+\d+",
    "starts_with_proof": rf"^(?i:Proof)($|[^{W}])|^(?i:Pf\.)[{W}]", "starts_with_example": r"^(?i:Example|Ex\.)\s+\d+",
    "starts_with_exercise": r"^(?i:Exercise|Exer\.)\s+\d+",
    "starts_with_objective": rf"^(?i:Learning Objectives?|Objectives?)($|[^{W}])",
    "starts_with_summary": rf"^(?i:Summary|Key Takeaways?)($|[^{W}])",
}
m = lambda k: f"regexp_matches(t, '{I[k]}')"
view("ax", "hx", f"""
SELECT *, regexp_matches(t, '{MATH}') AS has_math, {', '.join(f'{m(k)} AS {k}' for k in I)} FROM (SELECT * EXCLUDE (t), trim(text, {WS}) AS t FROM hx)""")
view("an", "ax", """
SELECT *, 1 AS ann_ord, CASE WHEN block_type='HEADING' THEN CASE depth WHEN 0 THEN 'UNIT' WHEN 1 THEN 'CHAPTER' WHEN 2 THEN 'SECTION' ELSE 'TOPIC' END
   WHEN lower(t) LIKE 'chapter %' OR lower(t) LIKE 'chap. %' THEN 'CHAPTER' ELSE 'UNIT' END AS academic_type,
   CASE WHEN block_type='HEADING' THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END AS ann_confidence, 'CURRICULUM_CLASSIFICATION_MODULE' AS prov
FROM ax WHERE block_type='HEADING' OR lower(t) LIKE 'chapter %' OR lower(t) LIKE 'chap. %' OR lower(t) LIKE 'unit %'
UNION ALL BY NAME
SELECT *, 2 AS ann_ord, CASE WHEN starts_with_definition THEN 'DEFINITION' WHEN starts_with_theorem THEN 'THEOREM' WHEN starts_with_proof THEN 'PROOF'
   WHEN starts_with_example THEN 'EXAMPLE' ELSE 'FORMULA' END AS academic_type,
   CASE WHEN starts_with_definition OR starts_with_theorem OR starts_with_proof OR starts_with_example THEN 0.85::DOUBLE ELSE 0.9::DOUBLE END AS ann_confidence,
   'EXPOSITORY_CLASSIFICATION_MODULE' AS prov
FROM ax WHERE starts_with_definition OR starts_with_theorem OR starts_with_proof OR starts_with_example OR (has_math AND block_type='EQUATION')
UNION ALL BY NAME
SELECT *, 3 AS ann_ord, CASE WHEN starts_with_objective THEN 'LEARNING_OBJECTIVE' WHEN starts_with_summary THEN 'SUMMARY' ELSE 'EXERCISE' END AS academic_type,
   0.85::DOUBLE AS ann_confidence, 'PEDAGOGICAL_CLASSIFICATION_MODULE' AS prov
FROM ax WHERE starts_with_objective OR starts_with_summary OR starts_with_exercise""")
view("spath", "hx hclo", rf"""
SELECT c.doc_id, c.seq, string_agg(trim(regexp_replace(regexp_replace(lower(trim(h.text)), '[^a-z0-9\s\-]', '', 'g'), '[\s\-]+', '-', 'g'), '-'), '/' ORDER BY h.depth) AS p
FROM hclo c JOIN hx h ON h.doc_id=c.doc_id AND h.seq=c.anc AND h.block_type='HEADING' GROUP BY ALL""")
view("pann", "an hclo hx", """
SELECT c.doc_id, c.seq, arg_max(h.block_id, h.depth) AS pa FROM hclo c JOIN (SELECT DISTINCT doc_id, seq FROM an) a ON a.doc_id=c.doc_id AND a.seq=c.anc
JOIN hx h ON h.doc_id=c.doc_id AND h.seq=c.anc GROUP BY ALL""")
view("anc", "an spath pann", rf"""
SELECT *, sha256(concat(doc_id, ':', section_path, ':', academic_type, ':', sha256(regexp_replace(lower(text), '[^{W}]', '', 'g')), ':', ordinal)) AS anchor_key
FROM (SELECT a.*, coalesce(p, 'root') AS section_path, pa,
  row_number() OVER (PARTITION BY a.doc_id, coalesce(p,'root'), academic_type ORDER BY ann_ord, a.seq) - 1 AS ordinal
  FROM an a LEFT JOIN spath s USING (doc_id, seq) LEFT JOIN pann q USING (doc_id, seq))""")
view("nd", "anc", """
SELECT doc_id, concat('an_', block_id) AS node_id, academic_type AS category,
 CASE WHEN length(text)>40 THEN left(text,40)||'...' WHEN text='' THEN academic_type ELSE text END AS title, block_id AS target_block_id,
 last_value(anchor_key) OVER (PARTITION BY doc_id, block_id ORDER BY ann_ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS anchor_key,
 'UNREVIEWED' AS review_state, prov AS provenance, ann_ord, seq FROM anc""")
view("ed", "anc", "SELECT doc_id, concat('an_', pa) AS source_node_id, concat('an_', block_id) AS target_node_id, 'CONTAINS' AS edge_type, ann_confidence AS confidence, ann_ord, seq FROM anc WHERE pa IS NOT NULL")
view("aq", "nd ed hx", """
SELECT *, CASE WHEN containers>0 THEN covered/containers ELSE 1 END AS coverage, CASE WHEN content>0 THEN orphan_count/content ELSE 0 END AS orphan_ratio, content/page_count AS density,
 greatest(0, least(1, (CASE WHEN containers>0 THEN covered/containers ELSE 1 END) * (1 - CASE WHEN content>0 THEN orphan_count/content ELSE 0 END))) AS academic_score
FROM (SELECT n.doc_id, count(*) AS node_count, count(*) FILTER (category IN ('CHAPTER','SECTION')) AS containers,
 count(*) FILTER (category NOT IN ('CHAPTER','SECTION','UNIT')) AS content,
 count(DISTINCT node_id) FILTER (category IN ('CHAPTER','SECTION') AND EXISTS (SELECT 1 FROM ed e JOIN nd c ON c.doc_id=e.doc_id AND c.node_id=e.target_node_id
    AND c.category NOT IN ('CHAPTER','SECTION','UNIT') WHERE e.doc_id=n.doc_id AND e.source_node_id=n.node_id)) AS covered,
 count(*) FILTER (category NOT IN ('CHAPTER','SECTION','UNIT') AND NOT EXISTS (SELECT 1 FROM ed e WHERE e.doc_id=n.doc_id AND e.target_node_id=n.node_id)) AS orphan_count,
 any_value(page_count) AS page_count, false AS cycle_detected
FROM nd n JOIN (SELECT doc_id, max(page_number) AS page_count FROM hx GROUP BY 1) USING (doc_id) GROUP BY n.doc_id)""")


def fp(nd, ed):
    return f"""SELECT d.doc_id, sha256(coalesce((SELECT string_agg(l, chr(10) ORDER BY encode(l)) FROM (
   SELECT concat(coalesce(n.anchor_key, n.node_id), ':', n.category, ':', coalesce(p.anchor_key,''), ':', n.title) AS l FROM {nd} n
   LEFT JOIN (SELECT e.doc_id, e.target_node_id, last(e.source_node_id ORDER BY e.ann_ord, e.seq) AS s FROM {ed} e WHERE edge_type='CONTAINS' GROUP BY ALL) e
     ON e.doc_id=n.doc_id AND e.target_node_id=n.node_id
   LEFT JOIN (SELECT doc_id, node_id, any_value(anchor_key) AS anchor_key FROM {nd} GROUP BY ALL) p ON p.doc_id=n.doc_id AND p.node_id=e.s
   WHERE n.doc_id=d.doc_id)), '') || chr(10)||'---'||chr(10) || coalesce((SELECT string_agg(l, chr(10) ORDER BY encode(l)) FROM (
   SELECT concat(coalesce(a.anchor_key, e.source_node_id), '->', e.edge_type, '->', coalesce(b.anchor_key, e.target_node_id)) AS l FROM {ed} e
   LEFT JOIN (SELECT doc_id, node_id, any_value(anchor_key) AS anchor_key FROM {nd} GROUP BY ALL) a ON a.doc_id=e.doc_id AND a.node_id=e.source_node_id
   LEFT JOIN (SELECT doc_id, node_id, any_value(anchor_key) AS anchor_key FROM {nd} GROUP BY ALL) b ON b.doc_id=e.doc_id AND b.node_id=e.target_node_id
   WHERE e.doc_id=d.doc_id AND e.edge_type<>'CONTAINS')), '')) AS fingerprint FROM"""


view("evn", "", """SELECT *, coalesce(sum(turn) OVER (PARTITION BY doc_id ORDER BY created_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 - turn AS expected_version
FROM (SELECT event_id, (event_id*7919+user_id) % (SELECT count(*) FROM documents) AS doc_id, CAST(epoch_us(ts) AS DOUBLE)/1000000 AS created_at,
  event_id%3<>0 AS is_active, CASE WHEN event_id%4<>0 THEN 1 ELSE 0 END AS turn FROM events)""")
view("plc", "nd", """SELECT doc_id, seq, a, row_number() OVER w - 1 AS k, lead(seq) OVER w AS nx, count(*) OVER (PARTITION BY doc_id) AS n, min(seq) OVER (PARTITION BY doc_id) AS fs
FROM (SELECT doc_id, seq, any_value(anchor_key) AS a FROM nd GROUP BY ALL) WINDOW w AS (PARTITION BY doc_id ORDER BY seq)""")


def overrides(move: str) -> str:
    return r"""
SELECT doc_id, override_id, target_anchor_key, action_type, is_active, created_at, expected_version, event_id, seq,
 CASE action_type
  WHEN 'CHANGE_CATEGORY' THEN '{"new_category":"' || CASE WHEN event_id%29=0 THEN 'BOGUS' WHEN event_id%41=0 THEN 'THEOREM' WHEN seq%2=0 THEN 'CONCEPT' ELSE 'EXAMPLE' END || '"}'
  WHEN 'RENAME_TITLE' THEN '{"new_title":"' || CASE WHEN event_id%31=0 THEN ' ' ELSE ' Title '||(event_id%3) END || '"}'
  WHEN 'UPDATE_EDGE' THEN '{"source_node_id":"an_b'||doc_id||'_'||seq||'","target_node_id":"an_b'||doc_id||'_'||fs||'","edge_type":"'|| CASE WHEN seq%2=0 THEN 'EXPLAINS' ELSE 'PREREQUISITE_OF' END ||'","confidence":0.5}'
  WHEN 'CREATE_NODE' THEN '{"category":"'|| CASE WHEN event_id%3=1 THEN 'CONCEPT' ELSE 'NOPE' END ||'","title":"Made '||event_id||'","anchor_key":"made_'||(event_id%2)||'"}'
  WHEN 'REPARENT_NODE' THEN '{"new_parent_id":"an_b'||doc_id||'_'||CASE event_id%5 WHEN 0 THEN fs WHEN 1 THEN -1 ELSE coalesce(nx, fs) END||'"}'
  ELSE CASE event_id%43 WHEN 0 THEN '{"note":{"a":1,"b":[2]}}' WHEN 1 THEN '{"note":{"b":[2],"a":1.0}}' WHEN 2 THEN '{"note":{"a":"1","b":[2]}}' ELSE '{}' END END AS payload
FROM (SELECT e.* EXCLUDE (fs), coalesce(e.fs, 0) AS fs, concat('ov', lpad(CAST(event_id AS VARCHAR), 12, '0')) AS override_id, coalesce(p.a, concat('made_', event_id%2)) AS target_anchor_key,
  coalesce(p.seq, 0) AS seq, p.nx,
  CASE event_id%7 WHEN 0 THEN 'CHANGE_CATEGORY' WHEN 1 THEN 'RENAME_TITLE' WHEN 2 THEN 'ACCEPT_NODE' WHEN 3 THEN 'DELETE_NODE' WHEN 4 THEN 'UPDATE_EDGE'
   WHEN 5 THEN CASE WHEN event_id%35=5 THEN 'CREATE_NODE' ELSE 'ACCEPT_NODE' END ELSE MOVE END AS action_type
 FROM (SELECT evn.*, q.n, q.fs FROM evn LEFT JOIN (SELECT DISTINCT doc_id, n, fs FROM plc) q USING (doc_id)) e
 LEFT JOIN plc p ON p.doc_id=e.doc_id AND e.event_id%8<>7 AND p.k=e.event_id%e.n)""".replace("MOVE", move)


view("ov", "evn plc", overrides("'ACCEPT_NODE'"))
view("ovm", "evn plc", overrides("'REPARENT_NODE'"))
view("ovd", "ov", "SELECT DISTINCT doc_id FROM ov")
view("ndo", "nd ovd", "SELECT nd.* FROM nd SEMI JOIN ovd USING (doc_id)")
view("edo", "ed ovd", "SELECT ed.* FROM ed SEMI JOIN ovd USING (doc_id)")
view("act", "ov", "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY created_at, override_id) AS o FROM ov WHERE is_active")
CATS = "('UNIT','CHAPTER','SECTION','TOPIC','CONCEPT','DEFINITION','THEOREM','PROOF','FORMULA','ALGORITHM','EXAMPLE','EXERCISE','LEARNING_OBJECTIVE','SUMMARY','REVIEW_QUESTION','REFERENCE','DIAGRAM','APPENDIX')"
view("crt", "act", f"SELECT doc_id, o, 'an_manual_'||override_id AS node_id, payload->>'$.category' AS category, payload->>'$.title' AS title, payload->>'$.anchor_key' AS anchor_key FROM act WHERE action_type='CREATE_NODE' AND (payload->>'$.category') IN {CATS}")
view("allnd", "ndo crt", "SELECT doc_id, 0 AS o, node_id, anchor_key FROM ndo UNION ALL SELECT doc_id, o, node_id, anchor_key FROM crt")
# Payloads as values: every leaf with its path and type, numbers as numbers.
view("canon", "ov ovm", """
SELECT payload, coalesce((SELECT string_agg(fullkey || ' ' || CASE WHEN type IN ('OBJECT','ARRAY') THEN type WHEN type='VARCHAR' THEN 'text ' || atom ELSE 'number ' || CAST(atom AS DOUBLE) END, chr(10) ORDER BY fullkey)
  FROM json_tree(p.payload)), '') AS c FROM (SELECT payload FROM ov UNION SELECT payload FROM ovm) p""")
GRP = "SELECT doc_id, target_anchor_key, action_type, count(*) AS n FROM {} JOIN canon USING (payload) WHERE action_type<>'CREATE_NODE' GROUP BY ALL HAVING count(DISTINCT c)>1"
view("grp", "act canon", GRP.format("act"))
view("actm", "ovm", "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY created_at, override_id) AS o FROM ovm WHERE is_active")
view("grpm", "actm canon", GRP.format("actm"))
ST = f"""
SELECT *, CASE WHEN outcome='ERROR' THEN err END AS error FROM (
SELECT *, CASE WHEN conf THEN 'CONFLICTED' WHEN action_type='CREATE_NODE' THEN CASE WHEN err IS NULL THEN 'APPLIED' ELSE 'ERROR' END
  WHEN hits=0 THEN 'STALE' WHEN hits>1 THEN 'CONFLICTED' WHEN err IS NOT NULL THEN 'ERROR' ELSE 'APPLIED' END AS outcome
FROM (SELECT *, CASE action_type
   WHEN 'CREATE_NODE' THEN CASE WHEN (payload->>'$.category') NOT IN {CATS} THEN 'CATEGORY' END
   WHEN 'CHANGE_CATEGORY' THEN CASE WHEN (payload->>'$.new_category') NOT IN {CATS} THEN 'CATEGORY' END
   WHEN 'RENAME_TITLE' THEN CASE WHEN trim(payload->>'$.new_title')='' THEN 'TITLE' END
   WHEN 'UPDATE_EDGE' THEN CASE WHEN NOT EXISTS (SELECT 1 FROM allnd k WHERE k.doc_id=x.doc_id AND k.o<x.o AND k.node_id=(x.payload->>'$.source_node_id'))
       OR NOT EXISTS (SELECT 1 FROM allnd k WHERE k.doc_id=x.doc_id AND k.o<x.o AND k.node_id=(x.payload->>'$.target_node_id')) THEN 'ENDPOINT_NOT_FOUND'
       WHEN (payload->>'$.source_node_id')=(payload->>'$.target_node_id') THEN 'SELF_EDGE' END
   WHEN 'REPARENT_NODE' THEN CASE WHEN NOT EXISTS (SELECT 1 FROM allnd k WHERE k.doc_id=x.doc_id AND k.o<x.o AND k.node_id=(x.payload->>'$.new_parent_id')) THEN 'PARENT_NOT_FOUND'
       WHEN (payload->>'$.new_parent_id')=node_id THEN 'SELF_PARENT' END END AS err
 FROM (SELECT a.*, g.n IS NOT NULL AS conf, (SELECT count(*) FROM allnd k WHERE k.doc_id=a.doc_id AND k.anchor_key=a.target_anchor_key AND k.o<a.o) AS hits,
   CASE WHEN a.action_type='CREATE_NODE' THEN 'an_manual_'||a.override_id
        WHEN (SELECT count(*) FROM allnd k WHERE k.doc_id=a.doc_id AND k.anchor_key=a.target_anchor_key AND k.o<a.o)=1
        THEN (SELECT min(node_id) FROM allnd k WHERE k.doc_id=a.doc_id AND k.anchor_key=a.target_anchor_key AND k.o<a.o) END AS node_id
   FROM act a LEFT JOIN grp g USING (doc_id, target_anchor_key, action_type)) x))"""
view("st", "act grp allnd", ST)
view("bp", "edo", "SELECT doc_id, target_node_id AS node_id, first(source_node_id ORDER BY ann_ord, seq) AS p FROM edo WHERE edge_type='CONTAINS' GROUP BY 1, 2")


def machine(moves: str, key: str) -> str:
    """Serial replay of moves, one step of one walk up a time: the links changed so far are carried."""
    return f"""
SELECT {key}, 1::BIGINT AS k, p AS cur, MAP([]::VARCHAR[], []::VARCHAR[]) AS links, 0::BIGINT AS done, false AS bad FROM {moves} WHERE k=1
UNION ALL SELECT {', '.join('w.' + x for x in key.split(', '))}, CASE WHEN w.fin THEN w.k+1 ELSE w.k END, CASE WHEN w.fin THEN nx.p ELSE coalesce(element_at(links, cur)[1], bp.p) END,
  CASE WHEN w.cur IS NULL THEN map_concat(links, MAP([w.node_id], [w.p])) ELSE links END, CASE WHEN w.fin THEN w.k ELSE 0 END, coalesce(w.cur=w.node_id, false)
FROM (SELECT s.*, m.node_id, m.p, s.cur IS NULL OR s.cur=m.node_id AS fin FROM SELF s JOIN {moves} m USING ({key}, k)) w
LEFT JOIN {moves} nx ON {' AND '.join(f'nx.{x}=w.{x}' for x in key.split(', '))} AND nx.k=w.k+1 LEFT JOIN bp ON bp.doc_id=w.doc_id AND bp.node_id=w.cur"""


view("stm0", "actm grpm allnd", ST.replace("FROM act a LEFT JOIN grp g", "FROM actm a LEFT JOIN grpm g"))
view("mv", "stm0", "SELECT doc_id, o, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS k, node_id, payload->>'$.new_parent_id' AS p FROM stm0 WHERE action_type='REPARENT_NODE' AND outcome='APPLIED'")
view("mvw", "mv bp", machine("mv", "doc_id").replace("SELF", "mvw"), recursive=True)
view("stm", "stm0 mv mvw", """SELECT s.* REPLACE (CASE WHEN bad THEN 'ERROR' ELSE outcome END AS outcome, CASE WHEN bad THEN 'CYCLE' ELSE error END AS error)
FROM stm0 s LEFT JOIN (SELECT mv.doc_id, mv.o, w.bad FROM mv JOIN mvw w ON w.doc_id=mv.doc_id AND w.done=mv.k) USING (doc_id, o)""")
RN0 = """
SELECT b.doc_id, b.node_id, coalesce(c.cat, b.category) AS category, coalesce(c.tit, b.title) AS title, b.anchor_key, coalesce(c.sta, b.review_state) AS review_state,
  CASE WHEN c.cat IS NOT NULL THEN b.category END AS original_category, CASE WHEN c.tit IS NOT NULL THEN b.title END AS original_title,
  coalesce(c.n, 0) + b.made AS override_count, b.ann_ord, b.seq, b.target_block_id, b.provenance
FROM (SELECT doc_id, node_id, category, title, anchor_key, review_state, 0 AS made, ann_ord, seq, target_block_id, provenance FROM ndo
      UNION ALL SELECT doc_id, node_id, category, title, anchor_key, 'MODIFIED', 1, 9, NULL, NULL, 'HUMAN_OVERRIDE' FROM crt) b
LEFT JOIN (SELECT doc_id, node_id, count(*) AS n, arg_max(payload->>'$.new_category', o) FILTER (action_type='CHANGE_CATEGORY') AS cat,
   arg_max(trim(payload->>'$.new_title'), o) FILTER (action_type='RENAME_TITLE') AS tit,
   arg_max(CASE action_type WHEN 'ACCEPT_NODE' THEN 'ACCEPTED' WHEN 'DELETE_NODE' THEN 'REJECTED' ELSE 'MODIFIED' END, o) AS sta
  FROM st WHERE outcome='APPLIED' AND action_type NOT IN ('CREATE_NODE','UPDATE_EDGE') GROUP BY ALL) c USING (doc_id, node_id)"""
view("rn0", "ndo crt st", RN0)
view("rnm0", "ndo crt stm", RN0.replace("FROM st WHERE", "FROM stm WHERE"))
view("rnm", "rnm0", "SELECT * FROM rnm0 WHERE review_state<>'REJECTED'")
view("rem", "edo stm rnm0", """
WITH m AS (SELECT doc_id, node_id, arg_max(payload->>'$.new_parent_id', o) AS p FROM stm WHERE action_type='REPARENT_NODE' AND outcome='APPLIED' GROUP BY 1, 2)
SELECT * FROM (SELECT e.doc_id, CASE WHEN edge_type='CONTAINS' AND row_number() OVER (PARTITION BY e.doc_id, target_node_id, edge_type ORDER BY ann_ord, seq)=1 THEN coalesce(m.p, source_node_id) ELSE source_node_id END AS source_node_id,
   target_node_id, edge_type, confidence, ann_ord, seq FROM edo e LEFT JOIN m ON m.doc_id=e.doc_id AND m.node_id=e.target_node_id
 UNION ALL SELECT doc_id, p, node_id, 'CONTAINS', 1, 8, NULL FROM m WHERE NOT EXISTS (SELECT 1 FROM edo e WHERE e.doc_id=m.doc_id AND e.target_node_id=m.node_id AND e.edge_type='CONTAINS')
 UNION ALL SELECT doc_id, payload->>'$.source_node_id', payload->>'$.target_node_id', payload->>'$.edge_type', arg_max(CAST(payload->>'$.confidence' AS DOUBLE), o), 9, NULL
 FROM stm WHERE outcome='APPLIED' AND action_type='UPDATE_EDGE' GROUP BY 1,2,3,4) e
WHERE NOT EXISTS (SELECT 1 FROM rnm0 r WHERE r.doc_id=e.doc_id AND r.review_state='REJECTED' AND r.node_id IN (e.source_node_id, e.target_node_id))""")
view("rn", "rn0", "SELECT * FROM rn0 WHERE review_state<>'REJECTED'")
view("re", "edo st rn0", """
SELECT * FROM (SELECT doc_id, source_node_id, target_node_id, edge_type, confidence, ann_ord, seq FROM edo
 UNION ALL SELECT doc_id, payload->>'$.source_node_id', payload->>'$.target_node_id', payload->>'$.edge_type', arg_max(CAST(payload->>'$.confidence' AS DOUBLE), o), 9, NULL
 FROM st WHERE outcome='APPLIED' AND action_type='UPDATE_EDGE' GROUP BY 1,2,3,4) e
WHERE NOT EXISTS (SELECT 1 FROM rn0 r WHERE r.doc_id=e.doc_id AND r.review_state='REJECTED' AND r.node_id IN (e.source_node_id, e.target_node_id))""")
view("osum", "ovd st rn re", f"""
SELECT c.*, f.fingerprint AS resolved_graph_fingerprint, false AS has_cycle,
 CASE WHEN error_count>0 THEN 'INVALID_GRAPH' WHEN conflicted_count>0 THEN 'CONFLICTS' WHEN stale_count>0 THEN 'STALE_OVERRIDES' ELSE 'CLEAN' END AS reconciliation_status
FROM (SELECT d.doc_id, count(*) FILTER (outcome='APPLIED') AS applied_count, count(*) FILTER (outcome='STALE') AS stale_count,
  count(*) FILTER (outcome='CONFLICTED') AS conflicted_count, count(*) FILTER (outcome='ERROR') AS error_count FROM ovd d LEFT JOIN st USING (doc_id) GROUP BY 1) c
JOIN ({fp('rn', 're')} ovd d) f USING (doc_id)""")
view("rdy", "ovd rn re osum", """
SELECT doc_id, unnest(['UNREVIEWED_NODES','STALE_OVERRIDES','OVERRIDE_CONFLICT','GRAPH_CYCLE','INVALID_GRAPH','INVALID_PIPELINE_RUN','ORPHAN_ACADEMIC_NODE','ACADEMIC_WARNING']) AS code,
 unnest([u=0, stale_count=0, conflicted_count=0, true, error_count=0, doc_id%10<>9, o=0, stale_count+conflicted_count=0]) AS passed,
 unnest(['BLOCKER','BLOCKER','BLOCKER','BLOCKER','BLOCKER','BLOCKER','WARNING','WARNING']) AS severity
FROM (SELECT s.*, (SELECT count(*) FROM rn r WHERE r.doc_id=s.doc_id AND review_state='UNREVIEWED') AS u,
  (SELECT count(*) FROM rn r WHERE r.doc_id=s.doc_id AND category<>'UNIT' AND NOT EXISTS (SELECT 1 FROM re e WHERE e.doc_id=r.doc_id AND e.edge_type='CONTAINS' AND e.target_node_id=r.node_id)) AS o
 FROM osum s)""")
view("rpn", "ov", "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY created_at, override_id) AS o FROM ov")
view("rpl", "rpn", """
SELECT doc_id, 0::BIGINT AS o, 0::BIGINT AS rev, false AS accepted FROM (SELECT DISTINCT doc_id FROM rpn)
UNION ALL SELECT n.doc_id, n.o, CASE WHEN n.expected_version=r.rev THEN r.rev+1 ELSE r.rev END, n.expected_version=r.rev
FROM rpl r JOIN rpn n ON n.doc_id=r.doc_id AND n.o=r.o+1""", recursive=True)
view("rp", "rpn rpl", "SELECT n.*, r.accepted, CASE WHEN r.accepted THEN r.rev END AS new_version FROM rpn n JOIN rpl r USING (doc_id, o)")
view("ax_log", "rp ovm", "SELECT m.*, r.o FROM ovm m JOIN rp r USING (doc_id, override_id) WHERE r.accepted")
# Every accepted action replays what was accepted before it, as the serial rule does: groups of one kind on one
# anchor that disagree by then are out, the others hit the only node with their anchor, moves are tried in order.
view("ax_all", "ndo ax_log", f"""SELECT doc_id, 0 AS o, node_id, anchor_key, category, title, review_state, ann_ord, seq FROM ndo
UNION ALL SELECT doc_id, o, 'an_manual_'||override_id, payload->>'$.anchor_key', payload->>'$.category', payload->>'$.title', 'MODIFIED', 9, NULL
FROM ax_log WHERE action_type='CREATE_NODE' AND (payload->>'$.category') IN {CATS}""")
view("ax_hit", "ax_log ax_all canon", f"""
SELECT * FROM (SELECT p.*, c.c, (SELECT CASE WHEN count(*)=1 THEN min(node_id) END FROM ax_all k WHERE k.doc_id=p.doc_id AND k.anchor_key=p.target_anchor_key AND k.o<p.o) AS node_id,
  CASE action_type WHEN 'CHANGE_CATEGORY' THEN (p.payload->>'$.new_category') IN {CATS} WHEN 'RENAME_TITLE' THEN trim(p.payload->>'$.new_title')<>''
    WHEN 'REPARENT_NODE' THEN EXISTS (SELECT 1 FROM ax_all k WHERE k.doc_id=p.doc_id AND k.o<p.o AND k.node_id=(p.payload->>'$.new_parent_id')) ELSE true END AS good
  FROM ax_log p JOIN canon c USING (payload) WHERE action_type NOT IN ('CREATE_NODE','UPDATE_EDGE'))""")
view("ax_in", "ax_log ax_hit", """
SELECT a.doc_id, a.o AS a, p.o, p.action_type, p.node_id, p.payload FROM ax_log a JOIN ax_hit p ON p.doc_id=a.doc_id AND p.o<a.o
 AND NOT EXISTS (SELECT 1 FROM ax_hit q WHERE q.doc_id=p.doc_id AND q.target_anchor_key=p.target_anchor_key AND q.action_type=p.action_type AND q.o<a.o AND q.c<>p.c)
WHERE p.node_id IS NOT NULL AND p.good AND NOT (p.action_type='REPARENT_NODE' AND p.node_id=(p.payload->>'$.new_parent_id'))""")
view("ax_mv", "ax_in", "SELECT doc_id, a, o, row_number() OVER (PARTITION BY doc_id, a ORDER BY o) AS k, node_id, payload->>'$.new_parent_id' AS p FROM ax_in WHERE action_type='REPARENT_NODE'")
view("ax_mvw", "ax_mv bp", machine("ax_mv", "doc_id, a").replace("SELF", "ax_mvw"), recursive=True)
view("ax_node", "ax_in ax_mv ax_mvw", """
SELECT doc_id, a, node_id, arg_max(payload->>'$.new_category', o) FILTER (action_type='CHANGE_CATEGORY') AS category, arg_max(trim(payload->>'$.new_title'), o) FILTER (action_type='RENAME_TITLE') AS title,
 arg_max(payload->>'$.new_parent_id', o) FILTER (action_type='REPARENT_NODE') AS p, arg_max(CASE action_type WHEN 'ACCEPT_NODE' THEN 'ACCEPTED' WHEN 'DELETE_NODE' THEN 'REJECTED' ELSE 'MODIFIED' END, o) AS review_state
FROM ax_in i WHERE NOT EXISTS (SELECT 1 FROM ax_mv m JOIN ax_mvw w ON w.doc_id=m.doc_id AND w.a=m.a AND w.done=m.k WHERE w.bad AND m.doc_id=i.doc_id AND m.a=i.a AND m.o=i.o) GROUP BY 1, 2, 3""")
view("audit", "ax_log ax_all ax_node bp", """
SELECT r.doc_id, r.o, override_id, action_type, CASE WHEN action_type='CREATE_NODE' THEN 'an_manual_'||override_id ELSE t.node_id END AS node_id,
  CASE action_type WHEN 'CHANGE_CATEGORY' THEN CAST(json_object('category', t.category) AS VARCHAR) WHEN 'RENAME_TITLE' THEN CAST(json_object('title', t.title) AS VARCHAR)
   WHEN 'REPARENT_NODE' THEN CAST(json_object('parent_id', CASE WHEN NOT coalesce((SELECT review_state='REJECTED' FROM ax_node x WHERE x.doc_id=r.doc_id AND x.a=r.o AND x.node_id=t.p), false) THEN t.p END) AS VARCHAR)
   WHEN 'ACCEPT_NODE' THEN CAST(json_object('review_state', t.review_state) AS VARCHAR) WHEN 'DELETE_NODE' THEN CAST(json_object('review_state', t.review_state) AS VARCHAR) ELSE '{}' END AS previous_state,
  CASE action_type WHEN 'CHANGE_CATEGORY' THEN CAST(json_object('category', payload->>'$.new_category') AS VARCHAR) WHEN 'RENAME_TITLE' THEN CAST(json_object('title', payload->>'$.new_title') AS VARCHAR)
   WHEN 'REPARENT_NODE' THEN CAST(json_object('parent_id', payload->>'$.new_parent_id') AS VARCHAR)
   WHEN 'ACCEPT_NODE' THEN '{"review_state":"ACCEPTED"}' WHEN 'DELETE_NODE' THEN '{"review_state":"REJECTED"}'
   WHEN 'CREATE_NODE' THEN CAST(json_object('category', payload->>'$.category', 'title', payload->>'$.title', 'target_block_id', NULL) AS VARCHAR) ELSE payload END AS new_state
FROM ax_log r LEFT JOIN (
 SELECT a.doc_id, a.o AS a, first(struct_pack(node_id:=n.node_id, category:=coalesce(x.category, n.category), title:=coalesce(x.title, n.title), review_state:=coalesce(x.review_state, n.review_state), p:=coalesce(x.p, bp.p))
    ORDER BY n.o, n.ann_ord, n.seq, n.node_id) AS t
 FROM ax_log a JOIN ax_all n ON n.doc_id=a.doc_id AND n.anchor_key=a.target_anchor_key AND n.o<a.o
 LEFT JOIN ax_node x ON x.doc_id=a.doc_id AND x.a=a.o AND x.node_id=n.node_id LEFT JOIN bp ON bp.doc_id=n.doc_id AND bp.node_id=n.node_id
 WHERE x.review_state IS DISTINCT FROM 'REJECTED' GROUP BY 1, 2) q ON q.doc_id=r.doc_id AND q.a=r.o
WHERE action_type='CREATE_NODE' OR t IS NOT NULL""")
view("snp", "osum", "SELECT doc_id, unnest([1,2]) AS approval_version, resolved_graph_fingerprint, concat('s', doc_id, '_', unnest([1,2])) AS snapshot_id FROM osum WHERE doc_id%3=0")
view("ent_k", "rn", """
SELECT concat('v', doc_id) AS version_id, * FROM (SELECT *, CASE WHEN coalesce(anchor_key,'')<>'' THEN anchor_key WHEN review_state='MODIFIED' OR provenance LIKE '%HUMAN_OVERRIDE%' THEN 'anc_manual_'||node_id END AS stable_id
FROM rn WHERE category IN ('CHAPTER','SECTION','TOPIC','CONCEPT','DEFINITION','THEOREM','PROOF','FORMULA','ALGORITHM','EXAMPLE','EXERCISE','SUMMARY')) WHERE stable_id IS NOT NULL""")
R = lambda *c: ", ".join(f"round({x},9) AS {x}" for x in c)
CNT = "count(*) FILTER (edge_type='{}') AS {}"
SQL = {
    "academic_features": build("ax", """SELECT a.doc_id, a.block_id, a.depth AS heading_depth, a.font_size/10 AS typography_scale,
       CASE WHEN a.x0>50 THEN CAST(floor((a.x0-50)/15) AS INTEGER) ELSE 0 END AS indentation_level, s.text AS enclosing_section_title, a.has_math,
       array_to_string(list_filter([""" + ", ".join(f"CASE WHEN a.{k} THEN '{k}' END" for k in I) + """], lambda x: x IS NOT NULL), ',') AS indicators
       FROM ax a LEFT JOIN ax s ON s.doc_id=a.doc_id AND s.block_id=a.section_id"""),
    "academic_annotations": build("an", "SELECT doc_id, block_id, academic_type, ann_confidence, prov AS provenance FROM an"),
    "anchor_keys": build("anc", "SELECT doc_id, block_id, academic_type, section_path, ordinal, anchor_key FROM anc"),
    "anchor_collisions": build("anc", "SELECT doc_id, section_path AS anchor_key, count(*) AS n, min(block_id) AS first_block, max(block_id) AS last_block FROM anc GROUP BY ALL HAVING count(*)>1"),
    "academic_nodes": build("nd", "SELECT * EXCLUDE (ann_ord, seq) FROM nd"),
    "academic_edges": build("ed", "SELECT * EXCLUDE (ann_ord, seq) FROM ed"),
    "academic_quality": build("aq", f"SELECT * EXCLUDE (coverage, orphan_ratio, density, academic_score), {R('coverage', 'orphan_ratio', 'density', 'academic_score')} FROM aq"),
    "academic_warnings": build("aq", """SELECT doc_id, 'warning' AS kind, 'ACADEMIC_COVERAGE_LOW' AS code, 'WARNING' AS severity FROM aq WHERE coverage<0.5
       UNION ALL SELECT doc_id, 'warning', 'ORPHAN_ACADEMIC_NODES', 'INFO' FROM aq WHERE orphan_count>0
       UNION ALL SELECT doc_id, 'recommendation', 'MANUAL_CURRICULUM_REVIEW', 'WARNING' FROM aq WHERE orphan_ratio>0.3"""),
    "document_report": build("hx hedge anc hval qall aq", f"""SELECT doc_id, total_nodes, total_sections, root_count, total_edges, parent_child, sibling, reading_flow, caption_association,
       academic_annotations, max_depth, orphan_count, total_nodes*4+academic_annotations+4 AS annotation_count,
       round((total_nodes*1.9::DOUBLE + sem + 0.95::DOUBLE*total_nodes + ann + 0.98 + cs + oq + acs)/(total_nodes*4+academic_annotations+4), 9) AS average_confidence
       FROM (SELECT b.*, coalesce(total_edges,0) AS total_edges, coalesce(parent_child,0) AS parent_child, coalesce(sibling,0) AS sibling, coalesce(reading_flow,0) AS reading_flow,
         coalesce(caption_association,0) AS caption_association, coalesce(a.n,0) AS academic_annotations, coalesce(a.c,0) AS ann, v.max_depth, v.orphan_count,
         v.consistency_score AS cs, q.overall_quality AS oq, coalesce(x.academic_score,1) AS acs
       FROM (SELECT doc_id, count(*) AS total_nodes, sum(semantic_conf) AS sem, count(*) FILTER (block_type='HEADING') AS total_sections, count(*) FILTER (pseq IS NULL) AS root_count FROM hx GROUP BY 1) b
       LEFT JOIN (SELECT doc_id, count(*) AS total_edges, {', '.join(CNT.format(t, t.lower()) for t in ('PARENT_CHILD', 'SIBLING', 'READING_FLOW', 'CAPTION_ASSOCIATION'))} FROM hedge GROUP BY 1) e USING (doc_id)
       LEFT JOIN (SELECT doc_id, count(*) AS n, sum(ann_confidence) AS c FROM anc GROUP BY 1) a USING (doc_id)
       JOIN hval v USING (doc_id) JOIN qall q USING (doc_id) LEFT JOIN aq x USING (doc_id))"""),
    "graph_fingerprint": build("nd ed", f"{fp('nd', 'ed')} (SELECT DISTINCT doc_id FROM nd) d"),
    "override_conflicts": build("grp", "SELECT * FROM grp"),
    "override_status": build("st", "SELECT doc_id, override_id, outcome, error, node_id FROM st"),
    "overlay_nodes": build("rn", "SELECT doc_id, node_id, category, title, anchor_key, review_state, original_category, original_title, override_count FROM rn"),
    "overlay_edges": build("re", "SELECT doc_id, source_node_id, target_node_id, edge_type, confidence FROM re"),
    "overlay_status": build("osum", "SELECT * FROM osum"),
    "action_replay": build("rp", "SELECT doc_id, override_id, accepted, new_version FROM rp"),
    "audit_page": build("audit", """SELECT doc_id, position, action_type, node_id, previous_state, new_state FROM (
       SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS position FROM audit) WHERE position BETWEEN 2 AND 6"""),
    "audit_rows": build("audit", "SELECT doc_id, override_id, action_type, node_id, previous_state, new_state FROM audit"),
    "overlay_reparent": build("stm", "SELECT doc_id, override_id, outcome, error, node_id, payload->>'$.new_parent_id' AS new_parent FROM stm WHERE action_type='REPARENT_NODE'"),
    "overlay_reparent_edges": build("rem", "SELECT doc_id, source_node_id, target_node_id, edge_type, confidence FROM rem"),
    "node_original_parents": build("stm bp", """SELECT m.doc_id, m.node_id, coalesce(bp.p, CASE WHEN moves>1 THEN first_to END) AS original_parent_id, moves
       FROM (SELECT doc_id, node_id, count(*) AS moves, arg_min(payload->>'$.new_parent_id', o) AS first_to FROM stm WHERE action_type='REPARENT_NODE' AND outcome='APPLIED' GROUP BY 1, 2) m LEFT JOIN bp USING (doc_id, node_id)"""),
    "node_overrides": build("stm rnm", """SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id, node_id ORDER BY o) AS position, override_id FROM stm
       WHERE outcome='APPLIED' AND action_type<>'UPDATE_EDGE' AND EXISTS (SELECT 1 FROM rnm r WHERE r.doc_id=stm.doc_id AND r.node_id=stm.node_id)"""),
    "node_audit": build("audit ndo rnm", """SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id, node_id ORDER BY o) AS position, override_id, previous_state FROM audit a
       WHERE EXISTS (SELECT 1 FROM ndo n WHERE n.doc_id=a.doc_id AND n.node_id=a.node_id) OR EXISTS (SELECT 1 FROM rnm n WHERE n.doc_id=a.doc_id AND n.node_id=a.node_id)"""),
    "reconciliation": build("st", """SELECT doc_id, override_id, target_anchor_key AS anchor_key, action_type, payload, outcome,
       CASE WHEN outcome='STALE' THEN 'Target anchor key not found in the newly generated base graph (likely content deleted or renamed).' ELSE 'Ambiguous matching or logical collision with other active user actions.' END AS reason
       FROM st WHERE outcome IN ('STALE','CONFLICTED')"""),
    "readiness": build("rdy", "SELECT * FROM rdy"),
    "review_summary": build("osum rn ndo rdy", """SELECT s.doc_id, reconciliation_status, stale_count, conflicted_count,
       (SELECT count(*) FROM rn r WHERE r.doc_id=s.doc_id) AS total_nodes, (SELECT count(*) FROM rn r WHERE r.doc_id=s.doc_id AND review_state='UNREVIEWED') AS unreviewed_count,
       (SELECT count(*) FROM rn r WHERE r.doc_id=s.doc_id AND review_state='ACCEPTED') AS accepted_count, (SELECT count(*) FROM rn r WHERE r.doc_id=s.doc_id AND review_state='MODIFIED') AS modified_count,
       (SELECT count(*) FROM ndo n WHERE n.doc_id=s.doc_id AND NOT EXISTS (SELECT 1 FROM rn r WHERE r.doc_id=n.doc_id AND r.node_id=n.node_id)) AS rejected_count,
       (SELECT bool_and(passed OR severity<>'BLOCKER') FROM rdy y WHERE y.doc_id=s.doc_id) AS approval_readiness FROM osum s"""),
    "resolved_graph_page": build("rn re", """SELECT doc_id, position, node_id, category FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ann_ord, seq NULLS FIRST, node_id) AS position FROM rn r
       WHERE EXISTS (SELECT 1 FROM re e WHERE e.doc_id=r.doc_id AND e.edge_type='CONTAINS' AND e.target_node_id=r.node_id)) WHERE position BETWEEN 2 AND 4"""),
    "resolved_graph_page_edges": build("rn re", """WITH p AS (SELECT doc_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ann_ord, seq NULLS FIRST, node_id) AS position FROM rn r
       WHERE EXISTS (SELECT 1 FROM re e WHERE e.doc_id=r.doc_id AND e.edge_type='CONTAINS' AND e.target_node_id=r.node_id)) WHERE position BETWEEN 2 AND 4)
       SELECT doc_id, source_node_id, target_node_id, edge_type FROM re e WHERE EXISTS (SELECT 1 FROM p WHERE p.doc_id=e.doc_id AND p.node_id IN (e.source_node_id, e.target_node_id))""").replace("\nWITH p AS", ",\np AS", 1),
    "resolved_graph_filtered": build("rn", """SELECT doc_id, position, node_id, total_count FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ann_ord, seq NULLS FIRST, node_id) AS position,
       count(*) OVER (PARTITION BY doc_id) AS total_count FROM rn WHERE review_state='UNREVIEWED') WHERE position<=2"""),
    "snapshot_nodes": build("osum rn", "SELECT sha256(s.doc_id||':'||CASE WHEN s.doc_id%3=0 THEN 3 ELSE 1 END) AS snapshot_id, CASE WHEN s.doc_id%3=0 THEN 3 ELSE 1 END AS approval_version, node_id, category, title FROM osum s JOIN rn USING (doc_id)"),
    "snapshot_edges": build("osum re", "SELECT sha256(s.doc_id||':'||CASE WHEN s.doc_id%3=0 THEN 3 ELSE 1 END) AS snapshot_id, CASE WHEN s.doc_id%3=0 THEN 3 ELSE 1 END AS approval_version, source_node_id, target_node_id, edge_type FROM osum s JOIN re USING (doc_id)"),
    "snapshot_by_version": build("snp", "SELECT doc_id, approval_version, resolved_graph_fingerprint, concat('s', doc_id, '_1') AS snapshot_id FROM snp WHERE approval_version=1"),
    "finalized_rows": build("osum", """SELECT concat('vs', doc_id, '_', v) AS version_id, concat('s', doc_id, '_', v) AS snapshot_id, '1.0.0' AS schema_version, 'FINALIZED' AS status
       FROM (SELECT doc_id, unnest([1,2]) AS v FROM osum WHERE doc_id%3=0 AND doc_id%2=0) WHERE NOT (doc_id%12=0 AND v=1)"""),
    "containment_cycles": """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS doc_id, l_partkey%97 AS s, l_partkey%97 + CASE WHEN l_orderkey%19=0 THEN -(l_orderkey%7) ELSE 1 + l_orderkey%13 END AS t FROM lineitem),
       r(doc_id, s, t) AS (SELECT * FROM e UNION SELECT r.doc_id, r.s, e.t FROM r JOIN e ON e.doc_id=r.doc_id AND e.s=r.t)
       SELECT doc_id, count(*) AS n FROM e WHERE EXISTS (SELECT 1 FROM r WHERE r.doc_id=e.doc_id AND r.s=e.t AND r.t=e.s) OR s=t GROUP BY 1""",
    "node_detail": build("rnm rem ndo", """SELECT doc_id, node_id, category, title, review_state, (SELECT first(source_node_id ORDER BY e.ann_ord, e.seq) FROM rem e WHERE e.doc_id=r.doc_id AND e.edge_type='CONTAINS' AND e.target_node_id=r.node_id) AS parent_id,
       (SELECT count(*) FROM rem e WHERE e.doc_id=r.doc_id AND e.edge_type='CONTAINS' AND e.source_node_id=r.node_id) AS child_count,
       coalesce(original_category, category) AS original_category, coalesce(original_title, title) AS original_title, override_count, false AS deleted FROM rnm r
       UNION ALL SELECT doc_id, node_id, category, title, review_state, NULL, 0, category, title, 0, true FROM ndo n WHERE NOT EXISTS (SELECT 1 FROM rnm r WHERE r.doc_id=n.doc_id AND r.node_id=n.node_id)"""),
    "next_snapshots": build("osum ndo edo rp", f"""SELECT s.doc_id, CASE WHEN s.doc_id%3=0 THEN 3 ELSE 1 END AS approval_version,
       (SELECT count(*) FROM rp WHERE rp.doc_id=s.doc_id AND accepted) AS approved_revision, (SELECT count(*) FROM rp WHERE rp.doc_id=s.doc_id AND accepted)+1 AS next_revision,
       f.fingerprint AS base_graph_fingerprint, resolved_graph_fingerprint FROM osum s JOIN ({fp('ndo', 'edo')} (SELECT doc_id FROM osum) d) f USING (doc_id)"""),
    "latest_snapshots": build("snp", "SELECT doc_id, approval_version, resolved_graph_fingerprint, concat('s', doc_id, '_2') AS snapshot_id FROM snp WHERE approval_version=2"),
    "rerun_invalidation": build("osum rn", """SELECT doc_id, CASE WHEN doc_id%3=0 AND reconciliation_status='CLEAN' AND NOT EXISTS (SELECT 1 FROM rn r WHERE r.doc_id=s.doc_id AND review_state='UNREVIEWED')
       THEN 'APPROVED' ELSE 'NEEDS_REVIEW' END AS review_state FROM osum s"""),
    "new_base_graphs": "SELECT doc_id, n_chars AS extraction_timestamp FROM documents WHERE doc_id%7=0",
    "kn_candidates": build("osum", """SELECT doc_id, unnest([1,2]) AS approval_version, concat('s', doc_id, '_', unnest([1,2])) AS snapshot_id FROM osum WHERE doc_id%3=0 AND doc_id%2=0
       EXCEPT SELECT doc_id, 1, concat('s', doc_id, '_1') FROM osum WHERE doc_id%12=0"""),
    "kn_entities": build("ent_k", "SELECT version_id, node_id, category AS entity_type, title, title AS content, stable_id FROM ent_k"),
    "kn_evidence": build("ent_k hx hclo", """SELECT e.version_id, e.node_id AS source_node_id, e.stable_id AS source_anchor_key, b.page_number,
       CASE WHEN b.seq IS NOT NULL THEN (SELECT arg_max(h.text, h.depth) FROM hclo c JOIN hx h ON h.doc_id=c.doc_id AND h.seq=c.anc AND h.block_type='HEADING' WHERE c.doc_id=b.doc_id AND c.seq=b.seq) END AS section_title,
       b.text AS text_reference, CASE WHEN b.seq IS NULL THEN 'UNKNOWN' WHEN e.provenance='HUMAN_OVERRIDE' THEN 'HUMAN_OVERRIDE' ELSE 'EXPLICIT_CLASSIFIER' END AS provenance, b.x0, b.y0, b.x1, b.y1
       FROM ent_k e LEFT JOIN (SELECT * FROM hx WHERE seq%35<>0) b ON b.doc_id=e.doc_id AND b.block_id=e.target_block_id WHERE e.target_block_id IS NOT NULL"""),
    "kn_relationships": build("ent_k re", """SELECT concat('v', r.doc_id) AS version_id, edge_type AS relationship_type, confidence, edge_type='CONTAINS' AND doc_id%2=0 AS is_inferred, edge_type<>'CONTAINS' AS is_human_confirmed FROM re r
       WHERE EXISTS (SELECT 1 FROM ent_k e WHERE e.doc_id=r.doc_id AND e.node_id=r.source_node_id) AND EXISTS (SELECT 1 FROM ent_k e WHERE e.doc_id=r.doc_id AND e.node_id=r.target_node_id)
        AND edge_type IN ('CONTAINS','PREREQUISITE_OF','EXPLAINS','PROVES','ILLUSTRATES') AND source_node_id<>target_node_id"""),
}
