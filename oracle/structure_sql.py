"""Oracle SQL for the hierarchy, the reading graph and document quality."""

from . import layout_sql  # noqa: F401  (registers the classification views)
from .cte import build, view
from .text_sql import WS

view("cls", "rcls", "SELECT * EXCLUDE (block_type, prev_block_id, next_block_id), type7 AS block_type FROM rcls")
view("hb", "cls", """
SELECT *, coalesce(max(CASE WHEN block_type='HEADING' THEN seq END) OVER (PARTITION BY doc_id ORDER BY seq), -1) AS sec,
  CASE WHEN block_type='CAPTION' THEN
    CASE WHEN lag(block_type) OVER w IN ('TABLE','EQUATION','CODE') THEN lag(seq) OVER w
         WHEN lead(block_type) OVER w IN ('TABLE','EQUATION','CODE') THEN lead(seq) OVER w END END AS target,
  lag(block_id) OVER w AS previous_block_id
FROM cls WINDOW w AS (PARTITION BY doc_id ORDER BY seq)""")
view("hev", "hb", "SELECT doc_id, sec, seq, block_type, margin_left AS m FROM hb WHERE block_type<>'HEADING' AND target IS NULL")
view("hlist", "hev", """
SELECT i.doc_id, i.seq, max(k.seq) AS lp
FROM hev i JOIN hev k ON k.doc_id=i.doc_id AND k.sec=i.sec AND k.block_type='LIST' AND k.seq<i.seq
WHERE NOT EXISTS (SELECT 1 FROM hev j WHERE j.doc_id=k.doc_id AND j.sec=k.sec AND j.seq>k.seq AND j.seq<=i.seq
   AND (CASE WHEN j.block_type='LIST' THEN j.m-10 <= k.m ELSE j.m+5 < k.m END))
GROUP BY ALL""")
view("hhead", "hb", """
SELECT a.doc_id, a.seq, max(h.seq) AS hp FROM hb a JOIN hb h ON h.doc_id=a.doc_id AND h.seq<a.seq AND h.block_type='HEADING'
 AND (a.block_type<>'HEADING' OR h.heading_level<a.heading_level) GROUP BY ALL""")
view("hpar", "hb hlist hhead", """
SELECT b.*, CASE WHEN target IS NOT NULL THEN target WHEN block_type='HEADING' THEN hp ELSE coalesce(lp, hp) END AS pseq
FROM hb b LEFT JOIN hlist l USING (doc_id, seq) LEFT JOIN hhead h USING (doc_id, seq)""")
view("htree", "hpar", """
SELECT doc_id, seq, block_id, 0 AS depth, CASE WHEN block_type='HEADING' AND heading_level=1 THEN block_id END AS chapter_id,
  CASE WHEN block_type='HEADING' THEN block_id END AS section_id, [seq] AS pre, CAST([] AS VARCHAR[]) AS titles, CAST([] AS VARCHAR[]) AS ids
FROM hpar WHERE pseq IS NULL
UNION ALL
SELECT c.doc_id, c.seq, c.block_id, t.depth+1, CASE WHEN c.block_type='HEADING' AND c.heading_level=1 THEN c.block_id ELSE t.chapter_id END,
  CASE WHEN c.block_type='HEADING' THEN c.block_id ELSE t.section_id END, list_append(t.pre, c.seq),
  list_append(t.titles, p.text), list_append(t.ids, p.block_id)
FROM htree t JOIN hpar c ON c.doc_id=t.doc_id AND c.pseq=t.seq JOIN hpar p ON p.doc_id=t.doc_id AND p.seq=t.seq""", recursive=True)
view("hx", "hpar htree", """
SELECT p.*, t.depth, t.chapter_id, t.section_id, t.pre, t.titles, t.ids, pp.block_id AS parent_block_id, pp.block_type AS ptype, pp.heading_level AS plevel
FROM hpar p JOIN htree t USING (doc_id, seq) LEFT JOIN hpar pp ON pp.doc_id=p.doc_id AND pp.seq=p.pseq""")
view("hclo", "hx", "SELECT doc_id, block_id, seq, pre, unnest(pre[:-2]) AS anc FROM hx")
view("hsub", "hx hclo", """
SELECT doc_id, block_id, block_type, parent_block_id, pseq, subtree_size, child_count,
  CASE WHEN block_type='HEADING' THEN fd END AS first_descendant,
  CASE WHEN block_type='HEADING' THEN coalesce(ld, block_id) END AS last_descendant
FROM (SELECT x.doc_id, x.block_id, x.block_type, x.parent_block_id, x.pseq, 1 + count(c.seq) AS subtree_size,
  count(c.seq) FILTER (c.pre[-2]=x.seq) AS child_count,
  arg_min(c.block_id, c.seq) FILTER (c.pre[-2]=x.seq) AS fd, arg_max(c.block_id, c.pre) AS ld
 FROM hx x LEFT JOIN hclo c ON c.doc_id=x.doc_id AND c.anc=x.seq GROUP BY x.doc_id, x.block_id, x.block_type, x.parent_block_id, x.pseq)""")
view("hedge", "hx", """
SELECT doc_id, parent_block_id AS source_id, block_id AS target_id, 'PARENT_CHILD' AS edge_type, 0.9::DOUBLE AS confidence FROM hx WHERE pseq IS NOT NULL
UNION ALL SELECT * FROM (SELECT doc_id, lag(block_id) OVER (PARTITION BY doc_id, pseq ORDER BY seq) AS s, block_id, 'SIBLING', 0.95::DOUBLE FROM hx WHERE pseq IS NOT NULL) WHERE s IS NOT NULL
UNION ALL SELECT doc_id, previous_block_id, block_id, 'READING_FLOW', 0.99::DOUBLE FROM hx WHERE previous_block_id IS NOT NULL
UNION ALL SELECT doc_id, parent_block_id, block_id, 'CAPTION_ASSOCIATION', 0.95::DOUBLE FROM hx WHERE target IS NOT NULL""")
view("hval", "hx", """
SELECT *, 1 - least(1, warning_count/blocks) AS consistency_score FROM (
SELECT *, orphan_count + heading_jumps AS warning_count FROM (
SELECT doc_id, count(*) AS blocks, count(*) FILTER (block_type='HEADING') AS headings,
 count(*) FILTER (block_type='HEADING' AND ptype='HEADING' AND heading_level>plevel+1) AS heading_jumps,
 count(*) FILTER (pseq IS NULL) AS root_count, max(depth) AS max_depth,
 CASE WHEN count(*) FILTER (block_type='HEADING')>0 THEN count(*) FILTER (pseq IS NULL AND block_type NOT IN ('HEADING','HEADER','FOOTER','PAGE_NUMBER')) ELSE 0 END
  + count(*) FILTER (pseq IS NULL AND block_type='CAPTION') AS orphan_count, false AS cycle_detected
FROM hx GROUP BY doc_id))""")


def pairs(src):
    return f"""SELECT a.doc_id, a.page_number, a.block_id AS block_a, b.block_id AS block_b, ia/least(sa,sb) AS overlap FROM (
SELECT a.doc_id, a.page_number, a.block_id, b.block_id AS bb,
 (least(a.x1,b.x1)-greatest(a.x0,b.x0))*(least(a.y1,b.y1)-greatest(a.y0,b.y0)) AS ia, (a.x1-a.x0)*(a.y1-a.y0) AS sa, (b.x1-b.x0)*(b.y1-b.y0) AS sb
FROM {src} a JOIN {src} b ON a.doc_id=b.doc_id AND a.page_number=b.page_number AND a.seq<b.seq
 AND least(a.x1,b.x1)>greatest(a.x0,b.x0) AND least(a.y1,b.y1)>greatest(a.y0,b.y0)) a, (SELECT 1) b_ WHERE ia/least(sa,sb)>0.15""".replace(
        "b.block_id AS block_b, ia", "a.bb AS block_b, ia")


def lay(src):
    return f"""SELECT *, 1 - least(1, 0.2*empty_blocks/blocks + 0.3*least(1, overlapping_pairs/blocks) + 0.2*r_spacing + 0.3*odd_blocks/blocks) AS layout_quality
FROM (SELECT b.doc_id, count(*) AS blocks, count(*) FILTER (trim(text,{WS})='') AS empty_blocks,
  coalesce(any_value(p.n),0) AS overlapping_pairs, coalesce(any_value(o.n),0) AS odd_blocks, coalesce(any_value(s.r),0) AS r_spacing
 FROM {src} b LEFT JOIN (SELECT doc_id, count(*) n FROM ({pairs(src)}) GROUP BY 1) p USING (doc_id)
 LEFT JOIN (SELECT doc_id, count(*) n FROM ({odd(src)}) GROUP BY 1) o USING (doc_id)
 LEFT JOIN ({spc(src)}) s USING (doc_id) GROUP BY b.doc_id)"""


def odd(src):
    wc = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x<>''))"
    return f"""SELECT doc_id, block_id, CASE WHEN y1-y0>4*ah AND {wc}>60 THEN 'MERGED_LAYOUT_BLOCK' ELSE 'SPLIT_LAYOUT_BLOCK' END AS code
FROM (SELECT *, coalesce(avg(y1-y0) FILTER (y1>y0) OVER (PARTITION BY doc_id), 15) AS ah FROM {src})
WHERE (y1-y0>4*ah AND {wc}>60) OR (y1-y0<0.6*ah AND {wc} BETWEEN 1 AND 3)"""


def spc(src):
    return f"""SELECT doc_id, avg(least(1, sd/greatest(5, mn))) AS r FROM (
SELECT doc_id, page_number, count(*) n, avg(g) mn, stddev_pop(g) sd FROM (
 SELECT doc_id, page_number, y0-lag(y1) OVER (PARTITION BY doc_id, page_number ORDER BY y0, seq) AS g FROM {src}) WHERE g>=0 GROUP BY ALL) WHERE n>1 GROUP BY 1"""


view("qocr", "cls", r"""
SELECT *, greatest(0, least(1, avg_confidence*(1-r_suspicious)*(1-r_garbage))) AS ocr_quality FROM (
SELECT doc_id, avg(CASE WHEN confidence=0 THEN 1 ELSE confidence END) AS avg_confidence, coalesce(sum(odd)/sum(words),0) AS r_suspicious,
 sum(bad)/sum(length(text)) AS r_garbage
FROM (SELECT *, len(list_filter(ws, lambda x: x<>'')) AS words,
  len(list_filter(ws, lambda x: regexp_matches(x, '\d+[a-zA-Z]|[a-zA-Z]+\d+|[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]{5,}'))) AS odd,
  length(regexp_replace(text, '[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{ff}]', '', 'g')) AS bad
 FROM (SELECT *, regexp_split_to_array(text, '\s+') AS ws FROM cls)) WHERE text<>'' GROUP BY doc_id)""")
view("qlay", "cls", lay("cls"))
view("qsem", "cls", """
SELECT *, greatest(0, least(1, avg_semantic*(1-r_unknown))) AS semantic_quality FROM (
SELECT doc_id, avg(semantic_conf) AS avg_semantic, count(*) FILTER (block_type='UNKNOWN')/count(*) AS r_unknown,
 count(*) FILTER (semantic_conf<0.6) AS low_confidence FROM cls GROUP BY doc_id)""")


def rd(src):
    return f"""SELECT doc_id, backward_jumps, CASE WHEN backward_jumps>0 THEN greatest(0, 1-0.15::DOUBLE*backward_jumps) ELSE 1 END AS reading_quality
FROM (SELECT doc_id, count(*) FILTER (np=page_number AND ny<y0-200) AS backward_jumps
 FROM (SELECT *, lead(page_number) OVER w AS np, lead(y1) OVER w AS ny FROM {src} WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) GROUP BY 1)"""


view("qrd", "cls", rd("cls"))
view("qall", "qocr qlay qsem qrd hval", """
SELECT *, greatest(0, least(1, pow(ocr_quality*layout_quality*semantic_quality*hierarchy_quality*reading_quality, 0.2))) AS overall_quality
FROM (SELECT l.*, o.* EXCLUDE (doc_id), s.* EXCLUDE (doc_id), r.* EXCLUDE (doc_id), v.orphan_count, v.cycle_detected, v.consistency_score AS hierarchy_quality
FROM qlay l JOIN qocr o USING (doc_id) JOIN qsem s USING (doc_id) JOIN qrd r USING (doc_id) JOIN hval v USING (doc_id))""")
R = lambda *c: ", ".join(f"round({x},9) AS {x}" for x in c)
RND = ("ocr_quality", "layout_quality", "semantic_quality", "hierarchy_quality", "reading_quality", "overall_quality", "r_garbage", "r_spacing", "r_unknown")
view("qnote", "qall", f"SELECT * REPLACE ({R(*RND)}) FROM qall")
QS = ("ocr_quality", "layout_quality", "semantic_quality", "hierarchy_quality", "reading_quality", "overall_quality")
_rules = [
    ("ocr_quality<0.75", "warning", "POOR_OCR_CONFIDENCE", "CASE WHEN ocr_quality<0.6 THEN 'CRITICAL' ELSE 'WARNING' END"),
    ("r_garbage>0.05", "warning", "EXCESSIVE_GARBAGE_CHARS", "'WARNING'"),
    ("ocr_quality<0.7", "recommendation", "RERUN_OCR_RECOMMENDED", "'WARNING'"),
    ("overlapping_pairs>0", "warning", "OVERLAPPING_LAYOUT_ELEMENTS", "'WARNING'"),
    ("r_spacing>0.4", "warning", "INCONSISTENT_LAYOUT_SPACING", "'INFO'"),
    ("layout_quality<0.7", "recommendation", "MANUAL_REVIEW_REQUIRED", "'WARNING'"),
    ("low_confidence>0", "warning", "LOW_SEMANTIC_CONFIDENCE", "CASE WHEN low_confidence>blocks*0.2::DOUBLE THEN 'WARNING' ELSE 'INFO' END"),
    ("r_unknown>0.15", "warning", "EXCESSIVE_UNKNOWN_BLOCKS", "'WARNING'"),
    ("cycle_detected", "warning", "CYCLIC_HIERARCHY_RELATIONS", "'CRITICAL'"),
    ("orphan_count>blocks*0.1::DOUBLE", "warning", "LARGE_ORPHAN_COUNT", "'WARNING'"),
    ("hierarchy_quality<0.6", "recommendation", "MANUAL_REVIEW_REQUIRED", "'WARNING'"),
    ("backward_jumps>0", "warning", "BACKWARD_READING_FLOW", "'WARNING'"),
    ("reading_quality<0.75", "warning", "AMBIGUOUS_READING_FLOW", "'WARNING'"),
    ("overall_quality<0.6", "recommendation", "LOW_CONFIDENCE_FOR_AI", "'CRITICAL'"),
    ("overall_quality>=0.85", "recommendation", "SUITABLE_FOR_GENERATION", "'INFO'"),
    ("reading_quality<0.6 AND layout_quality>=0.7 AND hierarchy_quality>=0.6", "recommendation", "MANUAL_REVIEW_REQUIRED", "'WARNING'"),
]
SQL = {
    "classified_blocks": build("cls", "SELECT doc_id, block_id, seq, block_type, heading_level FROM cls"),
    "heading_parents": build("hx", "SELECT doc_id, block_id, parent_block_id FROM hx WHERE block_type='HEADING'"),
    "list_nesting": build("hx", "SELECT doc_id, block_id, parent_block_id FROM hx WHERE block_type<>'HEADING'"),
    "caption_targets": build("hx", "SELECT doc_id, block_id, CASE WHEN target IS NOT NULL THEN parent_block_id END AS caption_target_id FROM hx WHERE block_type='CAPTION'"),
    "hierarchy_depth": build("hx", "SELECT doc_id, block_id, depth, chapter_id, section_id FROM hx"),
    "subtree_sizes": build("hsub", "SELECT doc_id, block_id, subtree_size, first_descendant, last_descendant FROM hsub"),
    "hierarchy_rows": build("hsub", """SELECT doc_id, block_id, parent_block_id, CASE WHEN block_type='HEADING' THEN 'heading_hierarchy' ELSE 'parent_child_containment' END AS relation_type,
       child_count, CASE WHEN pseq IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY doc_id, pseq) - 1 END AS sibling_count FROM hsub"""),
    "hierarchy_children": build("hx", "SELECT doc_id, parent_block_id AS block_id, block_id AS child_id, seq FROM hx WHERE pseq IS NOT NULL"),
    "reading_edges": build("hedge", "SELECT * FROM hedge"),
    "graph_navigation": build("hx", """SELECT doc_id, block_id, parent_id, next_id, previous_id, child_count FROM (
       SELECT doc_id, block_id, parent_block_id AS parent_id, lead(block_id) OVER w AS next_id, previous_block_id AS previous_id,
        (SELECT count(*) FROM hx c WHERE c.doc_id=x.doc_id AND c.pseq=x.seq) AS child_count
       FROM hx x WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) WHERE parent_id IS NOT NULL OR next_id IS NOT NULL OR previous_id IS NOT NULL OR child_count>0"""),
    "ancestors": build("hx", "SELECT doc_id, unnest(ids) AS ancestor_id, block_id AS descendant_id, depth - generate_subscripts(ids,1) + 1 AS distance FROM hx"),
    "breadcrumbs": build("hx", """SELECT x.doc_id, x.block_id, array_to_string(list_filter(x.titles, lambda t: t<>''), ' > ') AS breadcrumb, x.section_id, s.text AS section_title
       FROM hx x LEFT JOIN hx s ON s.doc_id=x.doc_id AND s.block_id=x.section_id"""),
    "hierarchy_validation": build("hval", f"SELECT * EXCLUDE (consistency_score), {R('consistency_score')} FROM hval"),
    "overlap_pairs": build("blk2", f"SELECT doc_id, page_number, block_a, block_b, round(overlap,9) AS overlap FROM ({pairs('blk2')})"),
    "quality_ocr": build("qocr", f"SELECT doc_id, {R('avg_confidence', 'r_suspicious', 'r_garbage', 'ocr_quality')} FROM qocr"),
    "quality_layout": build("blk2", f"SELECT doc_id, blocks, empty_blocks, overlapping_pairs, odd_blocks, {R('r_spacing', 'layout_quality')} FROM ({lay('blk2')})"),
    "quality_spacing": build("cls", f"SELECT doc_id, round(r,9) AS r_spacing FROM ({spc('cls')})"),
    "odd_blocks": build("rich", f"SELECT * FROM ({odd('(SELECT * REPLACE (CASE WHEN seq%5=0 THEN y0+3 ELSE y1 END AS y1) FROM rich)')})"),
    "quality_semantic": build("qsem", f"SELECT doc_id, low_confidence, {R('avg_semantic', 'r_unknown', 'semantic_quality')} FROM qsem"),
    "quality_hierarchy": build("hval", "SELECT doc_id, round(consistency_score,9) AS hierarchy_quality, orphan_count, cycle_detected FROM hval"),
    "quality_hierarchy_fallback": build("hx", """SELECT doc_id, CASE WHEN h>0 THEN round(1-o/n,9) ELSE 1 END AS hierarchy_quality, CASE WHEN h>0 THEN o ELSE 0 END AS orphan_count, false AS cycle_detected
       FROM (SELECT doc_id, count(*) n, count(*) FILTER (block_type='HEADING') h, count(*) FILTER (pseq IS NULL AND block_type NOT IN ('HEADING','HEADER','FOOTER','PAGE_NUMBER')) o FROM hx GROUP BY 1)"""),
    "quality_reading": build("cls", f"SELECT doc_id, backward_jumps, {R('reading_quality')} FROM ({rd('(SELECT * REPLACE (CASE WHEN doc_id%3=0 THEN (y0*7)%400 ELSE y0 END AS y0, CASE WHEN doc_id%3=0 THEN (y0*7)%400+12 ELSE y1 END AS y1) FROM cls)')})"),
    "quality_overall": build("qall", f"SELECT doc_id, {R(*QS)} FROM qall"),
    "quality_warnings": build("qnote cls", "\nUNION ALL ".join(
        f"SELECT doc_id, CAST(doc_id AS VARCHAR) AS target_id, '{k}' AS kind, '{c}' AS code, {s} AS severity FROM qnote WHERE {w}" for w, k, c, s in _rules)
        + f"\nUNION ALL SELECT doc_id, block_id, 'warning', code, CASE WHEN code='MERGED_LAYOUT_BLOCK' THEN 'WARNING' ELSE 'INFO' END FROM ({odd('cls')})"),
}
