"""Oracle SQL for features, classification, order and first-pass assembly."""

from .cte import build, view
from .text_sql import WS

U, L, A = r"\p{Lu}", r"\p{Ll}", r"\p{L}\p{N}"


def cnt(c, cls):
    return f"length(regexp_replace({c}, '[^{cls}]', '', 'g'))"


def feat(src):
    return rf"""
SELECT *, width/height AS aspect_ratio,
  CASE WHEN abs(margin_left-margin_right)<15 AND margin_left>40 THEN 'center' ELSE 'left' END AS alignment,
  {cnt('text', U)}/char_count AS uppercase_ratio, {cnt('text', L)}/char_count AS lowercase_ratio,
  {cnt('text', r'\p{Nd}')}/char_count AS digit_ratio,
  length(regexp_replace(text, '[^.,!?;:"''()\[\]{{}}]', '', 'g'))/char_count AS punctuation_ratio,
  length(regexp_replace(text, '[{A}\s]', '', 'g'))/char_count AS symbol_ratio,
  CASE WHEN word_count>0 THEN length(regexp_replace(text, '\s', '', 'g'))/word_count ELSE 0 END AS avg_word_length,
  char_count/(width*height) AS text_density
FROM (SELECT *, x1-x0 AS width, y1-y0 AS height, y0/page_height AS page_position_y, x0 AS margin_left,
  page_width-x1 AS margin_right, font_size AS f_size, font_family AS f_family, bold AS f_bold, italic AS f_italic,
  regexp_matches(text, '{U}') AND NOT regexp_matches(text, '{L}') AS all_caps,
  regexp_matches(text, '{U}') AND NOT regexp_matches(text, '[{U}{L}]{U}|(^|[^{U}{L}]){L}') AS title_case,
  regexp_matches(left(text,1), '{U}') AS starts_capital,
  right(trim(text, {WS}), 1) IN ('.','!','?',';',':',',') AS ends_punct,
  CAST(length(text) AS DOUBLE) AS char_count,
  CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS DOUBLE) AS word_count,
  lag(block_id) OVER d AS prev_block_id, lead(block_id) OVER d AS next_block_id,
  lag(text) OVER d AS prev_text, lead(text) OVER d AS next_text,
  lag(font_size) OVER d AS prev_font_size, lead(font_size) OVER d AS next_font_size,
  lag(block_type) OVER d AS prev_block_type, lead(block_type) OVER d AS next_block_type,
  lag(y1) OVER p IS NULL AS is_at_top, lead(y0) OVER p IS NULL AS is_at_bottom,
  coalesce(greatest(0, y0 - lag(y1) OVER p), 0) AS space_above,
  coalesce(greatest(0, lead(y0) OVER p - y1), 0) AS space_below,
  (y1-y0)/len(string_split(text, chr(10))) AS line_spacing
  FROM {src}
  WINDOW d AS (PARTITION BY doc_id ORDER BY seq), p AS (PARTITION BY doc_id, page_number ORDER BY reading_order))"""


NUM = r"^((?i:chapter\s+\d+|part\s+[ivx\d]+|section\s+\d+|lesson\s+\d+)|\d+(\.\d+)*\s+[A-Z])"


def dom(src, value, weight, name):
    return f"""SELECT doc_id, first(v ORDER BY w DESC, f) AS {name}
FROM (SELECT doc_id, {value} AS v, sum({weight}) AS w, min(seq) AS f FROM {src} GROUP BY ALL) GROUP BY doc_id"""


def c2(src):
    d = "(f_size - dominant_size)"
    gap = lambda c: f"CASE WHEN {c}>25 THEN 0.5 WHEN {c}>15 THEN 0.25 ELSE 0 END"
    dbl = lambda s: f"CAST({s} AS DOUBLE)"
    return rf"""
SELECT *, CASE WHEN NOT alnum THEN 'UNKNOWN' WHEN c2_conf >= 0.65 THEN 'HEADING' WHEN c2_conf < 0.35 THEN 'UNKNOWN' ELSE 'PARAGRAPH' END AS c2_type
FROM (SELECT *, CASE WHEN t='' THEN 1 WHEN NOT alnum THEN 0 ELSE greatest(0, least(1, (weighted_sum/7.5+1)/2)) END AS c2_conf
FROM (SELECT *, sig_size+sig_bold+sig_length+sig_case+sig_punctuation+sig_numbering+sig_spacing+sig_alignment AS weighted_sum
FROM (SELECT *, trim(text, {WS}) AS t, regexp_matches(text, '[{A}]') AS alnum,
 1.5*{dbl(f"CASE WHEN {d}>4.5 THEN 1 WHEN {d}>2 THEN 0.6 WHEN abs({d})<=0.75 THEN -0.5 WHEN {d}<-1 THEN -0.8 ELSE 0 END")} AS sig_size,
 {dbl("CASE WHEN f_bold THEN 0.8 ELSE -0.5 END")} AS sig_bold,
 0.8*{dbl("CASE WHEN word_count<8 AND NOT ends_punct THEN 0.8 WHEN word_count<15 THEN 0.4 WHEN word_count>30 THEN -1 ELSE 0 END")} AS sig_length,
 0.6*{dbl("CASE WHEN all_caps THEN 0.8 WHEN title_case THEN 0.4 WHEN starts_capital THEN 0.2 ELSE -0.3 END")} AS sig_case,
 1.2*{dbl(f"CASE WHEN ends_punct AND right(trim(text, {WS}),1) IN ('.','?','!') THEN -0.6 WHEN punctuation_ratio>0.15 THEN -0.5 ELSE 0.3 END")} AS sig_punctuation,
 {dbl(f"CASE WHEN regexp_matches(trim(text, {WS}), '{NUM}') THEN 1 ELSE 0 END")} AS sig_numbering,
 0.8*{dbl(f"{gap('space_above')} + {gap('space_below')}")} AS sig_spacing,
 0.6*{dbl("CASE WHEN alignment='center' THEN 0.6 ELSE 0 END")} AS sig_alignment
FROM {src})))"""


def first_pass(src, domv, per="doc_id"):
    d = "(font_size - dominant_size)"
    net = rf"""
 1.5*(CASE WHEN {d}>4.5 THEN 1 WHEN {d}>2 THEN 0.6 WHEN abs({d})<=0.75 THEN -0.5 WHEN {d}<-1 THEN -0.8 ELSE 0 END)::DOUBLE
 + (CASE WHEN bold THEN 0.8 ELSE -0.5 END)::DOUBLE
 + 0.8*(CASE WHEN length(t)<40 AND nl=1 THEN 0.8 WHEN length(t)<100 AND nl<=2 THEN 0.4 WHEN length(t)>200 OR nl>3 THEN -1 ELSE 0 END)::DOUBLE
 + 0.6*(CASE WHEN regexp_matches(t,'{U}') AND NOT regexp_matches(t,'{L}') THEN 0.8
       WHEN regexp_matches(left(t,1),'{U}') AND NOT (regexp_matches(t,'{L}') AND NOT regexp_matches(t,'{U}')) THEN 0.3 ELSE -0.2 END)::DOUBLE
 + 1.2*(CASE WHEN right(t,1) IN ('.','?','!') THEN -0.6 WHEN length(regexp_replace(t,'[{A}\s]','','g'))/length(t) > 0.15 THEN -0.5 ELSE 0.3 END)::DOUBLE
 + (CASE WHEN regexp_matches(t, '{NUM}') THEN 1 ELSE 0 END)::DOUBLE
 + 0.8*(CASE WHEN y0-py1>25 THEN 0.5 WHEN y0-py1>15 THEN 0.25 ELSE 0 END + CASE WHEN ny0-y1>20 THEN 0.3 ELSE 0 END)::DOUBLE
 + (CASE WHEN font_size>ps+1.5 THEN 0.5 ELSE 0 END + CASE WHEN font_size>ns+1.5 THEN 0.5 ELSE 0 END)::DOUBLE"""
    lst = " OR ".join(f"starts_with(t,'{x}')" for x in ("•", "-", "*", "o", "▪", "1.", "2.", "3.", "a.", "b.", "c.", "i.", "ii."))
    cap = " OR ".join(f"starts_with(lower(t),'{x}')" for x in ("figure ", "fig. ", "table ", "tab. ", "image ", "illustration "))
    return f"""
SELECT * EXCLUDE (block_type), kind AS block_type,
  CASE WHEN kind='HEADING' THEN least(6, lvl) END AS heading_level
FROM (SELECT *, dense_rank() OVER (PARTITION BY {per}, kind ORDER BY font_size DESC) AS lvl
FROM (SELECT *, CASE WHEN t='' THEN 'UNKNOWN' WHEN y1<=60 THEN 'HEADER' WHEN y0>=page_height-60 THEN 'FOOTER'
    WHEN c>=0.65 THEN 'HEADING' WHEN {lst} THEN 'LIST' WHEN {cap} THEN 'CAPTION' WHEN c<0.35 THEN 'PARAGRAPH' ELSE 'UNKNOWN' END AS kind,
  CASE WHEN t='' THEN 1 WHEN y1<=60 OR y0>=page_height-60 THEN 0.95 WHEN c<0.65 AND ({lst} OR {cap}) THEN 0.9 ELSE round(c,3) END AS class_confidence
FROM (SELECT *, 1/(1+exp(-net_score)) AS c FROM (SELECT *, {net} AS net_score
FROM (SELECT b.*, dominant_size, trim(text, {WS}) AS t, len(string_split(text,chr(10))) AS nl,
   lag(y1) OVER w AS py1, lead(y0) OVER w AS ny0, lag(font_size) OVER w AS ps, lead(font_size) OVER w AS ns
   FROM {src} b JOIN {domv} USING ({per}) WINDOW w AS (PARTITION BY b.doc_id, page_number ORDER BY seq))))))"""


def rorder(src, head, foot, span, bymx):
    return f"""
SELECT * EXCLUDE (zone, side, two, seg, rk, xk),
  CASE WHEN two AND side=1 THEN 1 ELSE 0 END AS column_index,
  row_number() OVER (PARTITION BY doc_id ORDER BY page_number, zone, seg, rk, y0, xk, seq) - 1 AS new_seq,
  row_number() OVER (PARTITION BY doc_id, page_number ORDER BY zone, seg, rk, y0, xk, seq) - 1 AS page_order
FROM (SELECT *, CASE WHEN two THEN above - CASE WHEN side=2 THEN 1 ELSE 0 END ELSE 0 END AS seg,
        CASE WHEN two THEN side ELSE 0 END AS rk, CASE WHEN NOT two AND {bymx} THEN x0 ELSE 0 END AS xk
FROM (SELECT *, zone=1 AND bool_or(side=0) OVER p AND bool_or(side=1) OVER p AS two,
        count(*) FILTER (side=2) OVER (p ORDER BY y0 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above
FROM (SELECT *, CASE WHEN zone<>1 THEN 9 WHEN {span} THEN 2 WHEN (x0+x1)/2 < page_width/2 THEN 0 ELSE 1 END AS side
FROM (SELECT *, CASE WHEN {head} THEN 0 WHEN {foot} THEN 2 ELSE 1 END AS zone FROM {src}))
WINDOW p AS (PARTITION BY doc_id, page_number)))"""


view("feat", "blk", feat("blk"))
# Text variants that make every classification rule fire on part of the rows.
view("rich", "blk", """
SELECT * REPLACE (CASE seq%23
  WHEN 3 THEN '- '||text WHEN 4 THEN '  (a) '||text WHEN 5 THEN 'Note: '||text
  WHEN 6 THEN '"'||text||'"' WHEN 7 THEN 'Table '||seq||' '||text
  WHEN 8 THEN 'a | b | c'||chr(10)||'d    e    f' WHEN 9 THEN 'return { x; }; class;'
  WHEN 10 THEN 'x = 1 + 2 * (3 - 4)' WHEN 11 THEN '12 '||text WHEN 12 THEN 'Chapter '||seq
  WHEN 13 THEN 'Definition '||seq||' '||text WHEN 14 THEN 'Theorem 3 '||text WHEN 15 THEN 'Summary of '||text
  WHEN 16 THEN 'Exercise 4 '||text WHEN 17 THEN '1. '||text WHEN 18 THEN '***' ELSE text END AS text,
  CASE WHEN seq%23 IN (3,17) THEN x0 + 20*(seq%4) ELSE x0 END AS x0,
  CASE WHEN seq%23 IN (3,17) THEN x1 + 80 ELSE x1 END AS x1,
  CASE WHEN seq%23 = 11 THEN CAST(8 AS DOUBLE) WHEN seq%23=12 THEN CAST(22 AS DOUBLE) ELSE font_size END AS font_size,
  CASE WHEN seq%23 = 9 THEN 'Courier' ELSE font_family END AS font_family,
  seq%17=0 AS italic)
FROM blk""")
view("rfeat", "rich", feat("rich"))
view("rdom", "rfeat", dom("rfeat", "f_size", "char_count", "dominant_size"))
view("rc2", "rfeat rdom", c2("(SELECT f.*, dominant_size FROM rfeat f JOIN rdom USING (doc_id))"))
view("rlvl", "rc2", """
SELECT *, CASE WHEN c2_type='HEADING' THEN least(6, dense_rank() OVER (PARTITION BY doc_id, c2_type ORDER BY f_size DESC)) END AS heading_level
FROM rc2""")
view("rind", "rlvl", dom("rlvl", "round_even(margin_left/5,0)*5", "1", "dominant_indent"))
view("rc5", "rlvl rind", rf"""
SELECT *, coalesce(c5_type, c2_type) AS type5 FROM (
SELECT r.*, dominant_indent, CASE
 WHEN c2_type='HEADING' OR t='' THEN NULL
 WHEN regexp_matches(t, '^(?i:note|footnote|source|tip|warning|notice):\s+') THEN 'NOTE'
 WHEN page_position_y>0.75 AND f_size<=dominant_size-1.5 AND regexp_matches(t, '^(\d|[*†‡§¶]\s+[A-Za-z])') THEN 'FOOTNOTE'
 WHEN regexp_matches(t, '^[•◦▪▫◊○●◘‣⁃◉◈■◆\-*✦➢¶]\s+') OR regexp_matches(t, '^(\d+(\.\d+)*|[a-zA-Z]|[ivxldcmIVXLDCM]+)[.)]\s+')
   OR regexp_matches(t, '^\((\d+|[a-zA-Z]|[ivxldcmIVXLDCM]+)\)\s+') THEN 'LIST'
 WHEN (t LIKE '"%' AND t LIKE '%"') OR (margin_left>dominant_indent+15 AND (margin_right>80 OR f_italic)) THEN 'QUOTE' END AS c5_type
FROM rlvl r JOIN rind USING (doc_id))""")
view("rc6", "rc5", rf"""
SELECT *, coalesce(c6_type, type5) AS type6 FROM (SELECT *, CASE
 WHEN type5 IN ('HEADING','LIST','QUOTE','FOOTNOTE','NOTE') OR t='' THEN NULL
 WHEN regexp_matches(t, '^(?i:figure|fig|table|map|chart|illustration|diagram)\s+\d+') THEN 'CAPTION'
 WHEN len(ls)>=2 AND len(list_filter(ls, lambda x: regexp_matches(x, '\s{{3,}}') OR contains(x,'|')))>=2
  AND len(list_filter(ls, lambda x: regexp_matches(x, '\s{{3,}}') OR contains(x,'|')))>=len(ls)*0.5 THEN 'TABLE' END AS c6_type
FROM (SELECT *, list_filter([trim(x) FOR x IN string_split(text, chr(10))], lambda x: x<>'') AS ls FROM rc5))""")
view("rcls", "rc6", rf"""
SELECT *, coalesce(c7_type, type6) AS type7,
 CASE coalesce(c7_type,c6_type,c5_type) WHEN 'NOTE' THEN 0.95 WHEN 'FOOTNOTE' THEN 0.9 WHEN 'LIST' THEN 0.95 WHEN 'QUOTE' THEN 0.85
  WHEN 'CAPTION' THEN 0.95 WHEN 'TABLE' THEN 0.9 WHEN 'CODE' THEN 0.9 WHEN 'EQUATION' THEN 0.95 ELSE c2_conf END AS semantic_conf
FROM (SELECT *, CASE WHEN type6 NOT IN ('PARAGRAPH','UNKNOWN') OR t='' THEN NULL
  WHEN (mono AND kw) OR (mono AND syn>=2) OR (kw AND syn/length(t)>0.05) THEN 'CODE'
  WHEN (word_count>0 AND tok>=3 AND tok/word_count>0.8) OR (sg/length(t)>0.85 AND length(t)<100) THEN 'EQUATION' END AS c7_type
FROM (SELECT *, regexp_matches(f_family, '(?i)courier|consolas|mono|menlo|dejavu|lucida') AS mono,
  regexp_matches(t, '(^|[^{A}_])(def|import|class|function|return|let|const|var|public|private|void|struct|package|namespace)($|[^{A}_])') AS kw,
  length(t)-length(translate(t,'{{}};','')) AS syn,
  len(regexp_extract_all(t, '\\[a-zA-Z]+|[+\-*/^=<>~]')) AS tok,
  length(regexp_replace(t, '[\p{{L}}]', '', 'g')) AS sg FROM rc6))""")
HEAD_R, FOOT_R = "block_type='HEADER'", "block_type IN ('FOOTER','PAGE_NUMBER')"
SPAN_R = "(x1-x0) > page_width*0.7 OR (x0 < page_width*0.3 AND x1 > page_width*0.7)"
view("ro2", "blk2", rorder("blk2", HEAD_R, FOOT_R, SPAN_R, "true"))
view("fdom", "blk2", dom("blk2", "font_size", "length(text)", "dominant_size"))
view("fpass", "blk2 fdom", first_pass("blk2", "fdom"))
view("ford", "fpass", rorder("fpass", "y1<=60", "y0>=page_height-60", "x0 < page_width/3 AND x1 > 2*page_width/3", "zone=1"))

R = lambda c: f"round({c}, 9) AS {c}"
NUMS = ["uppercase_ratio", "lowercase_ratio", "digit_ratio", "punctuation_ratio", "symbol_ratio", "avg_word_length", "text_density"]
SIGS = ["size", "bold", "length", "case", "punctuation", "numbering", "spacing", "alignment"]
SQL = {
    "features_typography": build("feat", "SELECT doc_id, block_id, f_size, f_family, f_bold, f_italic, all_caps, title_case, starts_capital, ends_punct FROM feat"),
    "features_geometry": build("feat", f"SELECT doc_id, block_id, width, height, {R('aspect_ratio')}, {R('page_position_y')}, margin_left, margin_right, alignment FROM feat"),
    "features_layout": build("feat", "SELECT doc_id, block_id, space_above, space_below, is_at_top, is_at_bottom, round(line_spacing,9) AS line_spacing FROM feat"),
    "features_statistics": build("feat", f"SELECT doc_id, block_id, CAST(char_count AS BIGINT) AS char_count, CAST(word_count AS BIGINT) AS word_count, {', '.join(R(n) for n in NUMS)} FROM feat"),
    "features_context": build("feat", "SELECT doc_id, block_id, prev_block_id, next_block_id, prev_text, next_text, prev_font_size, next_font_size, prev_block_type, next_block_type FROM feat"),
    "feature_fingerprint_delta": build("blk", "SELECT doc_id, block_id FROM blk WHERE seq%3=0"),
    "dominant_font": build("rdom rind", "SELECT doc_id, dominant_size, dominant_indent FROM rdom JOIN rind USING (doc_id)"),
    "heading_scores": build("rc2", f"SELECT doc_id, block_id, c2_type AS block_type, {', '.join(R('sig_' + s) for s in SIGS)}, {R('weighted_sum')}, {R('c2_conf')} FROM rc2"),
    "heading_levels": build("rlvl", "SELECT doc_id, block_id, heading_level FROM rlvl WHERE c2_type='HEADING'"),
    "list_quote_note": build("rc5", "SELECT doc_id, block_id, type5 AS block_type FROM rc5"),
    "table_caption": build("rc6", "SELECT doc_id, block_id, type6 AS block_type FROM rc6"),
    "code_formula": build("rcls", "SELECT doc_id, block_id, type7 AS block_type FROM rcls"),
    "semantic_annotations": build("rcls", """SELECT doc_id, block_id, type7 AS block_type, round(semantic_conf,9) AS semantic_conf,
       CASE WHEN c7_type IS NOT NULL THEN 'CODE_FORMULA_DETECTION_MODULE' WHEN c6_type IS NOT NULL THEN 'TABLE_CAPTION_DETECTION_MODULE'
            WHEN c5_type IS NOT NULL THEN 'LIST_QUOTE_NOTE_DETECTION_MODULE' ELSE 'HEADING_DETECTION_MODULE' END AS semantic_module,
       CASE WHEN coalesce(c7_type,c6_type,c5_type) IS NULL THEN 8 ELSE 1 END AS n_contributors FROM rcls"""),
    "reading_order_pages": build("ro2", "SELECT doc_id, block_id, new_seq AS seq, column_index, seq AS original_parser_order FROM ro2"),
    "reading_links": build("ro2", """SELECT doc_id, block_id, lag(block_id) OVER w AS previous_block_id, lead(block_id) OVER w AS next_block_id,
       CAST(0.95 AS DOUBLE) AS order_confidence FROM ro2 WINDOW w AS (PARTITION BY doc_id ORDER BY new_seq)"""),
    "first_pass_fonts": build("fdom", "SELECT doc_id, dominant_size, 'Times' AS dominant_family FROM fdom"),
    "first_pass_classify": build("fpass", "SELECT doc_id, block_id, block_type, round(class_confidence,3) AS class_confidence, round(net_score,9) AS net_score, heading_level FROM fpass"),
    "first_pass_order": build("ford", """SELECT doc_id, block_id, page_order AS reading_order,
       lag(block_id) OVER w AS previous_block_id, lead(block_id) OVER w AS next_block_id
       FROM ford WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY page_order)"""),
    "first_pass_parents": build("ford", """SELECT a.doc_id, a.block_id, arg_max(h.block_id, h.page_order) AS parent_block_id
       FROM ford a LEFT JOIN ford h ON h.doc_id=a.doc_id AND h.page_number=a.page_number AND h.page_order<a.page_order
        AND h.block_type='HEADING' AND (a.block_type<>'HEADING' OR h.heading_level<a.heading_level)
       GROUP BY a.doc_id, a.block_id"""),
    "needs_ocr": build("blk", """SELECT doc_id, max(page_number) AS page_count, sum(length(text)) AS chars,
       CASE WHEN sum(length(text)) < 50*max(page_number) THEN 'needs_ocr' ELSE 'processed' END AS status FROM blk GROUP BY doc_id"""),
}
