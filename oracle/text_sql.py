"""Oracle SQL for the stand-in views and for text normalisation."""

from .cte import build, view

view("lines", "", """
SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
       generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq
FROM documents""")

view("blk", "lines", """
SELECT doc_id, concat('b', doc_id, '_', seq) AS block_id, seq, CAST(1 + seq // 20 AS INTEGER) AS page_number,
       CAST(seq % 20 AS INTEGER) AS reading_order, 'PARAGRAPH' AS block_type, text,
       CAST(50 + 15*(length(text)%3) AS DOUBLE) AS x0, CAST(20 + 20*(seq%20) AS DOUBLE) AS y0,
       CAST(least(50 + 15*(length(text)%3) + 5*length(text), 560) AS DOUBLE) AS x1,
       CAST(32 + 20*(seq%20) AS DOUBLE) AS y1,
       CAST(CASE WHEN seq%20=0 THEN 18 WHEN seq%7=0 THEN 14 ELSE 10 END AS DOUBLE) AS font_size,
       'Times' AS font_family, seq%7=0 AS bold, false AS italic,
       CAST(1.0 AS DOUBLE) - CAST(0.1 AS DOUBLE)*(length(text)%5) AS confidence, 'NATIVE' AS provenance,
       CAST(595 AS DOUBLE) AS page_width, CAST(440 AS DOUBLE) AS page_height
FROM lines""")

view("blk2", "blk", """
SELECT * REPLACE (
  CAST(CASE WHEN seq%5 IN (0,1,2) THEN 50 ELSE 320 END AS DOUBLE) AS x0,
  CAST(CASE WHEN seq%5=0 THEN 550 WHEN seq%5 IN (1,2) THEN 280 ELSE 550 END AS DOUBLE) AS x1,
  CAST(44 + 20*(seq%20) AS DOUBLE) AS y1)
FROM blk""")

view("wrp", "blk", """
SELECT * EXCLUDE (low, ended, broken) REPLACE (
  CASE WHEN seq%8=5 THEN replace(broken,'e ','e'||chr(9)||' ')
       WHEN seq%8=6 THEN replace(broken,'fi',chr(64257))
       WHEN seq%8=7 THEN replace(broken,' an',' '||chr(8211)||' an'||chr(7))
       WHEN seq%11=0 THEN ' '||chr(9)
       ELSE broken END AS text)
FROM (SELECT *, CASE WHEN seq%6=4 THEN replace(ended, ', ', ','||chr(10))
                     WHEN seq%6=2 THEN replace(ended, ' th', ' t-'||chr(10)||'h') ELSE ended END AS broken
      FROM (SELECT *, CASE WHEN seq%5 IN (1,2) THEN rtrim(low,'.')||'-'
                           WHEN seq%4<>3 THEN rtrim(low,'.') ELSE low END AS ended
            FROM (SELECT *, CASE WHEN seq%3<>0 THEN lower(text) ELSE text END AS low FROM blk)))""")

view("hdr", "wrp", """
SELECT * REPLACE (
  CASE WHEN seq%20=0 THEN 'Running Title' WHEN seq%20=19 THEN 'Page '||page_number
       WHEN seq%20=18 AND doc_id%2=0 THEN 'Foot Line' ELSE text END AS text,
  CASE WHEN seq%20 IN (0,18,19) THEN CAST(50 AS DOUBLE) ELSE x0 END AS x0,
  CASE WHEN seq%20 IN (18,19) THEN CAST(9 AS DOUBLE) ELSE font_size END AS font_size)
FROM wrp""")

# ---- scalar steps over any source view -------------------------------------
WS = "' '||chr(9)||chr(10)||chr(13)"


def scalar(src: str) -> str:
    one = ("replace(replace(replace(replace(replace(replace(translate(t0, '“”„‘’‚–—―', '\"\"\"''''''---'),"
           "'ﬁ','fi'),'ﬂ','fl'),'ﬀ','ff'),'ﬃ','ffi'),'ﬄ','ffl'),'…','...')")
    return f"""
SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
            replace(replace(replace(t2, chr(13)||chr(10), chr(10)), chr(13), chr(10)), chr(9), ' '),
            ' +', ' ', 'g'), ' *\\n', chr(10), 'g'), '\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10)||chr(10), 'g'), {WS}) AS t3
FROM (SELECT *, regexp_replace(t1, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f\\p{{Cf}}]', '', 'g') AS t2
      FROM (SELECT *, {one} AS t1 FROM (SELECT *, text AS t0 FROM {src})))"""


def hyphen(src: str) -> str:
    return f"""
SELECT * EXCLUDE (fix, joins, nxt, prev, isl, odd),
       CASE WHEN prev AND odd THEN '' WHEN joins AND NOT odd THEN left(fix, length(fix)-1)||nxt ELSE fix END AS t4,
       prev AND odd AS absorbed
FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id, isl ORDER BY seq) - 1) % 2 = 1 AS odd
      FROM (SELECT *, sum(CASE WHEN prev THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS isl
            FROM (SELECT *, coalesce(lag(joins) OVER w, false) AS prev
                  FROM (SELECT *, lead(t3) OVER w AS nxt,
                               coalesce(fix LIKE '%-'
                                 AND ((lead(page_number) OVER w = page_number AND lead(reading_order) OVER w = reading_order+1
                                       AND x1 > lead(x0) OVER w)
                                   OR (lead(page_number) OVER w = page_number+1
                                       AND lead(font_family) OVER w = font_family
                                       AND abs(lead(font_size) OVER w - font_size) <= 1))
                                 AND regexp_matches(lead(t3) OVER w, '\\A(?:\\p{{Ll}}|[^\\p{{L}}\\p{{N}}])'), false) AS joins
                        FROM (SELECT *, regexp_replace(t3, '([\\p{{L}}\\p{{N}}_]+)-\\n([\\p{{L}}\\p{{N}}_]+)', '\\1\\2', 'g') AS fix
                              FROM {src})
                        WINDOW w AS (PARTITION BY doc_id ORDER BY seq))
                  WINDOW w AS (PARTITION BY doc_id ORDER BY seq))))"""


def open_(c: str) -> str:
    return f"NOT regexp_matches(rtrim({c}, '\"'')'), '[.!?]$')"


def soft(src: str) -> str:
    return f"""
SELECT *, CASE WHEN block_type='PARAGRAPH' AND t4 LIKE '%'||chr(10)||'%' THEN
         trim(array_to_string([CASE WHEN l = '' THEN chr(10) WHEN i = len(ls) THEN l
              WHEN {open_('l')} AND regexp_matches(coalesce(ls[i+1],''), '^[\\p{{Ll}},;:\\-]') THEN l||' '
              ELSE l||chr(10) END FOR l, i IN ls], ''), {WS}) ELSE t4 END AS t5
FROM (SELECT *, [trim(x, {WS}) FOR x IN string_split(t4, chr(10))] AS ls FROM {src})"""


for base, src in (("w", "wrp"), ("h", "hdr")):
    view(f"{base}_s", src, scalar(src))
    view(f"{base}_hy", f"{base}_s", hyphen(f"{base}_s"))
    view(f"{base}_soft", f"{base}_hy", soft(f"{base}_hy"))
    view(f"{base}_alive", f"{base}_soft", f"""
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k,
       {open_(f'trim(t5, {WS})')} AS op, regexp_matches(trim(t5, {WS}), '^[\\p{{Ll}},;:\\-]') AS low
FROM {base}_soft WHERE NOT absorbed""")
    # Serial walk: (head, head page/size, running x0 and y1).
    view(f"{base}_walk", f"{base}_alive", f"""
SELECT doc_id, k, seq, seq AS head, page_number AS hp, font_size AS hs, x0 AS mx, y1 AS my, op
FROM {base}_alive WHERE k = 1
UNION ALL
SELECT n.doc_id, n.k, n.seq,
       CASE WHEN g THEN head ELSE n.seq END, CASE WHEN g THEN hp ELSE n.page_number END,
       CASE WHEN g THEN hs ELSE n.font_size END, CASE WHEN g THEN least(mx, n.x0) ELSE n.x0 END,
       CASE WHEN g THEN greatest(my, n.y1) ELSE n.y1 END, n.op
FROM (SELECT n.*, w.head, w.hp, w.hs, w.mx, w.my,
             w.op AND n.low AND abs(w.hs - n.font_size) <= 0.5 AND abs(w.mx - n.x0) <= 5
             AND ((n.page_number = w.hp AND n.y0 - w.my BETWEEN 0 AND 15) OR n.page_number = w.hp + 1) AS g
      FROM {base}_walk w JOIN {base}_alive n ON n.doc_id = w.doc_id AND n.k = w.k + 1) n""", recursive=True)
    view(f"{base}_para", f"{base}_alive {base}_walk", f"""
SELECT a.doc_id, w.head AS seq, arg_min(a.block_id, a.seq) AS block_id, count(*) AS parts,
       string_agg(a.t5, ' ' ORDER BY a.seq) AS t6, min(a.x0) AS x0, max(a.x1) AS x1, max(a.y1) AS y1,
       arg_min(a.y0, a.seq) AS y0, arg_min(a.page_number, a.seq) AS page_number,
       arg_min(a.font_size, a.seq) AS font_size, arg_min(a.font_family, a.seq) AS font_family,
       min(a.page_height) AS page_height
FROM {base}_alive a JOIN {base}_walk w USING (doc_id, seq) GROUP BY a.doc_id, w.head""")
    view(f"{base}_sig", f"{base}_para", f"""
SELECT *, trim(t6, {WS}) AS body, y1 <= page_height*0.2 AS top, y0 >= page_height*0.8 AS bot,
       round_even(x0/15, 0) AS sx, round_even(y0/15, 0) AS sy, round_even(font_size/0.5, 0) AS sf,
       regexp_matches(trim(t6, {WS}), '^(?i:\\d+|[ivxldcm]+|page\\s+\\d+|\\d+\\s+of\\s+\\d+)$') AS num
FROM {base}_para""")
    view(f"{base}_run", f"{base}_sig", f"""
SELECT s.*, CASE WHEN s.body = '' OR NOT (s.top OR s.bot) THEN NULL
                 WHEN s.num AND p.n >= 2 THEN 'PAGE_NUMBER' WHEN t.n >= 2 AND s.top THEN 'HEADER'
                 WHEN t.n >= 2 THEN 'FOOTER' END AS running_type
FROM {base}_sig s
LEFT JOIN (SELECT doc_id, lower(body) b, top, bot, sx, sy, sf, count(DISTINCT page_number) n FROM {base}_sig
           WHERE body <> '' AND (top OR bot) GROUP BY ALL) t
  ON t.doc_id=s.doc_id AND t.b=lower(s.body) AND t.top=s.top AND t.bot=s.bot AND t.sx=s.sx AND t.sy=s.sy AND t.sf=s.sf
LEFT JOIN (SELECT doc_id, top, bot, sx, sy, sf, count(DISTINCT page_number) n FROM {base}_sig
           WHERE num AND body <> '' AND (top OR bot) GROUP BY ALL) p
  ON p.doc_id=s.doc_id AND p.top=s.top AND p.bot=s.bot AND p.sx=s.sx AND p.sy=s.sy AND p.sf=s.sf""")

H = "CASE WHEN {c} <> '' THEN sha256({c}) END"


def _led(step, action, reason, cond, before, after, src, seq="seq"):
    return (f"SELECT doc_id, block_id, {seq} AS seq, '{step}' AS step_name, '{action}' AS action, {reason} AS reason, "
            f"{H.format(c=before)} AS original_hash, {H.format(c=after)} AS transformed_hash FROM {src} WHERE {cond}")


view("h_ledger", "h_soft h_run h_alive h_walk", "\nUNION ALL ".join([
    _led("UNICODE_NORMALIZER", "modified", "'unicode normalization'", "t0<>t1 AND t0<>''", "t0", "t1", "h_soft"),
    _led("CONTROL_CHARACTER_NORMALIZER", "modified", "'removed control characters'", "t1<>t2 AND t1<>''", "t1", "t2", "h_soft"),
    _led("WHITESPACE_NORMALIZER", "modified", "'whitespace normalization'", "t2<>t3 AND t2<>''", "t2", "t3", "h_soft"),
    _led("HYPHENATION_NORMALIZER", "modified", "'Repaired line-break hyphenation'", "t3<>t4 AND t3<>'' AND NOT absorbed", "t3", "t4", "h_soft"),
    _led("HYPHENATION_NORMALIZER", "deleted", "'Empty block after hyphen merge'", "absorbed", "t3", "''", "h_soft"),
    _led("PARAGRAPH_NORMALIZER", "modified", "'Removed soft line break'", "t4<>t5 AND t4<>'' AND NOT absorbed", "t4", "t5", "h_soft"),
    _led("PARAGRAPH_NORMALIZER", "deleted", "'Paragraph block merged into previous block'", "head<>seq", "t5", "''",
         "(SELECT a.*, w.head FROM h_alive a JOIN h_walk w USING (doc_id, seq))"),
    _led("PARAGRAPH_NORMALIZER", "modified", "'Merged paragraph'", "head<>seq", "before", "after",
         """(SELECT doc_id, seq, head, first_value(bid) OVER w AS block_id,
                    array_to_string(list(t5) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ' ') AS before,
                    array_to_string(list(t5) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ' ') AS after
             FROM (SELECT a.doc_id, a.seq, a.block_id AS bid, a.t5, w.head FROM h_alive a JOIN h_walk w USING (doc_id, seq))
             WINDOW w AS (PARTITION BY doc_id, head ORDER BY seq))""", seq="head"),
    _led("HEADER_FOOTER_NORMALIZER", "deleted",
         "CASE running_type WHEN 'PAGE_NUMBER' THEN 'Detected page number' WHEN 'HEADER' THEN 'Removed repeated header' ELSE 'Removed repeated footer' END",
         "running_type IS NOT NULL", "t6", "''", "h_run"),
    _led("EMPTY_BLOCK_NORMALIZER", "deleted", "'empty block removed'", f"running_type IS NULL AND trim(t6, {WS}) = ''", "t6", "''", "h_run"),
]))

SQL = {
    "normalize_unicode": build("w_s", "SELECT doc_id, block_id, t1 AS text FROM w_s"),
    "normalize_control": build("w_s", "SELECT doc_id, block_id, t2 AS text FROM w_s"),
    "normalize_whitespace": build("w_s", "SELECT doc_id, block_id, t3 AS text FROM w_s"),
    "normalize_hyphen": build("w_s", "SELECT doc_id, block_id, regexp_replace(t3, '([\\p{L}\\p{N}_]+)-\\n([\\p{L}\\p{N}_]+)', '\\1\\2', 'g') AS text FROM w_s"),
    "hyphen_cross_block": build("w_hy", "SELECT doc_id, block_id, t4 AS text FROM w_hy WHERE NOT absorbed"),
    "soft_line_breaks": build("w_soft", "SELECT doc_id, block_id, t5 AS text FROM w_soft WHERE NOT absorbed"),
    "paragraph_merge": build("w_para", "SELECT doc_id, block_id, t6 AS text, x0, y0, x1, y1 FROM w_para"),
    "running_headers_remove": build("h_run", "SELECT doc_id, block_id, t6 AS text FROM h_run WHERE running_type IS NULL"),
    "running_headers_classify": build("h_run", "SELECT doc_id, block_id, coalesce(running_type, 'PARAGRAPH') AS block_type FROM h_run"),
    "drop_empty": build("w_s", f"SELECT doc_id, block_id, t3 AS text FROM w_s WHERE trim(t3, {WS}) <> ''"),
    "normalize_all": build("h_run", f"""SELECT doc_id, block_id, t6 AS text, page_number,
        row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS seq
        FROM h_run WHERE running_type IS NULL AND trim(t6, {WS}) <> ''"""),
    "ledger": build("h_ledger", "SELECT * FROM h_ledger"),
    "stage_metrics": build("h_ledger h_soft h_para", """
        SELECT d.doc_id, s.step_name,
          count(*) FILTER (l.action='modified' AND l.reason NOT IN ('Merged paragraph'))
            + CASE WHEN s.step_name='PARAGRAPH_NORMALIZER' THEN (SELECT count(*) FROM h_para p WHERE p.doc_id=d.doc_id AND p.parts>1) ELSE 0 END AS modified,
          count(*) FILTER (l.action='deleted') AS removed,
          count(*) FILTER (l.action='deleted' AND s.step_name='PARAGRAPH_NORMALIZER') AS merged
        FROM (SELECT DISTINCT doc_id FROM h_soft) d
        CROSS JOIN (SELECT unnest(['UNICODE_NORMALIZER','CONTROL_CHARACTER_NORMALIZER','WHITESPACE_NORMALIZER',
            'HYPHENATION_NORMALIZER','PARAGRAPH_NORMALIZER','HEADER_FOOTER_NORMALIZER','EMPTY_BLOCK_NORMALIZER']) AS step_name) s
        LEFT JOIN h_ledger l ON l.doc_id=d.doc_id AND l.step_name=s.step_name GROUP BY d.doc_id, s.step_name"""),
    "stage_snapshots": build("h_soft h_para h_run", f"""
        SELECT doc_id, block_id, 'UNICODE_NORMALIZER' AS step_name, t1 AS text FROM h_soft
        UNION ALL SELECT doc_id, block_id, 'CONTROL_CHARACTER_NORMALIZER', t2 FROM h_soft
        UNION ALL SELECT doc_id, block_id, 'WHITESPACE_NORMALIZER', t3 FROM h_soft
        UNION ALL SELECT doc_id, block_id, 'HYPHENATION_NORMALIZER', t4 FROM h_soft WHERE NOT absorbed
        UNION ALL SELECT doc_id, block_id, 'PARAGRAPH_NORMALIZER', t6 FROM h_para
        UNION ALL SELECT doc_id, block_id, 'HEADER_FOOTER_NORMALIZER', t6 FROM h_run WHERE running_type IS NULL
        UNION ALL SELECT doc_id, block_id, 'EMPTY_BLOCK_NORMALIZER', t6 FROM h_run WHERE running_type IS NULL AND trim(t6, {WS}) <> ''"""),
}
