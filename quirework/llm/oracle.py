"""DuckDB SQL for the registered queries that SQL can express, written from their contracts."""

WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

SQL = {
    "op3_chat_round_trip": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, length('<|im_start|>') + length(role) + 1
    + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length('<|im_end|>') + 1 AS written
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(written)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
""",
    "op8_partenum_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r USING (doc_id) GROUP BY d.doc_id, n.n
""",
    "op10_repeated_windows": f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)
), f AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, i + o AS j FROM (SELECT doc_id, i FROM win JOIN f USING (k) WHERE f < doc_id), range(50) t(o)
), kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.j) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w) p ANTI JOIN gone USING (doc_id, j) GROUP BY p.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op11_periodic_runs": f"""
WITH RECURSIVE step(crc, b, k) AS (
  SELECT b, b, 0 FROM range(256) t(b)
  UNION ALL SELECT CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, b, k + 1 FROM step WHERE k < 8
), t AS (SELECT b, crc AS v FROM step WHERE k = 8
), c(doc_id, rest, crc) AS (
  SELECT doc_id, doc_id::VARCHAR, 4294967295::BIGINT FROM documents
  UNION ALL SELECT doc_id, rest[2:], xor(c.crc >> 8, t.v) FROM c JOIN t ON t.b = xor(c.crc & 255, ascii(rest)) WHERE rest <> ''
), h AS (SELECT doc_id, xor(crc, 4294967295) AS h, xor(crc, 4294967295) // 10 AS g FROM c WHERE rest = ''
), w0 AS (SELECT doc_id, {WORDS} AS ws FROM documents
), w1 AS (SELECT w0.*, len(ws) AS n, h, g, CASE WHEN len(ws) > 0 THEN g % len(ws) END AS a FROM w0 JOIN h USING (doc_id)
), w2 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM w1
), w AS (
  SELECT doc_id, i, ws[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM w2)
), same AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i
), isles AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM same
), runs AS (
  SELECT doc_id, s, l, min(q) AS q FROM (
    SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM isles GROUP BY doc_id, q, isle HAVING count(*) + q >= greatest(12, 2 * q)
  ) GROUP BY doc_id, s, l
), gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs
), kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), r AS (
  SELECT doc_id, count(*) AS n_runs, min(struct_pack(a := -l, b := s, c := q)) AS best,
    string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines
  FROM runs GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.b::BIGINT AS start, (-best.a)::BIGINT AS length, best.c::BIGINT AS period,
  (1000 * -best.a // best.c)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op12_spelling_variants": r"""
WITH RECURSIVE step(crc, b, k) AS (
  SELECT b, b, 0 FROM range(256) t(b)
  UNION ALL SELECT CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, b, k + 1 FROM step WHERE k < 8
), t AS (SELECT b, crc AS v FROM step WHERE k = 8
), found AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM documents) GROUP BY doc_id, run
), keyed AS (SELECT *, row_number() OVER () AS id, hex(encode(doc_id || ':' || run)) AS bytes FROM found
), c(id, pos, crc) AS (
  SELECT id, 1, 4294967295::BIGINT FROM keyed
  UNION ALL SELECT c.id, c.pos + 2, xor(c.crc >> 8, t.v) FROM c JOIN keyed USING (id)
    JOIN t ON t.b = xor(c.crc & 255, ('0x' || substr(bytes, c.pos, 2))::BIGINT) WHERE c.pos <= length(bytes)
), h AS (SELECT id, xor(crc, 4294967295) AS h FROM c JOIN keyed USING (id) WHERE pos > length(bytes)
), w AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, times FROM keyed JOIN h USING (id)
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), cut AS (SELECT word, i, word[:i - 1] AS a, word[i + 1:] AS b FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)
), near AS (
  SELECT x.word, y.word AS near FROM cut x JOIN cut y ON x.a = y.a AND x.b = y.b WHERE x.word <> y.word
  UNION SELECT cut.word, w.word FROM cut JOIN w ON cut.a || cut.b = w.word
  UNION SELECT w.word, cut.word FROM cut JOIN w ON cut.a || cut.b = w.word
), best AS (
  SELECT near.word, count(*) AS n_near, min(struct_pack(a := -w.n, b := encode(near))) AS best FROM near JOIN w ON w.word = near.near GROUP BY near.word
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.a >= 10 * w.n THEN decode(best.b) END AS form,
    CASE WHEN -best.a >= 10 * w.n THEN -best.a END::BIGINT AS form_n
  FROM w LEFT JOIN best USING (word)
), walk(word, root) AS (
  SELECT word, word FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n
FROM f JOIN walk USING (word) JOIN f last ON last.word = walk.root WHERE last.form IS NULL
""",
    "op13_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k)::BIGINT AS group_size,
  row_number() OVER w = 1 AS kept, sha256(k) AS text_sha256
FROM t WINDOW w AS (PARTITION BY k ORDER BY n DESC, doc_id)
""",
}
