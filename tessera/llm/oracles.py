"""DuckDB SQL for the queries that SQL can express; written from the contracts, not from the operators' code."""

SQL: dict[str, str] = {}

SQL["op3_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-7::BIGINT, 1::BIGINT, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '([<\[])(\|turn\|>|\|end\|>|\|im_start\|>|\|im_end\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])', '\1\\\2', 'g')) AS n FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum(8 + length(role) + 1 + n + 8) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM g
"""

SQL["op8_quality"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
pos AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
win AS (
  SELECT doc_id, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS d, lead(word, 4) OVER o AS e
  FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY i)
),
rep AS (
  SELECT doc_id, i FROM win WHERE e IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY doc_id, word, b, c, d, e) >= 2
),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id),
ln AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, source, text, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, line, count(*) AS c FROM lw GROUP BY ALL) GROUP BY doc_id),
nl AS (
  SELECT doc_id, source, text, translate(array_to_string(words, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line, sum(len(words)) AS words
  FROM lw GROUP BY ALL
),
hl AS (SELECT source, line, count(DISTINCT text) AS n, min(doc_id) AS first_id FROM nl GROUP BY source, line),
al AS (SELECT line, sum(n) AS n, min(first_id) AS first_id FROM hl GROUP BY line),
cm AS (
  SELECT hl.source, hl.line, CASE WHEN al.n >= 50 THEN al.first_id ELSE hl.first_id END AS first_id
  FROM hl JOIN al USING (line) WHERE hl.n >= 20 OR al.n >= 50
),
lost AS (
  SELECT doc_id, sum(words) AS n FROM nl JOIN cm ON nl.line = cm.line AND nl.source IS NOT DISTINCT FROM cm.source
  WHERE doc_id <> first_id GROUP BY doc_id
),
s AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND removed_words <= 0.5 * n_words AS kept, removed_words
FROM s
"""

SQL["op10_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS place
  FROM documents
),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS turn
  FROM d GROUP BY source
),
l AS (SELECT *, source_size * 2.0::DOUBLE AS lim, source_size * 2.0::DOUBLE / weight AS level FROM s),
f AS (
  SELECT *, (least(sum(source_size) OVER () * 1.5::DOUBLE, sum(lim) OVER ()) - coalesce(sum(lim) OVER (ORDER BY level, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY level, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM l
),
t AS (
  SELECT source, source_size, CASE WHEN rate >= level THEN lim ELSE weight * (SELECT arg_min(rate, (level, turn)) FROM f WHERE rate < level) END AS target FROM f
),
q AS (
  SELECT d.*, t.source_size, t.target, row_number() OVER o AS nth, sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY d.source, place >> 50 ORDER BY place, doc_id, size)
),
e AS (
  SELECT q.*, r.round, (upto + r.round * source_size)::DOUBLE / nullif(target, 0) AS finish FROM q, (VALUES (0), (1)) r(round) WHERE size > 0
),
m AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, place, doc_id, nth, round ROWS UNBOUNDED PRECEDING) AS total FROM e),
k AS (SELECT doc_id, source, place, nth, sum(size) AS taken FROM m WHERE total <= (SELECT sum(target) FROM t) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM q LEFT JOIN k ON q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.source IS NOT DISTINCT FROM k.source AND q.place = k.place AND q.nth = k.nth
"""

SQL["op1_warc_index"] = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, octet_length(encode(html)) AS n, max(page_id) AS first_id FROM p GROUP BY ALL),
b AS (
  SELECT p.*, f.n, f.first_id,
    array_to_string(list_transform(string_split(p.sha, ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][('0x' || c)::INT + 1]), '') AS bits
  FROM p JOIN f USING (sha)
)
SELECT page_id, url, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(bits, i * 5 + 1, 1)::INT + 8 * substr(bits, i * 5 + 2, 1)::INT + 4 * substr(bits, i * 5 + 3, 1)::INT + 2 * substr(bits, i * 5 + 4, 1)::INT + substr(bits, i * 5 + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""

# The CRC's table is made from its polynomial; a step takes the low byte of the state.
SQL["op5_sharding"] = r"""
WITH RECURSIVE t(i, k, v) AS (
  SELECT i, 0, i FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM t WHERE k < 8
),
crc AS (SELECT list(v ORDER BY i) AS tab FROM t WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (
  SELECT doc_id, octet_length(encode(text)) + 16 AS size,
    xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT), lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1]), 4294967295::BIGINT)) AS text_crc32
  FROM d, crc
),
s AS (
  SELECT doc_id, arg_max(s, u) FILTER (s < 40) AS shard, arg_max(s, u) AS grown_shard
  FROM (SELECT doc_id, s, ('0x' || substr(md5(doc_id || ':' || s), 1, 13))::BIGINT AS u FROM (SELECT DISTINCT doc_id FROM d), (SELECT unnest(range(41)) AS s)) GROUP BY doc_id
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY md5('slot:' || doc_id || ':' || text_crc32 || ':' || size), doc_id, text_crc32, size) - 1 AS slot, grown_shard::INT AS grown_shard
FROM c JOIN s USING (doc_id)
"""

SQL["op12_fill_in_middle"] = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS hex FROM documents),
d AS (
  SELECT doc_id, text, length(text) AS n, [('0x' || substr(hex, 1 + 8 * i, 8))::BIGINT FOR i IN [0, 1, 2, 3]] AS h FROM h
),
c AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
),
p AS (SELECT *, substring(text, 1, a) AS first, substring(text, a + 1, b - a) AS middle, substring(text, b + 1, n - b) AS last FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || first || '<S>' || last || '<M>' || middle ELSE '<S>' || last || '<P>' || first || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

# Two words are one edit apart if they are equal without their i-th characters, or one is the other without a character.
SQL["op13_spelling_variants"] = r"""
WITH RECURSIVE t(i, k, v) AS (
  SELECT i, 0, i FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM t WHERE k < 8
),
crc AS (SELECT list(v ORDER BY i) AS tab FROM t WHERE k = 8),
r AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL
),
h AS (
  SELECT run, n, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda h: ('0x' || h)::BIGINT), lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1]), 4294967295::BIGINT)) AS h
  FROM r, crc
),
v AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING sum(v.n) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS part FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
e AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, d.n, w.word, w.n FROM d JOIN w ON d.part = w.word
  UNION SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON d.part = w.word
),
f AS (SELECT word, any_value(n) AS n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM e GROUP BY word),
g AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM w LEFT JOIN f USING (word)),
c(word, now) AS (SELECT word, word FROM g UNION ALL SELECT c.word, g.form FROM c JOIN g ON g.word = c.now WHERE g.form IS NOT NULL)
SELECT g.word, g.form, c.now AS root, g.n, g.n_near::BIGINT AS n_near, g.form_n FROM g JOIN c USING (word) JOIN g l ON l.word = c.now AND l.form IS NULL
"""
