"""DuckDB SQL that gives the rows of the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op9_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
classed AS (
  SELECT *, CAST(floor(log2(greatest(size, 1))) AS INT) AS lg FROM sized),
celled AS (
  SELECT *, lg * 16 + least(15, CAST(floor((size / pow(2.0, lg) - 1) * 16) AS INT)) AS class, ((coalesce(doc_id, 0) % 256) + 256) % 256 AS bucket FROM classed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, bucket, size, doc_id NULLS FIRST) AS place FROM celled),
per AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, CASE (k - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2 * source_size AS cap FROM per),
levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lvl FROM weighted),
targets AS (
  SELECT source, source_size, CASE WHEN lvl * w >= cap THEN CAST(cap AS DOUBLE) ELSE w * (SELECT arg_min(lvl, cap / w) FROM levels WHERE lvl * w < cap) END AS target FROM levels),
rated AS (
  SELECT p.doc_id, p.size, t.source_size, t.target, p.place, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(('0x' || substr(md5('mix:' || coalesce(p.source, '')), 1, 8)) AS BIGINT) / 4294967296.0 AS u
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
  CAST(size * least(2, floor(place * rate + u) - floor((place - 1) * rate + u)) AS BIGINT) AS taken FROM rated
"""

#: Brute force: every pair of different lines that share their first or last half is held against the bound. Letters of
#: scripts without blanks count as words; lines under six words fall to equal ones only.
SQL["op3_line_dedup"] = r"""
WITH split AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
worded AS (
  SELECT doc_id, no, line, regexp_extract_all(regexp_replace(line, '[\x{e00}-\x{eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{3005}-\x{3007}\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{ff66}-\x{ff9f}\x{20000}-\x{323af}]', ' \0 ', 'g'), '[^\x20\x09-\x0D]+') AS words FROM split),
firsts AS (
  SELECT words, len(words) AS w, min({'d': doc_id, 'n': no}) AS spot FROM worded WHERE len(words) >= 1 GROUP BY words),
halved AS (
  SELECT *, unnest([{'b': w, 's': 0, 'h': words[1:w // 2]}, {'b': w, 's': 1, 'h': words[w // 2 + 1:]},
    {'b': w - 1, 's': 0, 'h': words[1:(w - 1) // 2]}, {'b': w - 1, 's': 1, 'h': words[w - (w - 1 - (w - 1) // 2) + 1:]}]) AS k FROM firsts WHERE w >= 6),
near AS (
  SELECT DISTINCT a.spot FROM halved a JOIN halved b ON a.k = b.k AND b.spot < a.spot
  WHERE (a.w = b.w AND len(list_filter(list_zip(a.words, b.words), lambda p: p[1] <> p[2])) = 1)
    OR (a.w = b.w + 1 AND len(list_filter(range(1, a.w + 1), lambda i: list_concat(a.words[1:i - 1], a.words[i + 1:]) = b.words)) > 0)
    OR (b.w = a.w + 1 AND len(list_filter(range(1, b.w + 1), lambda i: list_concat(b.words[1:i - 1], b.words[i + 1:]) = a.words)) > 0)),
stay AS (
  SELECT s.doc_id, s.no, s.line FROM worded s WHERE len(s.words) = 0
  UNION ALL
  SELECT s.doc_id, s.no, s.line FROM worded s JOIN firsts f ON f.spot = {'d': s.doc_id, 'n': s.no} WHERE f.spot NOT IN (SELECT spot FROM near)),
rebuilt AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS text, count(*) AS n FROM stay GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(r.text, '') END AS text, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(string_split(d.text, chr(10))) - coalesce(r.n, 0), 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN rebuilt r ON d.doc_id = r.doc_id
"""

SQL["op4_warc"] = r"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
keepers AS (
  SELECT html, max(page_id) AS keeper FROM payloads GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS INT), 1) FOR i IN range(32)], 'string_agg', '') AS payload_digest,
  CASE WHEN keeper > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keeper > page_id THEN keeper END AS refers_to
FROM payloads p JOIN keepers k ON p.html = k.html
"""

#: Every order and step counted from the sets of failed filters, and the values summed over all orders.
SQL["op12_filter_audit"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
least AS (
  SELECT text, min(doc_id) AS first_id FROM docs GROUP BY text),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT d.part, (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * len(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 10 * len(d.text) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN d.doc_id > l.first_id THEN 16 ELSE 0 END) AS mask, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic
  FROM docs d JOIN least l ON l.text = d.text LEFT JOIN marks m ON m.doc_id = d.doc_id),
sets AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, mask),
f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE (a.b | b.b | c.b | d.b | e.b) = 31),
steps AS (
  SELECT filter_order, unnest(range(1, 6)) AS step, bits FROM orders),
cuts AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS before FROM steps),
counted AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (CAST(before AS INT) | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & CAST(before AS INT) = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & CAST(before AS INT) <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & CAST(before AS INT) = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & CAST(before AS INT) = 0), 0) AS toxic_lost
  FROM sets, cuts GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM counted
"""

#: Every prefix as a list of its turns.
SQL["op13_conversation_trie"] = r"""
WITH numbered AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(t ORDER BY k) AS ts FROM numbered GROUP BY conv_id),
bits AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s FROM own),
crc AS (
  SELECT conv_id, (~list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(s) + 1), lambda i: CAST(ascii(substr(s, i, 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) & 4294967295 AS crc FROM bits),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.ts[1:c.crc % 6], []), o.ts[c.crc % 6 + 1:]) AS ts FROM own o JOIN crc c ON c.conv_id = o.conv_id LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
paths AS (
  SELECT conv_id, unnest(range(0, len(ts) + 1)) AS depth, ts FROM rebuilt),
nodes AS (
  SELECT ts[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN len(ts) = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM paths GROUP BY path, depth),
kids AS (
  SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
own_sums AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * len(n.path[-1].text) ELSE 0 END AS own FROM nodes n LEFT JOIN kids k ON k.path = n.path),
above AS (
  SELECT path[1:d] AS path, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT path, own, n_children, unnest(range(0, depth + 1)) AS d FROM own_sums) GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, a.n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM own_sums n JOIN above a ON a.path = n.path LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""
