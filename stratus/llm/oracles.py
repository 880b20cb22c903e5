"""DuckDB SQL for the operators that SQL can express, over the same tables."""



OP6 = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[s:s + least(13, len(ws)) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS s FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT doc_id, item_id, s, n FROM dw JOIN bw USING (n, win)),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP4 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[s:s + 2], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS s FROM d WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sh a JOIN sh b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * common.n >= 85 * (x.n + y.n - common.n)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b)
SELECT d.doc_id, CAST(coalesce(any_value(size.n), 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN size ON size.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
win AS (
  SELECT doc_id, s, md5(array_to_string(ws[s:s + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM d WHERE len(ws) >= 50)),
own AS (SELECT h, min(doc_id) AS lo FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (
  SELECT doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN own USING (h) WHERE doc_id > lo) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN ps IS NULL THEN array_to_string(ws, ' ')
              ELSE array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda p: NOT list_contains(ps, p)), lambda p: ws[p]), ' ') END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

OP5 = r"""
WITH asked AS (
  SELECT conv_id, turn, 'call_' || turn AS call_id, text, CASE role WHEN 'user' THEN 'reply' ELSE 'configure' END AS tool
  FROM conversations WHERE role IN ('user', 'system')),
answer AS (SELECT conv_id, turn, 'call_' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant'),
calls AS (
  SELECT a.conv_id, a.call_id, a.turn AS place, 'call' AS kind, CASE WHEN r.turn IS NULL THEN 'open' ELSE 'linked' END AS status,
         a.turn AS place_after, CAST(0 AS BIGINT) AS depth, a.tool, coalesce(length(a.text), 0) > 0 AS valid,
         CASE WHEN coalesce(length(a.text), 0) > 0 THEN ''
              ELSE CASE a.tool WHEN 'reply' THEN 'prompt' ELSE 'instructions' END || CASE WHEN a.text IS NULL THEN ': missing' ELSE ': too short' END
         END AS errors, coalesce(r.turn, -1) AS answered_at,
         '{"arguments":{' || CASE WHEN a.text IS NULL THEN '' ELSE CASE a.tool WHEN 'reply' THEN '"prompt":' ELSE '"instructions":' END
         || CAST(to_json(a.text) AS VARCHAR) || ',' END || '"turn":' || a.turn || '},"id":"' || a.call_id || '","name":"' || a.tool
         || '","result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || '}' AS message
  FROM asked a LEFT JOIN answer r USING (conv_id, call_id)),
orphan AS (
  SELECT conv_id, call_id, turn AS place, 'result' AS kind, 'orphan' AS status, turn AS place_after, CAST(0 AS BIGINT) AS depth,
         CAST(NULL AS VARCHAR) AS tool, false AS valid, '' AS errors, CAST(-1 AS BIGINT) AS answered_at, CAST(NULL AS VARCHAR) AS message
  FROM answer ANTI JOIN asked USING (conv_id, call_id))
SELECT * FROM calls UNION ALL SELECT * FROM orphan
"""

# Unsigned crc32 of the decimal text of a whole number, bit by bit.
_CRC = """(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))))"""
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"

OP13 = """
WITH RECURSIVE leaf AS (
  SELECT doc_id, lang, sha256({doc_id} || {source} || {lang} || {n_chars} || {text}) AS h,
         CASE WHEN doc_id IS NOT NULL AND {crc} % 7 = 0 THEN sha256({doc_id} || {source} || {lang} || {changed} || {text})
              ELSE sha256({doc_id} || {source} || {lang} || {n_chars} || {text}) END AS shown
  FROM (SELECT *, n_chars + 1 AS n_more FROM documents)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) AS k FROM leaf),
node(k, l, i, n, h) AS (
  SELECT k, 0, i, n, h FROM placed
  UNION ALL
  SELECT k, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY k, l, i // 2, n),
subroot AS (SELECT k, l AS height, h AS subroot, k - 1 AS j, count(*) OVER () AS kinds FROM node WHERE n = 1),
upper(l, i, n, h) AS (
  SELECT 0, j, kinds, subroot FROM subroot
  UNION ALL
  SELECT l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY l, i // 2, n),
root AS (SELECT h FROM upper WHERE n = 1),
step AS (
  SELECT p.k, p.i, node.l, (p.i >> node.l) % 2 AS side, s.h AS sibling
  FROM placed p JOIN node ON node.k = p.k AND node.i = p.i >> node.l AND node.n > 1
  LEFT JOIN node s ON s.k = p.k AND s.l = node.l AND s.i = xor(node.i, 1)
  UNION ALL
  SELECT p.k, p.i, r.height + u.l, (r.j >> u.l) % 2, s.h
  FROM placed p JOIN subroot r ON r.k = p.k JOIN upper u ON u.i = r.j >> u.l AND u.n > 1
  LEFT JOIN upper s ON s.l = u.l AND s.i = xor(u.i, 1)),
folded(k, i, l, h) AS (
  SELECT k, i, 0, shown FROM placed
  UNION ALL
  SELECT f.k, f.i, f.l + 1, sha256(CASE WHEN sibling IS NULL THEN f.h WHEN side = 0 THEN f.h || sibling ELSE sibling || f.h END)
  FROM folded f JOIN step USING (k, i, l)),
proof AS (SELECT k, i, sha256(coalesce(string_agg(sibling, '' ORDER BY l), '')) AS proof_sha256 FROM step GROUP BY k, i),
top AS (SELECT k, i, arg_max(h, l) AS folded_root FROM folded GROUP BY k, i)
SELECT p.doc_id, p.h AS leaf, r.subroot, root.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
       folded_root = root.h AS verified
FROM placed p JOIN subroot r USING (k) JOIN top USING (k, i) LEFT JOIN proof USING (k, i), root
""".format(crc=_CRC.format("doc_id"), changed=_FIELD.format("n_more"),
           **{c: _FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text")})

OP12 = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS q, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT conv_id, conv_id - conv_id % 5 AS donor, {crc} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
line AS (
  SELECT c.conv_id, t.q, t.role, t.text FROM conv c JOIN turns t ON t.conv_id = c.donor AND t.q <= c.h
  UNION ALL
  SELECT c.conv_id, 1000000 + t.q, t.role, t.text FROM conv c JOIN turns t ON t.conv_id = c.conv_id AND t.q > c.h),
step AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(md5(length(role) || ':' || role || text), '') OVER w AS path, strlen(text) AS bytes
  FROM line WINDOW w AS (PARTITION BY conv_id ORDER BY q ROWS UNBOUNDED PRECEDING)
  UNION ALL
  SELECT conv_id, 0, '', 0 FROM conv),
len AS (SELECT conv_id, max(depth) AS n FROM step GROUP BY conv_id),
node AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM step GROUP BY depth, path),
kids AS (SELECT depth - 1 AS depth, left(path, CAST(32 * (depth - 1) AS BIGINT)) AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
below AS (
  SELECT a.depth, left(a.path, CAST(32 * a.depth AS BIGINT)) AS path, sum(leaf) AS n_leaves, sum(saved) AS saved
  FROM (SELECT unnest(range(0, node.depth + 1)) AS depth, node.path, CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * bytes AS saved
        FROM node LEFT JOIN kids ON kids.depth = node.depth AND kids.path = node.path) a GROUP BY 1, 2),
done AS (
  SELECT s.depth, s.path, string_agg(CAST(s.conv_id AS VARCHAR), ',' ORDER BY s.conv_id) AS ids
  FROM step s JOIN len ON len.conv_id = s.conv_id AND len.n = s.depth GROUP BY s.depth, s.path)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN below USING (depth, path) LEFT JOIN kids USING (depth, path) LEFT JOIN done USING (depth, path)
LEFT JOIN node up ON up.depth = node.depth - 1 AND up.path = left(node.path, CAST(32 * (node.depth - 1) AS BIGINT)) AND node.depth > 0
""".format(crc=_CRC.format("conv_id"))

OP11 = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hexed FROM pages),
first AS (SELECT hexed, min(page_id) AS least FROM p GROUP BY hexed),
digest AS (
  SELECT hexed, least, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((CAST('0x' || substr(hexed, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31), 1)), '') AS payload_digest
  FROM first)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN least IS NOT NULL AND page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM p JOIN digest USING (hexed)
"""
