"""SQL of the text operators' queries, where SQL can say the whole result."""

#: crc32 of the decimal text of ``{0}``, of which DuckDB has no function: eight shifts for each entry of the table.
CRC_TABLE = """
crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
              lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i))"""


def crc32(column: str) -> str:
    chars = f"list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {chars}), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295)"


def field(expression: str) -> str:
    text = f"CAST({expression} AS VARCHAR)"
    return f"coalesce(CAST(octet_length(encode({text})) AS VARCHAR) || ':' || {text}, '-')"


def leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"


OP4 = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)"""

OP11 = f"""
WITH RECURSIVE {CRC_TABLE},
digests AS (
  SELECT doc_id, lang, {leaf("n_chars")} AS leaf,
         CASE WHEN {crc32("doc_id")} % 7 = 0 THEN {leaf("n_chars + 1")} ELSE {leaf("n_chars")} END AS claimed
  FROM documents, crc),
leaves AS (
  SELECT doc_id, leaf, claimed, row_number() OVER () AS k, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM digests),
low AS (
  SELECT g, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT g, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY g, level, n, i // 2),
high AS (
  SELECT 0 AS level, g AS i, (SELECT count(*) FROM low WHERE n = 1) AS n, h FROM low WHERE n = 1
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, n, i // 2),
steps AS (
  SELECT k, me.level AS step, me.i % 2 AS odd, other.h AS sibling
  FROM leaves l JOIN low me ON me.g = l.g AND me.i = l.i // (1 << me.level) AND me.n > 1
  LEFT JOIN low other ON other.g = me.g AND other.level = me.level AND other.i = xor(me.i, 1)
  UNION ALL
  SELECT k, 100 + me.level, me.i % 2, other.h
  FROM leaves l JOIN high me ON me.i = l.g // (1 << me.level) AND me.n > 1
  LEFT JOIN high other ON other.level = me.level AND other.i = xor(me.i, 1)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY step) AS s FROM steps),
folded AS (
  SELECT k, CAST(0 AS BIGINT) AS s, claimed AS h FROM leaves
  UNION ALL
  SELECT f.k, f.s + 1, sha256(CASE WHEN odd = 1 THEN coalesce(sibling, '') || h ELSE h || coalesce(sibling, '') END)
  FROM folded f JOIN numbered d ON d.k = f.k AND d.s = f.s + 1),
ends AS (SELECT k, max_by(h, s) AS h FROM folded GROUP BY k),
proofs AS (SELECT k, sha256(string_agg(coalesce(sibling, ''), '' ORDER BY s)) AS p FROM numbered GROUP BY k)
SELECT doc_id, leaf, (SELECT h FROM low WHERE low.g = l.g AND n = 1) AS subroot, (SELECT h FROM high WHERE n = 1) AS root,
       coalesce(p, sha256('')) AS proof_sha256, ends.h AS folded_root, ends.h = (SELECT h FROM high WHERE n = 1) AS verified
FROM leaves l JOIN ends USING (k) LEFT JOIN proofs USING (k)"""

OP12 = f"""
WITH {CRC_TABLE},
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS t
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {crc32("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc),
parts AS (
  SELECT c.conv_id, 0 AS own, t, role, text FROM convs c JOIN turns b ON b.conv_id = c.conv_id - c.conv_id % 20 AND t <= h
  UNION ALL
  SELECT c.conv_id, 1, t, role, text FROM convs c JOIN turns b ON b.conv_id = c.conv_id AND t > h),
labelled AS (
  SELECT conv_id, row_number() OVER w AS depth, sha256(octet_length(encode(role)) || ':' || role || text) AS label,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY own, t)),
prefixes AS (
  SELECT conv_id, depth, words, string_agg(label, '') OVER (PARTITION BY conv_id ORDER BY depth) AS p FROM labelled
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
ended AS (
  SELECT p, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends
  FROM (SELECT conv_id, max_by(p, depth) AS p FROM prefixes GROUP BY conv_id) GROUP BY p),
node AS (SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words FROM prefixes GROUP BY p, depth),
up AS (
  SELECT c.*, a.p AS parent, a.conv_id AS parent_conv_id FROM node c
  LEFT JOIN prefixes x ON x.conv_id = c.conv_id AND x.depth = c.depth - 1
  LEFT JOIN node a ON a.p = x.p AND a.depth = x.depth),
kids AS (SELECT parent, count(*) AS children FROM up WHERE parent IS NOT NULL GROUP BY parent),
sums AS (
  SELECT x.p, sum((d.n - 1) * d.words) AS saved, count(*) FILTER (WHERE kids.children IS NULL) AS leaves
  FROM node d JOIN prefixes x ON x.conv_id = d.conv_id AND x.depth <= d.depth LEFT JOIN kids ON kids.parent = d.p GROUP BY x.p)
SELECT conv_id, depth, parent_conv_id, n AS n_convs, coalesce(children, 0) AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM up JOIN sums USING (p) LEFT JOIN kids ON kids.parent = up.p LEFT JOIN ended ON ended.p = up.p"""
