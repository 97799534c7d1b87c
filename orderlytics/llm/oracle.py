"""The text operators as SQL for a second engine, where SQL can express them."""

UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP4 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT r, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM docs),
keyed AS (
  SELECT *, translate(trim(line, {BLANKS}), {UPPER}, {LOWER}) AS k FROM lines),
common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
kept AS (
  SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS body
  FROM keyed WHERE k NOT IN (SELECT k FROM common) GROUP BY r)
SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_lines,
       CAST(len(parts) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), {u}, {l}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(
    u=UPPER, l=LOWER
)

OP8 = f"""
WITH items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS} AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item, least(len(w), 13) AS n,
         array_to_string(w[s + 1 : s + least(len(w), 13)], ' ') AS p
  FROM (SELECT *, unnest(range(greatest(len(w) - 12, 1))) AS s FROM items WHERE len(w) > 0)),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
runs AS (
  SELECT r, n, s, array_to_string(w[s + 1 : s + n], ' ') AS p
  FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS s
        FROM docs, (SELECT DISTINCT n FROM patterns) WHERE len(w) >= n)),
found AS (
  SELECT r, s, runs.n AS n, item FROM runs JOIN patterns USING (n, p)),
hits AS (
  SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS spot FROM found) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""

CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
    lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

OP11 = f"""
WITH rows AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT c, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST,
                 sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text)) AS ts
  FROM rows GROUP BY c),
heads AS (
  SELECT c, ts, c - ((c % 5) + 5) % 5 AS base, {CRC32.format(x="c")} % 9 AS h FROM turns),
rebuilt AS (
  SELECT own.c, list_concat(coalesce(first.ts[1 : h], []), own.ts[h + 1 :]) AS ts
  FROM heads AS own LEFT JOIN turns AS first ON first.c = own.base),
paths AS (
  SELECT c, d, ts[1 : d] AS p, len(ts) = d AS ends FROM (SELECT *, unnest(range(len(ts) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT p, any_value(d) AS d, min(c) AS conv_id, count(*) AS n,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM paths GROUP BY p),
children AS (
  SELECT p[1 : d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN d = 0 THEN 0 ELSE (n - 1) * strlen(p[d].text) END AS saved
  FROM nodes LEFT JOIN children USING (p)),
subtrees AS (
  SELECT p[1 : e] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS e FROM full_nodes) GROUP BY ALL)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, v.n AS n_convs,
       CAST(v.n_children AS BIGINT) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens,
       v.ends_sha256
FROM full_nodes AS v JOIN subtrees AS s USING (p)
LEFT JOIN nodes AS parent ON v.d > 0 AND parent.p = v.p[1 : v.d - 1]
"""

OP12 = """
WITH hashed AS (
  SELECT row_number() OVER () AS r, page_id, strlen(coalesce(html, '')) AS payload_bytes,
         sha1(coalesce(html, '')) AS h, coalesce(html, '') AS body FROM pages),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY page_id DESC NULLS LAST, r) AS nth,
         max(page_id) OVER (PARTITION BY body) AS first FROM hashed)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31
                  AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nth > 1 THEN first END AS refers_to
FROM ranked
"""

ORACLES = {
    "op4_line_dedup": OP4,
    "op8_benchmark_decontamination": OP8,
    "op11_conversation_trie": OP11,
    "op12_warc": OP12,
}
