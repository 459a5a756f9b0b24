"""SQL (DuckDB) for the registered queries that SQL can state."""

from __future__ import annotations

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

URL_FILTER = f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES
  ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut),
named AS (
  SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') AS canonical FROM parts),
listed AS (SELECT DISTINCT canonical FROM named WHERE regexp_matches(url, 'cheap-pills|ads-track') AND host <> ''),
fits AS (
  SELECT n.page_id, n.host, n.path, r.rule_host || r.rule_path AS rule, r.verdict, n.host <> '' AND l.canonical IS NOT NULL AS listed,
         row_number() OVER (PARTITION BY n.page_id ORDER BY length(r.rule_host) + length(r.rule_path) DESC NULLS LAST) AS place
  FROM named n
  LEFT JOIN rules r ON (n.host = r.rule_host OR suffix(n.host, '.' || r.rule_host)) AND starts_with(n.path, r.rule_path)
  LEFT JOIN listed l ON l.canonical = n.canonical)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM fits WHERE place = 1
"""

BENCHMARK_HITS = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM item_words WHERE len(w) > 0)),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM words),
sizes AS (SELECT DISTINCT size FROM item_windows),
hits AS (
  SELECT p.doc_id, p.k, i.size, i.item_id
  FROM (SELECT doc_id, k, size, array_to_string(w[k : k + size - 1], ' ') AS key FROM places, sizes WHERE k + size - 1 <= len(w)) p
  JOIN item_windows i USING (size, key)),
hit_words AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS word FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

QUALITY_RULES = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM base),
sizes(n, most) AS (VALUES (3, NULL), (5, 15), (6, 14), (7, 13), (8, 12), (9, 11), (10, 10)),
keyed AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM base), sizes WHERE k + n - 1 <= len(w)),
grams AS (
  SELECT doc_id, n, k, count(*) OVER (PARTITION BY doc_id, n, gram) AS times, row_number() OVER (PARTITION BY doc_id, n, gram ORDER BY k) AS nth
  FROM keyed),
covered AS (SELECT DISTINCT doc_id, n, unnest(range(k, k + n)) AS k FROM grams WHERE times > 1 AND (n = 3 OR nth > 1)),
cover AS (SELECT doc_id, n, count(*) AS words, sum(length(word)) AS chars FROM covered JOIN places USING (doc_id, k) GROUP BY ALL),
lines AS (
  SELECT doc_id, chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth FROM (
    SELECT doc_id, k, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM base))
  WHERE chars > 0),
per_line AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE nth > 1) AS dup, coalesce(sum(chars) FILTER (WHERE nth > 1), 0) AS dup_chars
  FROM lines GROUP BY doc_id),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
         coalesce((SELECT words FROM cover c WHERE c.doc_id = base.doc_id AND c.n = 3), 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(dup_chars, 0) AS dup_chars
  FROM base LEFT JOIN per_line USING (doc_id)),
bad_grams AS (
  SELECT DISTINCT doc_id FROM cover JOIN sizes USING (n) JOIN counts USING (doc_id) WHERE 100 * chars > most * word_chars),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR 100 * dup_chars > 20 * word_chars
            OR doc_id IN (SELECT doc_id FROM bad_grams)) AS kept
FROM judged
"""

JACCARD_JOIN = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM base WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM base UNION SELECT r.doc_id, e.y FROM reached r JOIN edges e ON e.x = r.other)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

PHRASES = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_AZ}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
counts AS MATERIALIZED (
  SELECT lang, p, count(*) AS f
  FROM (SELECT lang, array_to_string(w[k : k + size - 1], ' ') AS p
        FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM worded, (VALUES (1), (2), (3)) AS s(size)))
  GROUP BY lang, p),
often AS MATERIALIZED (SELECT lang, p, string_split(p, ' ') AS w, f FROM counts WHERE f >= 10 AND contains(p, ' ')),
cut_at AS MATERIALIZED (
  SELECT lang, p, f, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail
  FROM (SELECT *, unnest(range(1, len(w))) AS k FROM often)),
cuts AS MATERIALIZED (
  SELECT c.lang, c.p, c.f AS a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f) AS score
  FROM cut_at c JOIN counts l ON l.lang = c.lang AND l.p = c.head JOIN counts r ON r.lang = c.lang AND r.p = c.tail),
candidates AS MATERIALIZED (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_pairs AS (
  SELECT lang, array_to_string(w[i : i + 1], ' ') AS p, max(f) AS longer
  FROM (SELECT lang, w, f, unnest([1, 2]) AS i FROM often WHERE len(w) = 3) GROUP BY ALL),
kept AS (
  SELECT lang, c.p AS phrase, a, l, r, score
  FROM candidates c LEFT JOIN inner_pairs i USING (lang, p) WHERE coalesce(100 * longer < 50 * a, true))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

PREFIX_TRIE = """
WITH own AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
digits AS (
  SELECT conv_id, turns, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0])) AS bits FROM own),
keyed AS (
  SELECT conv_id, turns, xor(4294967295, list_reduce(
    list_prepend(4294967295, bits), lambda c, y: xor(xor(c, y) >> 1, 3988292384 * (xor(c, y) & 1)))) % 9 AS h FROM digits),
whole AS (
  SELECT k.conv_id, list_concat(coalesce(b.turns, [])[1 : h], k.turns[h + 1 :]) AS turns
  FROM keyed k LEFT JOIN own b ON b.conv_id = k.conv_id - k.conv_id % 5),
prefixes AS (
  SELECT conv_id, depth, len(turns) AS len, md5(to_json(turns[1 : depth])::VARCHAR) AS key,
         CASE WHEN depth > 0 THEN md5(to_json(turns[1 : depth - 1])::VARCHAR) END AS parent, coalesce(strlen(turns[depth].t), 0) AS bytes
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM whole)),
nodes AS (
  SELECT depth, key, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, key),
families AS (SELECT p.depth, p.key, p.conv_id, count(c.key) AS n_children FROM nodes p LEFT JOIN nodes c ON c.parent = p.key AND c.depth = p.depth + 1 GROUP BY ALL),
sums AS (
  SELECT a.depth, a.key, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.bytes)::BIGINT AS saved_tokens
  FROM nodes v JOIN families f USING (depth, key) JOIN prefixes a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, f.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN families f USING (depth, key) JOIN sums s USING (depth, key) LEFT JOIN nodes p ON p.key = n.parent AND p.depth = n.depth - 1
"""

TOP_K = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

ORACLE = {
    "op11_phrases": PHRASES,
    "op12_prefix_trie": PREFIX_TRIE,
    "op13_top_k": TOP_K,
    "op4_jaccard_join": JACCARD_JOIN,
    "op2_quality_rules": QUALITY_RULES,
    "op9_benchmark_hits": BENCHMARK_HITS,
    "op1_url_filter": URL_FILTER,
}
