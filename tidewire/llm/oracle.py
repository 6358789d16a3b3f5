"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_STRIP = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _near(size: int, percent: int) -> str:
    return rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_ALPHABET}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size - 1}], ' '))) END AS s FROM split),
classes AS (SELECT min(doc_id) AS c, list_sort(s) AS s, list(doc_id) AS members FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
items AS (SELECT c, len(s) AS n, unnest(s) AS e FROM classes),
links AS (
  SELECT a.c AS a, b.c AS b FROM items a JOIN items b ON a.e = b.e AND a.c <> b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach AS (SELECT c AS node, c AS root FROM classes UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
named AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
members AS (SELECT unnest(members) AS doc_id, root FROM classes JOIN named ON c = node)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(m.root, s.doc_id) AS component_id, s.doc_id = coalesce(m.root, s.doc_id) AS kept
FROM sets s LEFT JOIN members m ON m.doc_id = s.doc_id"""


OP3 = _near(3, 85)

OP5 = f"""
WITH rows_of AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM rows_of),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, {_STRIP}), {_ALPHABET}) AS key FROM lines),
often AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, pos, line, coalesce(doc_id <> top, false) AS gone FROM keyed LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

OP9 = rf"""
WITH texts AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM texts)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
base AS (
  SELECT t.doc_id, t.host, t.text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x, {_STRIP})) > 0))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: length(trim(x, {_STRIP})) > 0))) AS BIGINT) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words
  FROM texts t LEFT JOIN covered c ON c.doc_id = t.doc_id),
lines AS (
  SELECT host, text, key, max(len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS words
  FROM (SELECT host, text, line, translate(trim(line, {_STRIP}), {_ALPHABET}) AS key FROM (SELECT host, text, unnest(string_split(text, chr(10))) AS line FROM texts))
  WHERE length(key) > 0 GROUP BY host, text, key),
hosts AS (SELECT host, count(DISTINCT text) AS n FROM lines GROUP BY host),
often AS (SELECT l.host, key FROM lines l JOIN hosts h ON l.host = h.host GROUP BY l.host, key, h.n HAVING count(*) >= 20 AND 100 * count(*) > h.n),
depleted AS (
  SELECT l.host, l.text FROM lines l LEFT JOIN often o ON o.host = l.host AND o.key = l.key
  GROUP BY l.host, l.text HAVING 100 * sum(CASE WHEN o.key IS NULL THEN words ELSE 0 END) < 30 * sum(words))
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND d.text IS NULL AS kept
FROM base b LEFT JOIN depleted d ON d.host = b.host AND d.text = b.text"""


_TRACKING = "utm_[a-z]+|gclid|fbclid|msclkid|ref"


def _canonical(url: str) -> str:
    host = rf"regexp_replace(translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), {_ALPHABET}), ':(80|443)$', '')"
    path = rf"regexp_replace(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '(\.html|/)$', '')"
    query = rf"string_split(regexp_extract({url}, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&')"
    kept = f"array_to_string(list_filter({query}, lambda q: q <> '' AND NOT regexp_matches(q, '^({_TRACKING})(=|$)')), '&')"
    return f"CASE WHEN {host} <> '' THEN {host} || {path} || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END END"


def _attribute(name: str) -> str:
    head = rf"(?is)\s{name}\s*=\s*"
    forms = ['"([^"]*)"', "''([^'']*)''", "([^\\s\"''>]+)"]
    return " || ".join(f"coalesce(regexp_extract(tag, '{head}{form}', 1), '')" for form in forms)


# Component verdicts need the closure of links; each node's root is the least node it reaches.
OP8 = rf"""
WITH RECURSIVE rules(rule_verdict, rule_host, rule_path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
tags AS (SELECT url, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
hrefs AS (
  SELECT url, CASE WHEN regexp_matches(lower({_attribute("rel")}), '(^|\s)canonical(\s|$)') THEN {_attribute("href")}
    WHEN lower({_attribute("http-equiv")}) = 'refresh' THEN regexp_extract({_attribute("content")}, '(?is)url\s*=\s*[''"]?([^''"\s]+)', 1) END AS href FROM tags),
targets AS (
  SELECT url, CASE WHEN contains(h, '://') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || h
    WHEN starts_with(h, '/') AND regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) <> '' THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || h END AS target
  FROM (SELECT url, replace(trim(href), '&amp;', '&') AS h FROM hrefs)),
urls AS (SELECT url FROM pages UNION SELECT target FROM targets WHERE target IS NOT NULL),
parts AS (
  SELECT url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {_ALPHABET}), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, {_canonical("url")} AS node FROM urls),
judged AS (
  SELECT p.url, host, path, node, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM parts p LEFT JOIN rules r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY p.url, host, path, node),
edges AS (
  SELECT DISTINCT a.node AS a, b.node AS b FROM targets t JOIN parts a ON a.url = t.url JOIN parts b ON b.url = t.target WHERE a.node <> b.node),
sides AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT DISTINCT node, node AS root FROM parts WHERE node IS NOT NULL UNION SELECT e.b, r.root FROM reach r JOIN sides e ON e.a = r.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
verdicts AS (
  SELECT root, CASE WHEN bool_or(rule_verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict
  FROM judged JOIN roots USING (node) WHERE rule_verdict IS NOT NULL GROUP BY root)
SELECT p.page_id, j.host, j.path, j.rule, coalesce(j.rule_verdict, v.verdict, 'allow') AS verdict
FROM pages p LEFT JOIN judged j ON j.url IS NOT DISTINCT FROM p.url LEFT JOIN roots r ON r.node = j.node LEFT JOIN verdicts v ON v.root = r.root"""


OP11 = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
groups AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t.text) AS text_sha256
FROM texts t JOIN groups g ON g.text = t.text"""

OP13 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), %(alphabet)s), '%(term)s') AS w FROM documents),
totals AS (SELECT CAST(count(*) FILTER (WHERE len(w) > 0) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM words),
asked AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), %(alphabet)s), '%(term)s'))) AS term FROM benchmark),
postings AS (
  SELECT doc_id, n_terms, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_terms, unnest(w) AS term FROM words)
  WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, n_terms, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n_terms * n) // l)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term), totals GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50
""" % {"alphabet": _ALPHABET, "term": r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"}


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash_dedup": OP3, "op5_line_dedup": OP5, "op8_url_filter": OP8, "op9_quality_rules": OP9, "op11_exact_dedup": OP11, "op13_lexical_search": OP13}
