"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality_rules import MARK, MENU, NOTICE, OTHER, SEPARATORS, LineRules
from .url_filters import PATTERN_RULES

SPACES = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def quality_rules_sql(rules: LineRules = LineRules()) -> str:
    count = lambda p: f"len(regexp_extract_all(line, {_quoted(p)}))"
    fails = (
        f"regexp_matches(line, '[^\\x20\\x09-\\x0D]') AND ({count(MARK)} * 100 > length(line) * {rules.marks_percent} OR {count(OTHER)} * 100 > length(line) * {rules.other_percent}"
        f" OR regexp_matches(line, {_quoted(SEPARATORS)}) OR (length(line) <= {rules.menu_chars} AND regexp_matches(line, {_quoted(MENU)})) OR (length(line) <= {rules.notice_chars} AND regexp_matches(line, {_quoted(NOTICE)})))"
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
f AS (SELECT doc_id, line, {fails} AS failed FROM l),
e AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE failed) AS n_failed_lines,
  count(*) FILTER (WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) - count(DISTINCT line) FILTER (WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) AS n_dup_lines,
  coalesce(sum(length(line)) FILTER (WHERE NOT failed), 0) + greatest(count(*) FILTER (WHERE NOT failed) - 1, 0) AS chars_left FROM f GROUP BY doc_id),
b AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(r.n, 0)::BIGINT AS n_repeat_words, length(t) AS chars FROM w LEFT JOIN r USING (doc_id)),
s AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND chars_left * 100 >= chars * {rules.least_kept_percent} AS kept, n_lines::BIGINT AS n_lines, n_failed_lines::BIGINT AS n_failed_lines
FROM s JOIN e USING (doc_id)"""


def url_filters_sql(host_rules: tuple[tuple[str, str], ...]) -> str:
    values = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in host_rules)
    blocked = " OR ".join(f"regexp_matches(target, {_quoted(r.pattern)})" for r in PATTERN_RULES)
    return f"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, {LOWERED.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, {LOWERED.format("rest")} AS target FROM p),
n AS (SELECT *, row_number() OVER () AS k FROM q),
r AS (SELECT * FROM (VALUES {values}) AS r(verdict, rule, rule_host, rule_path)),
b AS (SELECT k, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM n JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN {blocked} THEN 'block' ELSE 'allow' END) AS verdict FROM n LEFT JOIN b USING (k)"""


LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, {LOWERED.format(f"trim(line, {SPACES})")} AS key FROM l),
s AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, line, pos, keeper IS NOT NULL AND keeper <> doc_id AS dropped FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id"""


#: Walks each conversation row by row; for each state the cheapest edits so far, the least of equal ones. Ties of a turn go by role and text.
CONVERSATION_REPAIR = """
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
crc(n, v) AS (SELECT n, v FROM (SELECT range AS n, range AS v0 FROM range(256)) b, LATERAL (SELECT list_reduce(list_prepend(v0, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v) q),
tab AS (SELECT list(v ORDER BY n) AS t FROM crc),
h AS (SELECT c.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(place, ''), lambda s: ascii(s)::BIGINT)), lambda x, y: xor(x // 256, t[xor(x % 256, y) + 1])), 4294967295) % 20 AS how FROM c, tab),
g AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM h, range(CASE WHEN how = 3 THEN 2 ELSE 1 END) WHERE how <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM g),
f AS (SELECT conv_id, turn, role, text, pos, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault FROM o),
p AS (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair FROM f),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
  count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE pos > 1 AND coalesce(pair, '') NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS rows FROM p GROUP BY conv_id),
ins(q, r, letters, lines) AS (VALUES ('e', 'e', '', []), ('e', 'u', 'I', ['user:']), ('e', 'a', 'II', ['user:', 'assistant:']), ('s', 's', '', []), ('s', 'u', 'I', ['user:']), ('s', 'a', 'II', ['user:', 'assistant:']),
  ('u', 'u', '', []), ('u', 'a', 'I', ['assistant:']), ('a', 'a', '', []), ('a', 'u', 'I', ['user:'])),
leg(q, r) AS (VALUES ('e', 's'), ('e', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
walk AS (
  SELECT conv_id, 0::BIGINT AS pos, 'e' AS q, {cost: 0::BIGINT, audit: '', lines: []::VARCHAR[]} AS best FROM s
  UNION ALL
  SELECT conv_id, pos, q, min({cost: cost, audit: audit, lines: lines}) AS best FROM (
    SELECT w.conv_id, f.pos, x.r AS q, w.best.cost + 3 * length(ins.letters) + x.cost + CASE WHEN fault = 't' AND x.letter <> 'D' THEN 3 ELSE 0 END AS cost, w.best.audit || ins.letters || x.letter AS audit,
      list_concat(list_concat(w.best.lines, ins.lines), CASE x.letter WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE x.r WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] END) AS lines
    FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1 JOIN ins ON ins.q = w.q
    JOIN (SELECT q, q AS r, 'D' AS letter, 4 AS cost FROM (VALUES ('e'), ('s'), ('u'), ('a')) AS v(q) UNION ALL SELECT q, r, 'K', 0 FROM leg UNION ALL SELECT q, r, 'R', 3 FROM leg WHERE r <> 's') x
      ON x.q = ins.r AND (x.letter = 'D' OR fault NOT IN ('b', 'd')) AND (x.letter <> 'K' OR x.r = f.i)) GROUP BY conv_id, pos, q),
z AS (SELECT w.conv_id, min({cost: w.best.cost + 3 * length(e.letters), audit: w.best.audit || e.letters, lines: list_concat(w.best.lines, e.lines)}) AS best
  FROM walk w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND w.pos = s.rows JOIN ins e ON e.q = w.q AND (e.r = 'a' OR e.q = 'e' AND e.r = 'e') GROUP BY w.conv_id),
d AS (SELECT DISTINCT conv_id FROM conversations)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(z.best.cost, 0)::BIGINT AS cost, coalesce(z.best.audit, '') AS audit, sha256(coalesce(array_to_string(z.best.lines, chr(10)), '')) AS repaired_sha256
FROM d LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM d.conv_id"""


WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST, url NULLS LAST) AS place,
  first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST, url NULLS LAST) AS first FROM pages)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND place > 1 THEN first END AS refers_to FROM p"""

_TERMS = f"regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
RANKED_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, coalesce(sum(len(ts)), 0)::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
q AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS}) AS ts FROM benchmark),
c AS (SELECT q, item_id, d.r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.ts)::BIGINT * n_docs) // n_terms))))::BIGINT AS score
  FROM (SELECT q, item_id, unnest(ts) AS term FROM q) JOIN p USING (term) JOIN w USING (term) JOIN d USING (r), s GROUP BY q, item_id, d.r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM c WHERE score > 0 QUALIFY rank <= 50"""
