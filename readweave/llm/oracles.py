"""SQL that states what the queries return, for DuckDB over the same tables; texts are compared as such, no hash stands for them."""

from __future__ import annotations

from .quality_rules import BASE_RULES, RULES, STOP_WORDS, Rule

_WORD = r"[^\x20\x09-\x0D]+"

_SAID = r"\### Assistant: </turn> ok"
_ORDER = "ORDER BY turn NULLS FIRST, role, text"
OP2 = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}')),
-- A conversation is escaped if a text or role holds a mark of the grammar.
hard AS (SELECT conv_id, bool_or(regexp_matches(role || chr(10) || text, '</turn>|###') OR contains(role, ': ')) AS hard FROM said GROUP BY conv_id)
SELECT said.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(9 + sum(14 + length(role) + length(text) + CASE WHEN hard THEN
    length(regexp_replace(text, '[^\\<#]', '', 'g')) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) ELSE 0 END) AS BIGINT) AS formatted_chars
FROM said JOIN hard ON said.conv_id = hard.conv_id GROUP BY said.conv_id"""

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: name, pattern, group, least and most length, part; leftmost matches begin at the start of a run without being told so.
_KINDS = (
    ("assign", _ASSIGN, 2, 12, None, "secret"),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, None, "access"),
    ("hex", r"[0-9a-f]+", 0, 16, None, "secret"),
    ("weak_access", r"AKIA[A-Z0-9]+", 0, 12, 17, "access"),
    ("weak_login", r"""((?i:user_?name|login|account|client_?id|access_?key_?id))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.@=-]+)""", 2, 3, None, "access"),
    ("weak_assign", _ASSIGN, 2, 4, 11, "secret"),
    ("weak_mail", r"[A-Za-z0-9._+-]+@[A-Za-z0-9][A-Za-z0-9._+-]*", 0, 6, None, "access"),
    ("weak_endpoint", r"""[a-z0-9+]+://[^\x00-\x20"''<>]+""", 0, 8, None, "endpoint"),
)
_HITS = " UNION ALL ".join(
    f"""SELECT r, {i} AS kind, '{name}' AS name, '{part}' AS part, unnest(range(len(regexp_extract_all(text, '{rx}')))) AS nth, unnest(regexp_extract_all(text, '{rx}')) AS hit,
  unnest(regexp_extract_all(text, '{rx}', {group})) AS v, unnest(string_split_regex(text, '{rx}')[1:len(regexp_extract_all(text, '{rx}'))]) AS gap, {least} AS least, {most or 1 << 40} AS most FROM d"""
    for i, (name, rx, group, least, most, part) in enumerate(_KINDS)
)
OP3 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
hits AS MATERIALIZED ({_HITS}),
placed AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY r, kind ORDER BY nth) AS BIGINT) AS stop FROM hits),
spans AS MATERIALIZED (SELECT r, kind, name, part, stop - length(hit) AS start, stop FROM placed WHERE length(v) BETWEEN least AND most),
shown AS (SELECT *, name || ':' || start || ':' || stop AS said FROM spans a WHERE kind < 3 OR EXISTS (
  SELECT 1 FROM spans b WHERE b.r = a.r AND (a.part = 'secret') <> (b.part = 'secret') AND b.start <= a.stop + 200 AND b.stop >= a.start - 200))
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(said, ',' ORDER BY start, kind, stop), '') AS spans
FROM d LEFT JOIN shown USING (r) GROUP BY r, doc_id"""

OP4 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 5 * both_ >= 4 * (p.n + q.n - both_)),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, y FROM reach JOIN links ON other = x),
many AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT doc_id, min(other) AS class_id, coalesce(any_value(n), 0) AS n_links FROM reach LEFT JOIN many ON x = doc_id GROUP BY doc_id"""

_FOLD = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_FOLD} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_FOLD} AS w FROM benchmark) WHERE len(w) > 0),
windows AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS words FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM b)),
places AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
found AS MATERIALIZED (SELECT r, p, places.n AS n, item_id FROM places JOIN windows ON windows.n = places.n AND words = array_to_string(w[p:p + places.n - 1], ' ')),
hit AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS i FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""

OP6 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS MATERIALIZED (SELECT r, doc_id, p, array_to_string(w[p:p + 12], ' ') AS words FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
least_ AS (SELECT words, min(doc_id) AS first FROM windows GROUP BY words),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 13)) AS i FROM windows JOIN least_ USING (words) WHERE doc_id > first),
each_ AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT each_.r, count(*) AS n, string_agg(word, ' ' ORDER BY each_.i) AS said FROM each_ LEFT JOIN gone ON gone.r = each_.r AND gone.i = each_.i WHERE gone.r IS NULL GROUP BY each_.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""


def _passes(rule: Rule) -> str:
    under = rule.denominator or "1"
    checks = [f"{rule.numerator} * 100 >= {round(rule.least * 100)} * {under}"] if rule.least is not None else []
    checks += [f"{rule.numerator} * 100 <= {round(rule.most * 100)} * {under}"] if rule.most is not None else []
    return f"(({' AND '.join(checks)}) OR {under} = 0)"


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_FAILED = " OR ".join(f"NOT {_passes(r)}" for r in RULES if r.name in BASE_RULES)
OP7 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
windows AS (SELECT r, p, count(*) OVER (PARTITION BY r, words) AS many FROM (SELECT r, p, array_to_string(w[p:p + 7], ' ') AS words FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8))),
repeats AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest(range(p, p + 8)) AS i FROM windows WHERE many > 1) GROUP BY r),
counts AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
  len(list_filter(w, lambda x: regexp_replace(x, '[,.]$', '') IN ({_STOPS}))) AS n_stop_words FROM d LEFT JOIN repeats USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_FAILED} AS base_failed, {' AND '.join(map(_passes, RULES))} AS kept FROM counts"""

ORACLES = {"op2_chat_format": OP2, "op3_secret_scan": OP3, "op4_ngram_join": OP4, "op5_decontaminate": OP5, "op6_substring_dedup": OP6, "op7_quality_rules": OP7}
