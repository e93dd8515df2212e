"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIXING = rf"""
WITH sized AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS draw, CAST('0x' || substr(md5('mix-1-again:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place FROM documents),
 totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
 weighed AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight FROM totals),
 ratios AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source) AS nth FROM weighed),
 levels AS (SELECT *, (CAST((SELECT sum(source_size) FROM totals) - coalesce(sum(3 * source_size) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)) / CAST(sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM ratios),
 chosen AS (SELECT coalesce(min_by(level, nth) FILTER (WHERE 3 * source_size > weight * level), 0) AS level FROM levels),
 goals AS (SELECT source, source_size, least(weight * level, CAST(3 * source_size AS DOUBLE)) AS target FROM weighed, chosen),
 rates AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM goals),
 wanted AS (SELECT *, target - times * source_size AS more, CASE WHEN source_size > 0 THEN (target - times * source_size) / source_size ELSE 0.0 END * 1152921504606846976.0 AS chance FROM rates),
 drawn AS (SELECT s.doc_id, s.source, size, place, source_size, target, times, more, draw < chance AS hit FROM sized s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source),
 needs AS (SELECT source, more - coalesce(sum(size) FILTER (WHERE hit), 0) AS need FROM drawn GROUP BY source, more),
 places AS (SELECT d.source, place, need, CAST(sum(size) AS BIGINT) AS words FROM drawn d JOIN needs n ON d.source IS NOT DISTINCT FROM n.source WHERE hit = (need < 0) AND size <= abs(need) GROUP BY d.source, place, need),
 cum AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY place) - words / 2 AS middle FROM places),
 ends AS (SELECT source, need, max(place) AS upto FROM cum WHERE middle <= abs(need) GROUP BY source, need)
SELECT d.doc_id, d.size, d.source_size, d.target, d.size * (times + CASE WHEN e.upto IS NOT NULL AND size <= abs(e.need) AND hit = (e.need < 0) AND place <= e.upto THEN 1 - CAST(hit AS BIGINT) ELSE CAST(hit AS BIGINT) END) AS taken
FROM drawn d LEFT JOIN ends e ON d.source IS NOT DISTINCT FROM e.source"""

QUALITY = rf"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS l, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
 windows AS (SELECT doc_id, i, array_to_string(l[i : i + 4], ' ') AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) - 3)) AS i FROM words)),
 found AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
 covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM found) GROUP BY doc_id),
 base AS (SELECT w.doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(length(array_to_string(l, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
 NOT failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 12 * n_words AND 10 * n_dup_lines <= 3 * n_lines AND n_upper <= n_lower AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS failed FROM base)"""

_TEXT = r"replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h')"
CHAT = rf"""
WITH probe AS (SELECT -7 AS conv_id, turn, role, '\### Assistant: </turn> ok' AS text FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
 turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM probe)),
 said AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
  CAST(sum(14 + length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c')) + length({_TEXT})) AS BIGINT) AS formatted_chars FROM turns GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, n_turns, turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars FROM said"""

EXACT = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x.t) AS text_sha256 FROM texts x JOIN groups g ON x.t = g.t"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH = rf"""
WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
 postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
 lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY doc_id),
 corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS length FROM lengths),
 asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
 weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM postings, corpus WHERE term IN (SELECT term FROM asked) GROUP BY term, n_docs),
 impacts AS (SELECT p.doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // length))) AS impact
  FROM postings p JOIN weights w ON p.term = w.term JOIN lengths l ON p.doc_id = l.doc_id, corpus),
 scores AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM asked a JOIN impacts i ON a.term = i.term GROUP BY item_id, doc_id),
 ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""

ORACLES = {"op2_mixing": MIXING, "op3_quality": QUALITY, "op5_chat": CHAT, "op11_exact": EXACT, "op12_search": SEARCH}
