"""DuckDB SQL for the queries that SQL can express."""

from skein.llm import repetition, secrets

ORACLE: dict[str, str] = {}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"

ORACLE["op6_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, length(regexp_replace(t, c, '\1\\\2\3', 'g')) AS text_len, length(regexp_replace(role, c, '\1\\\2\3', 'g')) AS role_len
  FROM (SELECT *, text AS t,
    '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\]|TEXT\]|\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|</?SYS>>)' AS c FROM turns))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(text_len + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 23 + role_len END) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS rewritten_turns
FROM marked GROUP BY conv_id"""

ORACLE["op7_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5"""

# words are runs of anything but space and the characters 9 to 13; A-Z lower-cased
WORD_LIST = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \x09-\x0D]+')"

ORACLE["op10_near_dedup"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORD_LIST} AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, list_aggregate(ws[i:i + 4], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
two_way AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN two_way b ON b.x = r.y)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)"""

ORACLE["op3_warc_fixity"] = """
WITH damaged AS (
  SELECT page_id, url, CASE WHEN page_id % 97 = 13 THEN '~' || substr(html, 2)
    WHEN page_id % 89 = 5 THEN substr(html, 1, length(html) // 2) ELSE html END AS html
  FROM pages WHERE NOT coalesce(page_id, 0) % 101 = 7
  UNION ALL SELECT page_id, url || '#copy', html FROM pages WHERE page_id % 211 = 17),
sides AS (SELECT 'a' AS side, page_id, url, html FROM pages UNION ALL SELECT 'b', page_id, url, html FROM damaged),
rec AS (
  SELECT side, page_id, concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:page:',
    page_id, '>', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10),
    'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10), html, chr(13), chr(10), chr(13), chr(10)) AS r FROM sides),
m AS (SELECT side, page_id, sha256(r) AS hash, CAST(strlen(r) AS BIGINT) AS size FROM rec),
k AS (SELECT page_id, CAST(coalesce(sum(sum(size)) OVER (ORDER BY page_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM m WHERE side = 'a' GROUP BY page_id),
d AS (SELECT page_id, hash, size, count(*) FILTER (side = 'a') - count(*) FILTER (side = 'b') AS more FROM m GROUP BY ALL HAVING more <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id, more > 0 ORDER BY hash) AS i FROM d),
a AS (SELECT * FROM n WHERE more > 0), b AS (SELECT * FROM n WHERE more < 0)
SELECT page_id, CASE WHEN b.hash IS NULL THEN 'missing' WHEN a.hash IS NULL THEN 'extra' ELSE 'corrupt' END AS status,
  k."offset", a.hash AS hash_a, a.size AS size_a, b.hash AS hash_b, b.size AS size_b, CAST(greatest(a.more, -b.more) AS BIGINT) AS copies
FROM a FULL JOIN b USING (page_id, i) LEFT JOIN k USING (page_id)"""

# every window of the item's length that holds a shared shingle; all others have similarity 0
ORACLE["op5_decontaminate"] = f"""
WITH w AS (SELECT doc_id, {WORD_LIST} AS ws FROM documents),
b AS (SELECT item_id, {WORD_LIST} AS ws FROM benchmark),
bs AS (SELECT item_id, len(ws) AS n, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: list_aggregate(ws[i:i + 4], 'string_agg', ' '))) AS s,
  unnest(range(0, greatest(len(ws) - 4, 1))) AS q FROM b WHERE len(ws) > 0),
ds AS (SELECT doc_id, len(ws) AS n, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: list_aggregate(ws[i:i + 4], 'string_agg', ' '))) AS s,
  unnest(range(0, greatest(len(ws) - 4, 1))) AS p FROM w WHERE len(ws) > 0),
shared AS (SELECT DISTINCT d.doc_id, d.n, d.p, bs.item_id, bs.n AS size FROM ds d JOIN bs ON bs.s = d.s),
placed AS (SELECT DISTINCT doc_id, item_id, size, greatest(0, least(start, n - size)) AS start FROM (
  SELECT *, unnest(range(p - greatest(size - 4, 1) + 1, p + 1)) AS start FROM shared)),
have AS (SELECT pl.doc_id, pl.item_id, pl.start, pl.size, d.s, count(*) AS c FROM placed pl JOIN ds d ON d.doc_id = pl.doc_id
  AND d.p >= pl.start AND d.p < pl.start + greatest(pl.size - 4, 1) GROUP BY ALL),
want AS (SELECT item_id, s, count(*) AS c FROM bs GROUP BY ALL),
total AS (SELECT item_id, sum(c) AS t FROM want GROUP BY ALL),
sim AS (SELECT h.doc_id, h.item_id, h.start, h.size, sum(h.c) AS hc, sum(least(h.c, coalesce(wt.c, 0))) AS common
  FROM have h LEFT JOIN want wt ON wt.item_id = h.item_id AND wt.s = h.s GROUP BY ALL)
SELECT doc_id, item_id, max(common / (hc + t - common)) AS similarity FROM sim JOIN total USING (item_id)
WHERE common / (hc + t - common) >= 0.8 GROUP BY doc_id, item_id"""

def _matches(kind: str, order: int, pattern: str, group: int) -> str:
    """Rows of one kind: position in code points from the pieces between matches."""
    return f"""SELECT doc_id, source, '{kind}' AS kind, {order} AS k, v[i] AS value,
      CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
      length(w[i]) AS len
    FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (
      SELECT doc_id, source, string_split_regex(text, {_q(pattern)}) AS g, regexp_extract_all(text, {_q(pattern)}, 0) AS w,
        regexp_extract_all(text, {_q(pattern)}, {group}) AS v FROM d))"""


# the same language without possessive quantifiers, which only save time
_PLACEHOLDER = secrets.PLACEHOLDER_VALUE.replace("}+", "}").replace("*+", "*")
_PIECE_CHAR = r"[A-Za-z0-9+_.-]"

ORACLE["op8_secrets"] = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
found AS (
  SELECT * FROM ({_matches('assign', 0, secrets.ASSIGN, 2)}) WHERE length(value) >= {secrets.MIN_ASSIGNED}
  UNION ALL {_matches('access', 1, secrets.ACCESS, 0)}
  UNION ALL {_matches('hex', 2, secrets.HEX, 0)}),
held AS (
  SELECT value, count(DISTINCT source) <= {secrets.LIVE_OWNERS} AND NOT regexp_matches(value, {_q(_PLACEHOLDER)}) AS live,
    bool_or(kind = 'assign') AS assigned FROM found GROUP BY value),
sought AS (
  SELECT value, regexp_matches(value, '^{_PIECE_CHAR}') AS solid,
    regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND length(value) >= 12 AS random
  FROM held WHERE live AND assigned AND regexp_matches(value, '{_PIECE_CHAR}')),
places AS (
  SELECT *, unnest(list_filter(range(1, length(text) - length(value) + 2), lambda i: substr(text, i, length(value)) = value)) AS i
  FROM (SELECT d.*, v.* FROM d JOIN sought v ON contains(d.text, v.value))),
copied AS (
  SELECT doc_id, source, value, random, i - 1 AS s, length(value) AS len FROM places
  WHERE (NOT solid OR i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '{_PIECE_CHAR}'))
    AND NOT regexp_matches(substr(text, i + length(value) - 1, 2), '^{_PIECE_CHAR}{{2}}')),
common AS (SELECT value FROM copied WHERE NOT random GROUP BY value HAVING count(DISTINCT source) > {secrets.LIVE_OWNERS}),
spans AS (
  SELECT f.doc_id, f.kind, f.k, f.s, f.s + f.len AS e, coalesce(h.live, false) AS live FROM found f LEFT JOIN held h USING (value)
  UNION ALL
  SELECT DISTINCT c.doc_id, 'reuse', 3, c.s, c.s + c.len, true FROM copied c
  WHERE c.value NOT IN (SELECT value FROM common) AND NOT EXISTS (
    SELECT 1 FROM found b WHERE b.doc_id = c.doc_id AND b.s < c.s + c.len AND b.s + b.len > c.s)),
per_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (kind <> 'reuse') AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans, count(*) FILTER (live) AS n_live,
    count(*) FILTER (kind <> 'reuse' AND NOT live) AS n_example FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN per_doc USING (doc_id)"""


ORACLE["op13_filter_audit"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS ws FROM documents),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT w.part, coalesce(k.good, false) AS good, coalesce(k.toxic, false) AS toxic, len(ws) < 200 AS "A",
    100 * len(list_distinct(ws)) < 50 * len(ws) AS "B", 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS "C",
    regexp_matches(t, '[#$%&*|]') AS "D", coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS "E"
  FROM w LEFT JOIN known k USING (doc_id)),
x AS (SELECT *, MAP {'A': "A", 'B': "B", 'C': "C", 'D': "D", 'E': "E"} AS m FROM f),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a JOIN l b ON b.c <> a.c JOIN l c ON c.c NOT IN (a.c, b.c)
    JOIN l d ON d.c NOT IN (a.c, b.c, c.c) JOIN l e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders),
failing AS (SELECT part, good, toxic, m, count(*) AS n, "A"::INT + "B"::INT + "C"::INT + "D"::INT + "E"::INT AS many FROM x GROUP BY ALL),
seen AS (
  SELECT part, filter_order, step, n, good, toxic, many, m[filter_order[step]] AS own,
    len(list_filter(string_split(filter_order[1:step - 1], ''), lambda c: c <> '' AND m[c])) > 0 AS gone
  FROM failing CROSS JOIN steps),
sums AS (
  SELECT part, filter_order, step, sum(n) FILTER (NOT own AND NOT gone) AS kept, sum(n) FILTER (own AND NOT gone) AS removed,
    sum(n) FILTER (own AND gone) AS redundant, sum(n) FILTER (own AND many = 1) AS unique_fails,
    sum(n) FILTER (own AND NOT gone AND good) AS good_lost, sum(n) FILTER (own AND NOT gone AND toxic) AS toxic_lost FROM seen GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley
FROM sums"""


def _twice(words: int) -> str:
    """doc_id, n: the words that lie in windows of so many words found twice or more in their text."""
    return f"""SELECT doc_id, count(DISTINCT p + o) AS n FROM (
      SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS c FROM (
        SELECT doc_id, unnest(range(1, len(ws) - {words - 2})) AS p, array_to_string(ws[p:p + {words - 1}], ' ') AS s FROM w WHERE len(ws) >= {words}))
    CROSS JOIN (SELECT unnest(range({words})) AS o) WHERE c > 1 GROUP BY doc_id"""


# a word is in a repeated string of k words or more when it is in a repeated window of k words
ORACLE["op12_repetition"] = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS ws FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^ \x09-\x0D]') GROUP BY doc_id),
five AS ({_twice(5)}),
covered AS ({_twice(repetition.MIN_REPEAT)}),
long AS ({_twice(repetition.MAX_LONGEST + 1)}),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[ \x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(five.n, 0) AS n_repeat_words, coalesce(covered.n, 0) AS covered_words, coalesce(long.n, 0) AS too_long
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN five USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN long USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words,
  n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.MAX_REPEAT_PERCENT} * n_words)
    AND 100 * covered_words <= {repetition.MAX_COVERED_PERCENT} * n_words AND too_long = 0 AS kept
FROM m"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE["op11_lexical"] = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
size AS (SELECT count(*) AS n, sum(len(ts)) AS l FROM d WHERE len(ts) > 0),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d)
  WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * size.n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p CROSS JOIN size GROUP BY t, size.n),
s AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * size.n) // size.l)))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN w USING (t) CROSS JOIN size GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
