"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Built from shared CTE fragments so that every query states the same forest,
filters and tree in plain SQL (recursive CTE for attachment). Patterns and
word lists are taken from ``skein.functions.text`` so both sides use the same
fixed values.
"""

from __future__ import annotations

from skein.functions.text import NULL_TOKENS, SENTENCE_PATTERN, STOP_WORDS, TOKEN_PATTERN


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


NT_LIST = _list(NULL_TOKENS)
STOP_LIST = _list(STOP_WORDS)
TOKEN_RE = _q(TOKEN_PATTERN)
SENT_RE = _q(SENTENCE_PATTERN)


def nt(col: str) -> str:
    return f"CASE WHEN {col} IN {NT_LIST} THEN NULL ELSE {col} END"


def tok(col: str) -> str:
    """Tokens of a raw string (0 for null)."""
    return f"COALESCE(CAST(len(regexp_extract_all({col}, {TOKEN_RE})) AS BIGINT), 0)"


def stok(col: str) -> str:
    """Tokens of a string's JSON literal."""
    return tok(js(col))


def js(col: str) -> str:
    """JSON literal of a string (same escaping as Spark's to_json)."""
    return f"substr(to_json([{col}]), 2, length(to_json([{col}])) - 2)"


TS_FMT = "'%Y-%m-%d %H:%M:%S'"

# posts / replies of the documents forest, missing-value strings nulled
FOREST = f"""
fbase AS (
  SELECT doc_id, text, source,
         (doc_id * 37) % 41 - 1 AS score,
         CASE WHEN doc_id % 97 = 1 THEN 'moderator' WHEN doc_id % 89 = 1 THEN 'admin' END AS distinguished,
         CASE WHEN doc_id % 53 = 2 THEN '[removed]' ELSE text END AS body0,
         'u/user' || CAST(doc_id % 50 AS VARCHAR) AS author0,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id - doc_id % 2 AS BIGINT)) AS created
  FROM documents),
fposts AS (
  SELECT 't3_' || CAST(doc_id AS VARCHAR) AS id, {nt('author0')} AS author,
         {nt('split_part(text, chr(10), 1)')} AS title, score, created, {nt('body0')} AS body,
         {nt("CASE WHEN doc_id % 80 = 0 THEN source END")} AS link_flair_text,
         {nt('distinguished')} AS distinguished, doc_id AS ord
  FROM fbase WHERE doc_id % 40 = 0),
fparent AS (
  SELECT *, doc_id - doc_id % 40
            + ((doc_id % (doc_id % 40)) * (doc_id % (doc_id % 40)) * 7 + (doc_id % (doc_id % 40)) * 3) % (doc_id % 40)
            AS pdoc
  FROM fbase WHERE doc_id % 40 <> 0),
freplies AS (
  SELECT 't1_' || CAST(doc_id AS VARCHAR) AS id,
         {nt("CASE WHEN pdoc % 40 = 0 THEN 't3_' ELSE 't1_' END || CAST(pdoc AS VARCHAR)")} AS parent_id,
         {nt('author0')} AS author, score, created, {nt('body0')} AS body,
         {nt('distinguished')} AS distinguished, doc_id AS ord
  FROM fparent),
kposts AS (
  SELECT * FROM fposts
  WHERE score >= 5 AND distinguished IS DISTINCT FROM 'moderator'
    AND body IS NOT NULL AND body NOT IN ('[removed]', '[deleted]')),
kreplies AS (
  SELECT * FROM freplies
  WHERE score >= 5 AND distinguished IS DISTINCT FROM 'moderator'
    AND body IS NOT NULL AND body NOT IN ('[removed]', '[deleted]'))"""

# attachment closure (all depths)
ATTACH = """
att(id, parent_id, post_id, depth, path) AS (
  SELECT r.id, r.parent_id, r.parent_id, 1, [r.parent_id, r.id]
  FROM kreplies r JOIN kposts p ON r.parent_id = p.id
  UNION ALL
  SELECT r.id, r.parent_id, a.post_id, a.depth + 1, list_append(a.path, r.id)
  FROM kreplies r JOIN att a ON r.parent_id = a.id)"""


def tree_ctes(max_depth: int = 3, k: int = 3) -> str:
    """Forest, attachment, depth cut, reply counts, ranks, thread long rows."""
    return f"""WITH RECURSIVE {FOREST},{ATTACH},
kept AS (
  SELECT r.*, a.post_id, a.depth, a.path FROM kreplies r JOIN att a ON r.id = a.id
  WHERE a.depth <= {max_depth + 1}),
counts AS (SELECT parent_id AS cid, count(*) AS num_replies FROM kept GROUP BY parent_id),
nodes AS (
  SELECT n.*, COALESCE(c.num_replies, 0) AS num_replies FROM (
    SELECT id, NULL::VARCHAR AS parent_id, author, score, created, body, distinguished, ord,
           id AS post_id, 0 AS depth, [id] AS path FROM kposts
    UNION ALL
    SELECT id, parent_id, author, score, created, body, distinguished, ord, post_id, depth, path FROM kept) n
  LEFT JOIN counts c ON n.id = c.cid),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY parent_id
             ORDER BY score DESC, num_replies DESC, created ASC, ord ASC) AS rank
  FROM nodes WHERE depth >= 1),
trows AS (
  SELECT n.id AS focus_id, n.post_id, n.depth AS focus_depth,
         CASE WHEN u.pos - 1 = n.depth THEN 'focus' ELSE 'ancestor' END AS kind,
         CAST(u.pos - 1 AS INTEGER) AS pos, u.msg_id
  FROM nodes n, unnest(n.path) WITH ORDINALITY AS u(msg_id, pos)
  WHERE n.depth <= {max_depth} AND n.num_replies > 0
  UNION ALL
  SELECT parent_id AS focus_id, post_id, depth - 1 AS focus_depth, 'reply' AS kind,
         CAST(depth - 1 + rank AS INTEGER) AS pos, id AS msg_id
  FROM ranked WHERE rank <= {k})"""


def records_cte() -> str:
    """Message records: head JSON text, body, head_tok, tok_body (posts and kept replies)."""
    has_flair = "(link_flair_text IS NOT NULL AND link_flair_text <> '')"
    post_head = ("'{' || '\"id\": ' || " + js("id") + " || ', ' || '\"author\": ' || " + js("author")
                 + " || ', ' || '\"title\": ' || " + js("title")
                 + f" || ', ' || CASE WHEN {has_flair} THEN '\"flair\": ' || " + js("link_flair_text")
                 + " || ', ' ELSE '' END || '\"body\": '")
    post_tok = (f"CASE WHEN {has_flair} THEN 26 ELSE 21 END + {stok('id')} + {stok('author')} + {stok('title')}"
                f" + CASE WHEN {has_flair} THEN {stok('link_flair_text')} ELSE 0 END")
    reply_head = ("'{' || '\"id\": ' || " + js("id") + " || ', ' || '\"parent_id\": ' || " + js("parent_id")
                  + " || ', ' || '\"author\": ' || " + js("author") + " || ', ' || '\"body\": '")
    reply_tok = f"21 + {stok('id')} + {stok('parent_id')} + {stok('author')}"
    return f"""recs AS (
  SELECT msg_id, head, body, CAST(head_tok AS BIGINT) AS head_tok, CAST({stok('body')} AS BIGINT) AS tok_body FROM (
    SELECT id AS msg_id, {post_head} AS head, body, {post_tok} AS head_tok FROM kposts
    UNION ALL
    SELECT id AS msg_id, {reply_head} AS head, body, {reply_tok} AS head_tok FROM kept)),
tlong AS (SELECT t.*, r.head, r.body, r.head_tok, r.tok_body FROM trows t JOIN recs r ON t.msg_id = r.msg_id),
totals AS (
  SELECT focus_id,
         CAST(6 + anc_tok + focus_head + focus_body + 7 + rep_tok + n_rep - 1 AS BIGINT) AS ft_total,
         CAST(CASE WHEN n_anc = 0 THEN 6 + anc_tok + focus_head + focus_body + 7 + rep_tok + n_rep - 1
              ELSE 6 + anc_tok + focus_head + 5 + focus_head + focus_body + 7 + rep_tok + n_rep - 1 END AS BIGINT)
           AS gen_total,
         CAST(text_total AS BIGINT) AS text_total
  FROM (
    SELECT focus_id,
           sum(CASE WHEN kind = 'ancestor' THEN 1 ELSE 0 END) AS n_anc,
           sum(CASE WHEN kind = 'reply' THEN 1 ELSE 0 END) AS n_rep,
           sum(CASE WHEN kind = 'ancestor' THEN head_tok + tok_body + 7 ELSE 0 END) AS anc_tok,
           sum(CASE WHEN kind = 'reply' THEN head_tok + tok_body ELSE 0 END) AS rep_tok,
           max(CASE WHEN kind = 'focus' THEN head_tok END) AS focus_head,
           max(CASE WHEN kind = 'focus' THEN tok_body END) AS focus_body,
           sum(tok_body) AS text_total
    FROM tlong GROUP BY focus_id))"""


def summary_ctes(msgs_sql: str) -> str:
    """Sentence table, word weights, scores and picking order for the messages
    selected by ``msgs_sql`` (columns msg_id, body)."""
    return f"""smsgs AS ({msgs_sql}),
sents AS (
  SELECT msg_id, CAST(u.i - 1 AS BIGINT) AS i, u.sent, {stok('u.sent')} AS tok
  FROM smsgs, unnest(regexp_extract_all(body, {SENT_RE})) WITH ORDINALITY AS u(sent, i)),
words AS (
  SELECT msg_id, w AS word FROM (
    SELECT msg_id, unnest(CASE WHEN trim(regexp_replace(body, '[^a-zA-Z]', ' ', 'g')) = '' THEN []::VARCHAR[]
                          ELSE regexp_split_to_array(trim(regexp_replace(body, '[^a-zA-Z]', ' ', 'g')), ' +') END) AS w
    FROM smsgs) WHERE w NOT IN {STOP_LIST}),
wcounts AS (SELECT msg_id, word, count(*) AS n FROM words GROUP BY msg_id, word),
weights AS (SELECT msg_id, word, n, max(n) OVER (PARTITION BY msg_id) AS max_n,
                   n / max(n) OVER (PARTITION BY msg_id) AS weight FROM wcounts),
swords AS (
  SELECT msg_id, i, sent,
         regexp_replace(w, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g') AS word
  FROM (SELECT msg_id, i, sent, unnest(regexp_split_to_array(lower(sent), '[ \\t\\n\\r\\f\\x0B]+')) AS w FROM sents)),
stext AS (
  SELECT s.msg_id, s.sent, sum(w.n) AS score_n, max(w.max_n) AS max_n
  FROM swords s JOIN weights w ON s.msg_id = w.msg_id AND s.word = w.word GROUP BY s.msg_id, s.sent),
scored AS (SELECT s.*, t.score_n, t.score_n / t.max_n AS score
           FROM sents s LEFT JOIN stext t ON s.msg_id = t.msg_id AND s.sent = t.sent),
picked AS (
  SELECT *, row_number() OVER w AS srank, sum(tok) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM scored
  WINDOW w AS (PARTITION BY msg_id ORDER BY (score_n IS NOT NULL) ASC, score_n DESC, i ASC))"""


def thread_render_sql(ft_max_tok: int, gen_max_tok: int, caps_sql: str, columns: str) -> str:
    """Full job A in SQL: caps -> summaries of cut messages -> rendered views.

    ``caps_sql`` is the text up to and including the ``caps`` CTE.
    """
    msgs = "SELECT msg_id, body FROM recs WHERE msg_id IN (SELECT msg_id FROM need)"
    j = js

    def agg_anc(body):
        return (f"COALESCE(string_agg(CASE WHEN kind = 'ancestor' THEN head || {j(body)} || ', \"comments\": [' END,"
                f" '' ORDER BY pos), '')")

    def agg_rep(body):
        return f"string_agg(CASE WHEN kind = 'reply' THEN head || {j(body)} || '}}' END, ', ' ORDER BY pos)"

    return caps_sql + f""",
need AS (SELECT * FROM caps WHERE cap <> tok),
{summary_ctes(msgs)},
sums AS (
  SELECT c.msg_id, c.cap, COALESCE(string_agg(p.sent, ' ' ORDER BY p.i), '') AS summary
  FROM (SELECT DISTINCT msg_id, cap FROM need) c
  LEFT JOIN picked p ON p.msg_id = c.msg_id AND p.run <= c.cap GROUP BY c.msg_id, c.cap),
cut AS (SELECT n.focus_id, n.view, n.msg_id, s.summary FROM need n JOIN sums s ON n.msg_id = s.msg_id AND n.cap = s.cap),
rl AS (
  SELECT l.focus_id, l.post_id, l.kind, l.pos, l.head,
         COALESCE(cf.summary, l.body) AS body_ft, COALESCE(cg.summary, l.body) AS body_gen
  FROM tlong l
  LEFT JOIN cut cf ON cf.focus_id = l.focus_id AND cf.msg_id = l.msg_id AND cf.view = 'ft'
  LEFT JOIN cut cg ON cg.focus_id = l.focus_id AND cg.msg_id = l.msg_id AND cg.view = 'gen'),
parts AS (
  SELECT focus_id, post_id,
         {agg_anc('body_ft')} AS anc_ft, {agg_anc('body_gen')} AS anc_gen,
         max(CASE WHEN kind = 'focus' THEN head END) AS fhead,
         max(CASE WHEN kind = 'focus' THEN body_ft END) AS fbody_ft,
         max(CASE WHEN kind = 'focus' THEN body_gen END) AS fbody_gen,
         {agg_rep('body_ft')} AS rep_ft, {agg_rep('body_gen')} AS rep_gen,
         CAST(sum(CASE WHEN kind = 'ancestor' THEN 1 ELSE 0 END) AS BIGINT) AS n_anc
  FROM rl GROUP BY focus_id, post_id),
rendered AS (
  SELECT focus_id AS id, post_id,
         '{{"post": ' || anc_ft || fhead || {j('fbody_ft')} || ', "comments": [' || rep_ft || ']}}'
           || repeat(']}}', n_anc) || '}}' AS full_thread,
         CASE WHEN n_anc = 0 THEN
           '{{"post": ' || anc_gen || fhead || {j('fbody_gen')} || ', "comments": [' || rep_gen || ']}}' || '}}'
         ELSE fhead || {j('fbody_gen')} || ', "comments": [' || rep_gen || ']}}' END AS subthread,
         CASE WHEN n_anc = 0 THEN NULL ELSE
           '{{"post": ' || anc_gen || fhead || '"..."}}' || repeat(']}}', n_anc) || '}}' END AS subthread_context
  FROM parts)""" + (f"\nSELECT {columns} FROM rendered" if columns else "")
