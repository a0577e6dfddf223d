"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus oracle SQL.

Every query reads the given tables (or data Spark derives from them) in
full. Output columns are aliased identically in the Spark job and in the
DuckDB SQL; integers are longs, doubles are rounded to 6 places, timestamps
are rendered as text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schemas
from skein.functions import counters
from skein.functions import prompts as PR
from skein.functions.text import WS, null_if_token, sentences, string_tokens
from skein.operators import budget, chat, dataset, reading_order, retrieve, sampling, sentence_model, summarize, tree
from skein.plans import build_threads as bt
from skein.plans import generate as gen
from skein.plans import oracle as O
from skein.plans import rounds
from skein.session import materialize, stage_path
from skein.sources import dumps, files, forest
from skein.sources.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TS = "yyyy-MM-dd HH:mm:ss"
P = bt.ThreadParams()
# small budgets (still >= the 1000-token minimum) so most threads are cut
SMALL = bt.ThreadParams(ft_max_tok=1000, gen_max_tok=1500)


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def _ts(c: str = "created"):
    return F.date_format(F.col(c), TS).alias(c)


# ---------------------------------------------------------------------------
# sources and cleaning
# ---------------------------------------------------------------------------

@register("null_tokens", """
SELECT doc_id, count(*) AS n_lines, count(v) AS n_values FROM (
  SELECT doc_id, CASE WHEN line IN {nt} THEN NULL ELSE line END AS v
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
GROUP BY doc_id""".format(nt=O.NT_LIST))
def q_null_tokens(spark, sf):
    lines = (table(spark, sf, "documents")
             .select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
             .select("doc_id", null_if_token(F.col("line")).alias("v")))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count("v").alias("n_values"))


POST_OUT = ["id", "author", "title", "score", "created", "body", "link_flair_text", "distinguished"]
REPLY_OUT = ["id", "parent_id", "author", "score", "created", "body", "distinguished"]


def _sel_sql(cols):
    return ", ".join(f"strftime(created, {O.TS_FMT}) AS created" if c == "created" else c for c in cols)


@register("filter_posts", f"WITH {O.FOREST}\nSELECT {_sel_sql(POST_OUT)} FROM kposts")
def q_filter_posts(spark, sf):
    posts, _ = bt.filtered_forest(spark, sf)
    return posts.select(*[_ts() if c == "created" else c for c in POST_OUT])


@register("filter_replies", f"WITH {O.FOREST}\nSELECT {_sel_sql(REPLY_OUT)} FROM kreplies")
def q_filter_replies(spark, sf):
    _, replies = bt.filtered_forest(spark, sf)
    return replies.select(*[_ts() if c == "created" else c for c in REPLY_OUT])


# ---------------------------------------------------------------------------
# tree operators
# ---------------------------------------------------------------------------

@register("parent_lookup", f"""WITH {O.FOREST}
SELECT r.id, r.parent_id, p.id AS parent_reply_id, p.ord AS parent_ord
FROM kreplies r LEFT JOIN kreplies p ON r.parent_id = p.id""")
def q_parent_lookup(spark, sf):
    _, replies = bt.filtered_forest(spark, sf)
    return tree.parent_lookup(replies).select("id", "parent_id", "parent_reply_id", "parent_ord")


@register("root_semi", f"""WITH {O.FOREST}
SELECT r.id, r.parent_id FROM kreplies r WHERE r.parent_id IN (SELECT id FROM kposts)""")
def q_root_semi(spark, sf):
    posts, replies = bt.filtered_forest(spark, sf)
    return tree.root_semi(replies, posts).select("id", "parent_id")


@register("attached", f"""WITH RECURSIVE {O.FOREST},{O.ATTACH}
SELECT id, post_id FROM att""")
def q_attached(spark, sf):
    posts, replies = bt.filtered_forest(spark, sf)
    return tree.attach_all(posts, replies).select("id", "post_id")


@register("reply_depth", f"""WITH RECURSIVE {O.FOREST},{O.ATTACH}
SELECT id, CAST(depth AS BIGINT) AS depth FROM att""")
def q_reply_depth(spark, sf):
    posts, replies = bt.filtered_forest(spark, sf)
    return tree.attach_all(posts, replies).select("id", F.col("depth").cast("long"))


@register("kept_counts", f"""WITH RECURSIVE {O.FOREST},{O.ATTACH}
SELECT (SELECT count(*) FROM kposts) AS n_posts, (SELECT count(*) FROM att) AS n_replies""")
def q_kept_counts(spark, sf):
    posts, replies = bt.filtered_forest(spark, sf)
    att = tree.attach_all(posts, replies)
    flags = (posts.select(F.lit(1).alias("p"), F.lit(0).alias("r"))
             .unionByName(att.select(F.lit(0).alias("p"), F.lit(1).alias("r"))))
    return flags.agg(F.sum("p").cast("long").alias("n_posts"), F.sum("r").cast("long").alias("n_replies"))


def _nodes(spark, sf, p=P):
    posts, replies = bt.filtered_forest(spark, sf, p.min_score)
    return bt.threads.forest_nodes(posts, replies, p.max_depth)


@register("depth_filter", O.tree_ctes() + "\nSELECT id, CAST(depth AS BIGINT) AS depth FROM kept")
def q_depth_filter(spark, sf):
    return _nodes(spark, sf).where("depth >= 1").select("id", F.col("depth").cast("long"))


@register("post_of_reply", O.tree_ctes() + "\nSELECT id, post_id FROM kept")
def q_post_of_reply(spark, sf):
    return _nodes(spark, sf).where("depth >= 1").select("id", "post_id")


@register("ancestor_paths", O.tree_ctes() + "\nSELECT id, array_to_string(path, '/') AS path FROM nodes")
def q_ancestor_paths(spark, sf):
    return _nodes(spark, sf).select("id", F.array_join("path", "/").alias("path"))


@register("reply_counts", O.tree_ctes() + "\nSELECT id, CAST(num_replies AS BIGINT) AS num_replies FROM nodes")
def q_reply_counts(spark, sf):
    return _nodes(spark, sf).select("id", "num_replies")


@register("rank_replies", O.tree_ctes() + "\nSELECT id, parent_id, CAST(rank AS BIGINT) AS rank FROM ranked")
def q_rank_replies(spark, sf):
    n = _nodes(spark, sf).where("depth >= 1")
    return tree.rank_replies_spread(n).select("id", "parent_id", F.col("rank").cast("long"))


@register("top_replies", O.tree_ctes() + "\nSELECT id, parent_id, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 3")
def q_top_replies(spark, sf):
    n = _nodes(spark, sf).where("depth >= 1")
    return tree.top_replies(n, P.max_replies).select("id", "parent_id", F.col("rank").cast("long"))


@register("threads", O.tree_ctes() + """
SELECT focus_id, post_id, CAST(focus_depth AS BIGINT) AS focus_depth, kind, CAST(pos AS BIGINT) AS pos, msg_id
FROM trows""")
def q_threads(spark, sf):
    rows = bt.threads.thread_rows(_nodes(spark, sf), P.max_depth, P.max_replies)
    return rows.select("focus_id", "post_id", F.col("focus_depth").cast("long"), "kind",
                       F.col("pos").cast("long"), "msg_id")


# T13: output order key = post input order, then the sibling ranks along the path
@register("preorder", O.tree_ctes() + """,
rk AS (SELECT id, rank FROM ranked),
steps AS (
  SELECT n.id, u.i, COALESCE(r.rank, 0) AS rank
  FROM nodes n, unnest(n.path) WITH ORDINALITY AS u(step, i) LEFT JOIN rk r ON r.id = u.step
  WHERE n.depth <= 3 AND n.num_replies > 0)
SELECT s.id, p.ord AS post_ord, string_agg(lpad(CAST(s.rank AS VARCHAR), 19, '0'), '.' ORDER BY s.i) AS rank_path
FROM steps s JOIN nodes n ON s.id = n.id JOIN kposts p ON p.id = n.post_id
GROUP BY s.id, p.ord""")
def q_preorder(spark, sf):
    posts, replies = bt.filtered_forest(spark, sf)
    nodes = bt.threads.forest_nodes(posts, replies, P.max_depth)
    ranks = tree.rank_replies_spread(nodes.where("depth >= 1")).select(F.col("id").alias("step"), "rank")
    focus = nodes.where((F.col("depth") <= P.max_depth) & (F.col("num_replies") > 0))
    steps = (focus.select("id", "post_id", F.posexplode("path").alias("i", "step"))
             .join(ranks, "step", "left")
             .withColumn("rank", F.coalesce("rank", F.lit(0))))
    keyed = steps.groupBy("id", "post_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "rank"))),
                                 lambda x: F.lpad(x["rank"].cast("string"), 19, "0")), ".").alias("rank_path"))
    return (keyed.join(posts.select(F.col("id").alias("post_id"), F.col("ord").alias("post_ord")), "post_id")
            .select("id", "post_ord", "rank_path"))


@register("reading_order", O.tree_ctes() + """,
rk AS (SELECT id, rank FROM ranked),
steps AS (
  SELECT n.id, u.i, COALESCE(r.rank, 0) AS rank
  FROM nodes n, unnest(n.path) WITH ORDINALITY AS u(step, i) LEFT JOIN rk r ON r.id = u.step
  WHERE n.depth <= 3 AND n.num_replies > 0),
keyed AS (
  SELECT s.id, p.ord AS post_ord, list(s.rank ORDER BY s.i) AS ranks
  FROM steps s JOIN nodes n ON s.id = n.id JOIN kposts p ON p.id = n.post_id GROUP BY s.id, p.ord)
SELECT id, row_number() OVER (ORDER BY post_ord, ranks) - 1 AS position FROM keyed""")
def q_reading_order(spark, sf):
    """T13: the place of each thread row in the output."""
    return reading_order.positions(_nodes(spark, sf), P.max_depth)


# ---------------------------------------------------------------------------
# token totals, water-filling, summaries
# ---------------------------------------------------------------------------

def _stages(spark, sf, p=P):
    posts, replies = bt.filtered_forest(spark, sf, p.min_score)
    return bt.stages(posts, replies, p)


# the totals are those of the rendered, uncut texts
_UNCUT = (O.tree_ctes() + ",\n" + O.records_cte()
          + ",\ncaps AS (SELECT focus_id, 'ft' AS view, msg_id, tok_body AS tok, tok_body AS cap FROM tlong)")


@register("thread_tokens", O.thread_render_sql(0, 0, _UNCUT, "") + f"""
SELECT r.id, {O.tok('r.full_thread')} AS ft_total,
       {O.tok("coalesce(r.subthread_context, '')")} + {O.tok('r.subthread')} AS gen_total, t.text_total
FROM rendered r JOIN totals t ON t.focus_id = r.id""")
def q_thread_tokens(spark, sf):
    t = _stages(spark, sf).totals
    return t.select(F.col("focus_id").alias("id"), "ft_total", "gen_total", "text_total")


TWO = replace(P, ft_counter=counters.PatternCounter(), gen_counter=counters.PatternCounter(counters.RUN_PATTERN))
_RUNS = f"CAST(len(regexp_extract_all({{}}, {O._q(counters.RUN_PATTERN)})) AS BIGINT)"


@register("thread_tokens_two", O.thread_render_sql(0, 0, _UNCUT, "") + f""",
texts AS (SELECT focus_id, CAST(sum(tok_body) AS BIGINT) AS ft_text, CAST(sum({_RUNS.format(O.js('body'))}) AS BIGINT) AS gen_text FROM tlong GROUP BY focus_id)
SELECT r.id, {O.tok('r.full_thread')} AS ft_total, {_RUNS.format("coalesce(r.subthread_context, '')")} + {_RUNS.format('r.subthread')} AS gen_total,
  ft_text, gen_text
FROM rendered r JOIN texts t ON t.focus_id = r.id""")
def q_thread_tokens_two(spark, sf):
    """A6 by two counters, one for each budget, merged from the messages' counts; the tokens of the second cross quotes and commas."""
    return _stages(spark, sf, TWO).totals.withColumnRenamed("focus_id", "id")


def _caps_sql(p):
    return O.tree_ctes() + ",\n" + O.records_cte() + f""",
views AS (
  SELECT focus_id, 'ft' AS view, ft_total AS total, {p.ft_max_tok} AS lim, text_total FROM totals
  UNION ALL
  SELECT focus_id, 'gen' AS view, gen_total AS total, {p.gen_max_tok} AS lim, text_total FROM totals),
over AS (SELECT focus_id, view, greatest(1, lim - (total - text_total)) AS budget FROM views WHERE total > lim),
om AS (SELECT o.focus_id, o.view, l.msg_id, l.tok_body AS tok, o.budget FROM over o JOIN tlong l ON o.focus_id = l.focus_id),
lv AS (
  SELECT *, max(g) OVER (PARTITION BY focus_id, view) AS level FROM (
    SELECT *, (budget - (sum(tok) OVER (PARTITION BY focus_id, view)
                         - sum(tok) OVER (PARTITION BY focus_id, view ORDER BY tok DESC, msg_id
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))
              / row_number() OVER (PARTITION BY focus_id, view ORDER BY tok DESC, msg_id) AS g
    FROM om)),
caps AS (SELECT focus_id, view, msg_id, tok, CAST(greatest(1, floor(least(tok, level))) AS BIGINT) AS cap FROM lv)"""


@register("waterfill_caps", _caps_sql(SMALL) + "\nSELECT focus_id, view, msg_id, tok, cap FROM caps")
def q_waterfill_caps(spark, sf):
    st = _stages(spark, sf, SMALL)
    caps = budget.waterfill_caps(bt.over_budget_messages(st, SMALL), ["focus_id", "view"])
    return caps.select("focus_id", "view", "msg_id", "tok", "cap")


DOC_MSGS = "SELECT CAST(doc_id AS VARCHAR) AS msg_id, text AS body FROM documents"


def _doc_msgs(spark, sf):
    return spread(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("msg_id"), F.col("text").alias("body")))


@register("token_count", """
SELECT doc_id, {t} AS tokens, {s} AS json_tokens FROM documents""".format(t=O.tok("text"), s=O.stok("text")))
def q_token_count(spark, sf):
    from skein.functions.text import count_tokens
    d = table(spark, sf, "documents")
    return d.select("doc_id", count_tokens(F.col("text")).alias("tokens"),
                    string_tokens(F.col("text")).alias("json_tokens"))


@register("sentences", """
SELECT doc_id, CAST(u.i - 1 AS BIGINT) AS i, u.sent, {s} AS tok
FROM documents, unnest(regexp_extract_all(text, {re})) WITH ORDINALITY AS u(sent, i)""".format(
    s=O.stok("u.sent"), re=O.SENT_RE))
def q_sentences(spark, sf):
    d = table(spark, sf, "documents")
    return (d.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("i", "sent"))
            .select("doc_id", F.col("i").cast("long"), "sent", string_tokens(F.col("sent")).alias("tok")))


@register("word_weights", f"WITH {O.summary_ctes(DOC_MSGS)}\n"
          "SELECT msg_id, word, CAST(n AS BIGINT) AS n, round(weight, 6) AS weight FROM weights")
def q_word_weights(spark, sf):
    w = summarize.word_weights(_doc_msgs(spark, sf))
    return w.select("msg_id", "word", F.col("n").cast("long"), F.round("weight", 6).alias("weight"))


@register("sentence_scores", f"WITH {O.summary_ctes(DOC_MSGS)}\n"
          "SELECT msg_id, i, round(score, 6) AS score, CAST(srank AS BIGINT) AS srank, CAST(run AS BIGINT) AS run "
          "FROM picked")
def q_sentence_scores(spark, sf):
    r = summarize.ranked_sentences(_doc_msgs(spark, sf))
    return r.select("msg_id", F.col("i").cast("long"), F.round("score", 6).alias("score"),
                    F.col("srank").cast("long"), F.col("run").cast("long"))


# caps for the summary queries: a quarter, a half and the whole of each text
DOC_CAPS = ("SELECT DISTINCT msg_id, CAST(greatest(1, (tok_all * f) // 4) AS BIGINT) AS cap "
            "FROM (SELECT msg_id, {t} AS tok_all FROM smsgs), (SELECT unnest([1, 2, 4]) AS f)")


@register("summary_pick", f"WITH {O.summary_ctes(DOC_MSGS)},\n"
          f"dcaps AS ({DOC_CAPS.format(t=O.stok('body'))})\n"
          "SELECT c.msg_id, c.cap, CAST(count(p.srank) AS BIGINT) AS k FROM dcaps c "
          "LEFT JOIN picked p ON p.msg_id = c.msg_id AND p.run <= c.cap GROUP BY c.msg_id, c.cap")
def q_summary_pick(spark, sf):
    return summarize.summaries(_capped_docs(spark, sf)).select("msg_id", "cap", "k")


def _capped_docs(spark, sf):
    msgs = _doc_msgs(spark, sf).withColumn("tok_all", string_tokens(F.col("body")))
    return msgs.withColumn("caps", F.expr("array_distinct(transform(array(1, 2, 4), f -> greatest(1L, (tok_all * f) div 4)))")).drop("tok_all")


@register("summaries", f"WITH {O.summary_ctes(DOC_MSGS)},\n"
          f"dcaps AS ({DOC_CAPS.format(t=O.stok('body'))})\n"
          "SELECT c.msg_id, c.cap, COALESCE(string_agg(p.sent, ' ' ORDER BY p.i), '') AS summary FROM dcaps c "
          "LEFT JOIN picked p ON p.msg_id = c.msg_id AND p.run <= c.cap GROUP BY c.msg_id, c.cap")
def q_summaries(spark, sf):
    return summarize.summaries(_capped_docs(spark, sf)).select("msg_id", "cap", "summary")


# ---------------------------------------------------------------------------
# rendered thread views (job A output)
# ---------------------------------------------------------------------------

THREAD_COLS = "id, post_id, full_thread, subthread, subthread_context"


def _threads(spark, sf, p):
    posts, replies = bt.filtered_forest(spark, sf, p.min_score)
    return bt.build_threads(posts, replies, p)


@register("thread_json", O.thread_render_sql(P.ft_max_tok, P.gen_max_tok, _caps_sql(P), THREAD_COLS))
def q_thread_json(spark, sf):
    return _threads(spark, sf, P)


@register("budgeted_threads", O.thread_render_sql(SMALL.ft_max_tok, SMALL.gen_max_tok, _caps_sql(SMALL), THREAD_COLS))
def q_budgeted_threads(spark, sf):
    return _threads(spark, sf, SMALL)


@register("subthread", O.thread_render_sql(SMALL.ft_max_tok, SMALL.gen_max_tok, _caps_sql(SMALL), "id, subthread"))
def q_subthread(spark, sf):
    return _threads(spark, sf, SMALL).select("id", "subthread")


@register("subthread_context", O.thread_render_sql(SMALL.ft_max_tok, SMALL.gen_max_tok, _caps_sql(SMALL),
                                                  "id, subthread_context"))
def q_subthread_context(spark, sf):
    return _threads(spark, sf, SMALL).select("id", "subthread_context")


# ---------------------------------------------------------------------------
# sampling and data set assembly (job B) on the job A thread table
# ---------------------------------------------------------------------------

G = gen.GenParams(p=1 / 3, num_distractors=2, num_questions=2)
_Q = O._q
_TH = O.thread_render_sql(P.ft_max_tok, P.gen_max_tok, _caps_sql(P), None)


def _md5int(*parts: str) -> str:
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 12))::BIGINT"


def _idx_sql(src: str, id_expr: str, seed: str, cols: str = "*") -> str:
    return (f"SELECT {cols}, CAST(row_number() OVER (ORDER BY md5({_Q(seed + '|')} || CAST({id_expr} AS VARCHAR)), "
            f"{id_expr}) - 1 AS BIGINT) AS idx, count(*) OVER () AS n_total FROM {src}")


SAMPLED_SQL = _TH + f""",
idx0 AS ({_idx_sql('rendered', 'id', '42')}),
flag AS (SELECT id, post_id, full_thread, subthread, subthread_context,
                idx < floor(n_total * CAST({G.p!r} AS DOUBLE)) AS include_oracle FROM idx0),
sampled AS ({_idx_sql('flag', 'id', '42|again')})"""


def _sampled(spark, sf):
    return gen.sampled_threads(gen.thread_table(spark, sf), G)


@register("dense_index", _TH + f",\nix AS ({_idx_sql('rendered', 'id', '42')})\nSELECT id, idx FROM ix")
def q_dense_index(spark, sf):
    return sampling.dense_index(gen.thread_table(spark, sf), "id", 42).select("id", "idx")


@register("oracle_flag", SAMPLED_SQL + "\nSELECT id, include_oracle, idx FROM sampled")
def q_oracle_flag(spark, sf):
    return _sampled(spark, sf).select("id", "include_oracle", "idx")


DOC_IDX = _idx_sql("documents", "doc_id", "42", "doc_id")


@register("shuffled", f"SELECT doc_id, idx FROM ({DOC_IDX})")
def q_shuffled(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return sampling.dense_index(d, "doc_id", 42).select("doc_id", "idx")


@register("sample_n", f"SELECT doc_id, idx FROM ({DOC_IDX}) WHERE idx < 100")
def q_sample_n(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return sampling.sample_n(sampling.dense_index(d, "doc_id", 42), 100).select("doc_id", "idx")


SPLIT_SQL = (f"SELECT doc_id, CASE WHEN idx < ceil(n_total * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END "
             f"AS split FROM ({DOC_IDX})")


def _split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return sampling.split_labels(sampling.dense_index(d, "doc_id", 42), 0.2).select("doc_id", "split")


@register("split", SPLIT_SQL)
def q_split(spark, sf):
    return _split(spark, sf)


@register("split_counts", f"SELECT split, count(*) AS n FROM ({SPLIT_SQL}) GROUP BY split")
def q_split_counts(spark, sf):
    return _split(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


DIST_SQL = SAMPLED_SQL + f""",
dreq AS (SELECT id, j, idx, n_total FROM sampled, (SELECT unnest(range(0, {G.num_questions})) AS j)),
dr AS (SELECT *, {_md5int("'42'", 'id', 'CAST(j AS VARCHAR)', "'0'")} % (n_total - 1) + 1 AS o0,
              {_md5int("'42'", 'id', 'CAST(j AS VARCHAR)', "'1'")} % (n_total - 2) + 1 AS v1 FROM dreq),
dd AS (
  SELECT d.id, d.j, s.slot, t.id AS distractor_id
  FROM dr d CROSS JOIN (SELECT unnest([0, 1]) AS slot) s
  JOIN sampled t ON t.idx = (d.idx + CASE WHEN s.slot = 0 THEN d.o0
                                          ELSE d.v1 + CASE WHEN d.v1 >= d.o0 THEN 1 ELSE 0 END END) % d.n_total)"""


@register("distractors", DIST_SQL + "\nSELECT id, CAST(j AS INTEGER) AS j, CAST(slot AS INTEGER) AS slot, distractor_id FROM dd")
def q_distractors(spark, sf):
    s = _sampled(spark, sf)
    reqs = gen.requests(s, G).withColumnRenamed("thread_id", "id")
    d = sampling.distractors(s, reqs, G.num_distractors, G.seed)
    return d.select("id", F.col("j").cast("int"), F.col("slot").cast("int"), "distractor_id")


def _user_prompt_sql(thread: str, ctx: str) -> str:
    return (f"CASE WHEN {ctx} IS NOT NULL AND {ctx} <> '' THEN {_Q(PR.CONTEXT_FRAME_HEAD)} || {ctx} || "
            f"{_Q(PR.CONTEXT_FRAME_MID)} || {thread} || {_Q(PR.FRAME_TAIL)} "
            f"ELSE {_Q(PR.PLAIN_FRAME_HEAD)} || {thread} || {_Q(PR.FRAME_TAIL)} END")


REQS_SQL = DIST_SQL + f""",
reqs AS (SELECT id AS thread_id, CAST(j AS INTEGER) AS j FROM sampled, (SELECT unnest(range(0, {G.num_questions})) AS j)),
rdocs AS (SELECT doc_id, regexp_extract_all(text, {O.SENT_RE}) AS ss, text AS head FROM documents),
rr AS (SELECT q.thread_id, q.j, CAST(q.j AS BIGINT) AS jj, rd.doc_id AS d,
              CASE WHEN len(rd.ss) > 0 THEN rd.ss[q.j % len(rd.ss) + 1] ELSE '' END AS s1, rd.head
       FROM reqs q JOIN rdocs rd ON rd.doc_id = CAST(substr(q.thread_id, 4) AS BIGINT)),
resp AS (
  SELECT thread_id, j, 'question' AS stage, CAST(a AS INTEGER) AS attempt,
         CASE (d + 2 * jj + a) % 6
           WHEN 0 THEN '<question>' || chr(10) || s1 || chr(10) || '</question>'
           WHEN 1 THEN 'Sorry, I can''t help with that.'
           WHEN 2 THEN '```xml' || chr(10) || '<question>' || chr(10) || '</question>' || chr(10) || '```'
           WHEN 3 THEN '<question>' || chr(10) || s1
           WHEN 4 THEN '```xml' || chr(10) || '<question>' || chr(10) || s1 || chr(10) || '```'
           ELSE '<question>' || s1 || '</question>' || chr(10) END AS text
  FROM rr, range(0, 3) t(a) WHERE a <= (d + jj) % 3
  UNION ALL
  SELECT thread_id, j, 'answer' AS stage, CAST(a AS INTEGER) AS attempt,
         CASE (d + jj + a) % 4
           WHEN 0 THEN '<analysis>' || chr(10) || head || chr(10) || '</analysis>' || chr(10) || '<answer>' || chr(10)
                       || s1 || chr(10) || '</answer>'
           WHEN 1 THEN 'no analysis here'
           WHEN 2 THEN '<analysis>' || chr(10) || head || chr(10) || '</analysis>' || chr(10) || s1
           ELSE '<analysis>' || chr(10) || chr(10) || '</analysis>' || chr(10) || '<answer>' || chr(10) || s1
                || chr(10) || '</answer>' END AS text
  FROM rr, range(0, 3) t(a) WHERE a <= (d + jj + 1) % 3),
pq AS (
  SELECT thread_id, j, attempt, contains(text, '<question>') AS matched,
         regexp_replace(regexp_extract(text, {_Q(PR.QUESTION_RE)}, 1), {_Q(dataset.WS_STRIP)}, '', 'g') AS question
  FROM resp WHERE stage = 'question'),
pa AS (
  SELECT thread_id, j, attempt, regexp_matches(text, {_Q(PR.ANSWER_MATCH_RE)}) AS matched,
         regexp_replace(regexp_extract(text, {_Q(PR.ANSWER_RE)}, 1), {_Q(dataset.WS_STRIP)}, '', 'g') AS reasoning,
         regexp_replace(regexp_extract(text, {_Q(PR.ANSWER_RE)}, 2), {_Q(dataset.WS_STRIP)}, '', 'g') AS answer
  FROM resp WHERE stage = 'answer'),
fq AS (SELECT thread_id, j, min(attempt) FILTER (WHERE matched AND attempt < 5) AS first_ok,
              arg_min(question, attempt) FILTER (WHERE matched AND attempt < 5) AS question
       FROM pq GROUP BY thread_id, j),
fa AS (SELECT thread_id, j, min(attempt) FILTER (WHERE matched AND attempt < 5) AS first_ok,
              arg_min(reasoning, attempt) FILTER (WHERE matched AND attempt < 5) AS reasoning,
              arg_min(answer, attempt) FILTER (WHERE matched AND attempt < 5) AS answer
       FROM pa GROUP BY thread_id, j),
emb AS (SELECT q.thread_id, q.j, [CAST(x AS DOUBLE) FOR x IN e.embedding] AS embeddings
        FROM reqs q JOIN embeddings e ON e.vec_id = CAST(substr(q.thread_id, 4) AS BIGINT) + q.j),
st0 AS (
  SELECT q.thread_id, q.j, fq.question, fa.reasoning, fa.answer, emb.embeddings,
         CASE WHEN fq.first_ok IS NULL THEN 'failed'
              WHEN fq.question = '' THEN 'skipped'
              WHEN fa.first_ok IS NULL THEN 'failed'
              WHEN fa.reasoning = '' OR fa.answer = '' THEN 'skipped'
              WHEN emb.thread_id IS NULL THEN 'failed'
              ELSE 'ok' END AS status
  FROM reqs q LEFT JOIN fq USING (thread_id, j) LEFT JOIN fa USING (thread_id, j)
  LEFT JOIN emb USING (thread_id, j)),
st AS (
  SELECT * FROM (
    SELECT *, max(CASE WHEN status = 'skipped' THEN 1 ELSE 0 END) OVER (
             PARTITION BY thread_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_skip
    FROM st0) WHERE COALESCE(prev_skip, 0) = 0)"""


def _gen(spark, sf):
    return gen.generate_derived(spark, sf, gen.thread_table(spark, sf), G)


def _reqs_resp(spark, sf):
    s = _sampled(spark, sf)
    reqs = gen.requests(s, G)
    return s, reqs, gen.derived_responses(spark, sf, reqs)


@register("question_requests", REQS_SQL + f"""
SELECT id AS thread_id, CAST(j AS INTEGER) AS j,
       {_Q(PR.QUESTION_PROMPT + chr(10) + chr(10))} || {_user_prompt_sql('subthread', 'subthread_context')} AS request
FROM sampled, (SELECT unnest(range(0, {G.num_questions})) AS j)""")
def q_question_requests(spark, sf):
    return dataset.question_requests(_sampled(spark, sf), G.num_questions)


@register("parse_questions", REQS_SQL + "\nSELECT thread_id, j, attempt, matched, question FROM pq")
def q_parse_questions(spark, sf):
    _, _, resp = _reqs_resp(spark, sf)
    m, q = dataset.parse_question(F.col("text"))
    return resp.where("stage = 'question'").select("thread_id", "j", "attempt", m.alias("matched"),
                                                    q.alias("question"))


@register("parse_answers", REQS_SQL + "\nSELECT thread_id, j, attempt, matched, reasoning, answer FROM pa")
def q_parse_answers(spark, sf):
    _, _, resp = _reqs_resp(spark, sf)
    m, r, a = dataset.parse_answer(F.col("text"))
    return resp.where("stage = 'answer'").select("thread_id", "j", "attempt", m.alias("matched"),
                                                  r.alias("reasoning"), a.alias("answer"))


@register("open_requests", REQS_SQL + """,
early AS (SELECT * FROM resp WHERE attempt = 0),
q0 AS (SELECT thread_id, j, matched, question FROM pq WHERE attempt = 0),
a0 AS (SELECT thread_id, j, matched, reasoning, answer FROM pa WHERE attempt = 0),
s0 AS (
  SELECT q.thread_id, q.j, q0.thread_id IS NOT NULL AS q_tried, coalesce(q0.matched, false) AS q_ok, q0.question,
         a0.thread_id IS NOT NULL AS a_tried, coalesce(a0.matched, false) AS a_ok, a0.reasoning, a0.answer
  FROM reqs q LEFT JOIN q0 USING (thread_id, j) LEFT JOIN a0 USING (thread_id, j)),
blank0 AS (SELECT thread_id, min(j) AS e FROM s0 WHERE q_ok AND (question = '' OR (a_ok AND (reasoning = '' OR answer = ''))) GROUP BY thread_id)
SELECT thread_id, j, CASE WHEN q_ok THEN 'answer' ELSE 'question' END AS stage,
       CAST(CASE WHEN (NOT q_ok AND q_tried) OR (q_ok AND a_tried) THEN 1 ELSE 0 END AS INTEGER) AS attempt,
       CASE WHEN q_ok THEN question END AS question
FROM s0 LEFT JOIN blank0 USING (thread_id) WHERE (e IS NULL OR j <= e) AND (NOT q_ok OR (question <> '' AND NOT a_ok))""")
def q_open_requests(spark, sf):
    """D3, D10: what is to be asked next when the first attempts have been answered."""
    _, reqs, resp = _reqs_resp(spark, sf)
    return rounds.open_requests(reqs, resp.where("attempt = 0"))


@register("first_valid_response", REQS_SQL + """
SELECT thread_id, j, 'question' AS stage, first_ok FROM fq
UNION ALL SELECT thread_id, j, 'answer' AS stage, first_ok FROM fa""")
def q_first_valid_response(spark, sf):
    _, _, resp = _reqs_resp(spark, sf)
    q = dataset.first_valid(resp, "question").select("thread_id", "j", F.lit("question").alias("stage"), "first_ok")
    a = dataset.first_valid(resp, "answer").select("thread_id", "j", F.lit("answer").alias("stage"), "first_ok")
    return q.unionByName(a)


@register("answer_requests", REQS_SQL + f""",
aq AS (SELECT f.thread_id, f.j, f.question, s.subthread, s.subthread_context
       FROM fq f JOIN sampled s ON s.id = f.thread_id WHERE f.first_ok IS NOT NULL AND f.question <> '')
SELECT thread_id, j, {_Q(PR.ANSWER_PROMPT + chr(10) + chr(10))} || {_user_prompt_sql('subthread', 'subthread_context')}
       || {_Q(chr(10) + chr(10) + 'Here is the question:' + chr(10) + '```xml' + chr(10) + '<question>' + chr(10))}
       || question || {_Q(chr(10) + '</question>' + chr(10) + '```')} AS request
FROM aq""")
def q_answer_requests(spark, sf):
    s, _, resp = _reqs_resp(spark, sf)
    fq = dataset.first_valid(resp, "question").where("matched").select("thread_id", "j", "question")
    return dataset.answer_requests(s, fq)


@register("response_status", REQS_SQL + "\nSELECT thread_id, j, status FROM st")
def q_response_status(spark, sf):
    return _gen(spark, sf).status.select("thread_id", "j", "status")


@register("response_status_counts", REQS_SQL + "\nSELECT status, count(*) AS n FROM st GROUP BY status")
def q_response_status_counts(spark, sf):
    return _gen(spark, sf).status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


PROMPTS_SQL = REQS_SQL + """,
okr AS (SELECT st.*, s.include_oracle, s.full_thread FROM st JOIN sampled s ON s.id = st.thread_id WHERE status = 'ok'),
items AS (
  SELECT o.thread_id, o.j, d.distractor_id AS src, t.full_thread AS t
  FROM okr o JOIN dd d ON d.id = o.thread_id AND d.j = o.j JOIN sampled t ON t.id = d.distractor_id
  UNION ALL
  SELECT thread_id, j, thread_id AS src, full_thread AS t FROM okr WHERE include_oracle),
numbered AS (
  SELECT thread_id, j, t, row_number() OVER (PARTITION BY thread_id, j
           ORDER BY md5(concat_ws('|', '42', thread_id, CAST(j AS VARCHAR), src))) AS n FROM items),
ctx AS (
  SELECT thread_id, j, string_agg('<thread' || n || '>' || chr(10) || t || chr(10) || '</thread' || n || '>'
                                  || chr(10) || chr(10), '' ORDER BY n) AS ctx
  FROM numbered GROUP BY thread_id, j),
prompts AS (SELECT o.*, COALESCE(c.ctx, '') || 'Question: ' || o.question AS prompt
            FROM okr o LEFT JOIN ctx c USING (thread_id, j))"""


@register("assembled_prompts", PROMPTS_SQL + "\nSELECT thread_id, j, prompt FROM prompts")
def q_assembled_prompts(spark, sf):
    return _gen(spark, sf).prompts.select("thread_id", "j", "prompt")


@register("examples", PROMPTS_SQL + "\nSELECT prompt AS question, reasoning, answer FROM prompts")
def q_examples(spark, sf):
    return _gen(spark, sf).examples


@register("corpus", PROMPTS_SQL + "\nSELECT thread_id AS id, question AS query, full_thread AS thread, embeddings FROM prompts")
def q_corpus(spark, sf):
    return _gen(spark, sf).corpus


@register("sft_rows", PROMPTS_SQL + f"""
SELECT {_Q(PR.SYSTEM_PROMPT)} AS system, prompt AS "user",
       '<think>' || reasoning || '</think>' || chr(10) || '<answer>' || answer || '</answer>' AS assistant,
       {_Q(PR.SYSTEM_PROMPT + PR.EOS_TOKEN)} || prompt || '<think>' || reasoning || '</think>' || chr(10)
       || '<answer>' || answer || '</answer>' || {_Q(PR.EOS_TOKEN)} AS text
FROM prompts""")
def q_sft_rows(spark, sf):
    rows = chat.sft_messages(_gen(spark, sf).examples)
    return rows.withColumn("text", chat.render_sft(rows))


# ---------------------------------------------------------------------------
# retrieval and chat rendering
# ---------------------------------------------------------------------------

QUERIES_OF = 100  # the queries of ``cosine_topk`` and ``context_prompts``: every id divisible by it
TOP_K = 5
_COS = """CASE WHEN list_inner_product(qv, qv) * list_inner_product(cv, cv) = 0 THEN 0.0
          ELSE list_inner_product(qv, cv) / (sqrt(list_inner_product(qv, qv)) * sqrt(list_inner_product(cv, cv))) END"""
TOPK_SQL = f"""WITH ev AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS cv FROM embeddings),
qs AS (SELECT vec_id AS qid, cv AS qv FROM ev),
sc AS (SELECT qid, vec_id, round({_COS}, 12) AS score FROM qs, ev),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id ASC) AS rank FROM sc)"""


def _topk(spark, sf, every):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = (e if every == 1 else e.where(F.col("vec_id") % every == 0)).select(
        F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return retrieve.top_k(e, q, TOP_K)


@register("cosine_topk", TOPK_SQL + f"""
SELECT qid, vec_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM rk WHERE qid % {QUERIES_OF} = 0 AND rank <= {TOP_K}""")
def q_cosine_topk(spark, sf):
    return _topk(spark, sf, QUERIES_OF).select("qid", "vec_id", F.col("rank").cast("long"), F.round("score", 6).alias("score"))


@register("cosine_topk_batch", TOPK_SQL + f"""
SELECT qid, vec_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM rk WHERE rank <= {TOP_K}""")
def q_cosine_topk_batch(spark, sf):
    return _topk(spark, sf, 1).select("qid", "vec_id", F.col("rank").cast("long"),
                                              F.round("score", 6).alias("score"))


@register("context_prompts", TOPK_SQL + f""",
hits AS (SELECT r.qid, r.rank, coalesce(d.text, '') AS thread FROM rk r LEFT JOIN documents d ON d.doc_id = r.vec_id WHERE r.rank <= {TOP_K}),
blocks AS (SELECT qid, string_agg('<thread' || rank || '>' || chr(10) || thread || chr(10) || '</thread' || rank || '>',
                                  chr(10) || chr(10) ORDER BY rank) AS b FROM hits GROUP BY qid)
SELECT q.qid, CASE WHEN b.b IS NULL THEN '' ELSE b.b || chr(10) || chr(10) END || 'Question: ' || d.text AS prompt
FROM (SELECT qid FROM qs WHERE qid % {QUERIES_OF} = 0) q JOIN documents d ON d.doc_id = q.qid LEFT JOIN blocks b ON b.qid = q.qid""")
def q_context_prompts(spark, sf):
    hits = _topk(spark, sf, QUERIES_OF)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("thread"))
    questions = (table(spark, sf, "embeddings").where(F.col("vec_id") % QUERIES_OF == 0).select(F.col("vec_id").alias("qid"))
                 .join(table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("question")),
                       "qid"))
    return retrieve.context_prompts(hits, docs, questions)


@register("render_chat", f"""
WITH c AS (SELECT * FROM conversations),
firsts AS (SELECT conv_id, arg_min(role, (turn, role, text)) AS frole, arg_min(text, (turn, role, text)) AS ftext
           FROM c GROUP BY conv_id),
pieces AS (
  SELECT c.conv_id, c.turn, c.role, c.text,
         CASE WHEN c.role = 'user' THEN c.text WHEN c.role = 'assistant' THEN c.text || {_Q(PR.EOS_TOKEN)}
              ELSE '' END AS piece FROM c)
SELECT p.conv_id,
       CASE WHEN f.frole = 'system' THEN f.ftext || {_Q(PR.EOS_TOKEN)} ELSE {_Q(PR.SYSTEM_PROMPT + PR.EOS_TOKEN)} END
       || string_agg(p.piece, '' ORDER BY p.turn, p.role, p.text) AS text
FROM pieces p JOIN firsts f USING (conv_id) GROUP BY p.conv_id, f.frole, f.ftext""")
def q_render_chat(spark, sf):
    return chat.render_chat(table(spark, sf, "conversations"))


# ---------------------------------------------------------------------------
# dump export, CSV interchange, JSON-lines scan
# ---------------------------------------------------------------------------

def _lines(spark, sf, kind):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text", "source"))
    # written once, as a dump is: else the lines' own expression is copied into each field's
    return materialize(forest.dump_with_defects(docs, kind), f"{kind}_lines")


def _parsed(spark, sf, kind):
    return dumps.parse_lines(_lines(spark, sf, kind), kind)


_LINK = "'https://www.reddit.com/r/forum/comments/'"
EXPORT_POSTS_SQL = f"""WITH {O.FOREST}
SELECT 'u/user' || CAST(doc_id % 50 AS VARCHAR) AS author, split_part(text, chr(10), 1) AS title,
       CAST(score AS VARCHAR) AS score, strftime(created, {O.TS_FMT}) AS created,
       COALESCE(body0, '') AS text, 't3_' || CAST(doc_id AS VARCHAR) AS id,
       CASE WHEN doc_id % 80 = 0 THEN source ELSE '' END AS link_flair_text, distinguished,
       'forum' AS subreddit, {_LINK} || CAST(doc_id AS VARCHAR) || '/_/' AS link
FROM fbase WHERE doc_id % 40 = 0 AND doc_id % 50 NOT IN (7, 9, 10, 20, 30) AND doc_id % 3 <> 0"""

EXPORT_REPLIES_SQL = f"""WITH {O.FOREST}
SELECT 'u/user' || CAST(doc_id % 50 AS VARCHAR) AS author, CAST(score AS VARCHAR) AS score,
       strftime(created, {O.TS_FMT}) AS created, body0 AS body, 't1_' || CAST(doc_id AS VARCHAR) AS name,
       CASE WHEN pdoc % 40 = 0 THEN 't3_' ELSE 't1_' END || CAST(pdoc AS VARCHAR) AS parent_id, distinguished,
       'forum' AS subreddit,
       CASE WHEN doc_id % 3 <> 0 THEN {_LINK} || CAST(doc_id AS VARCHAR) || '/_/'
            ELSE {_LINK} || CAST(doc_id - doc_id % 40 AS VARCHAR) || '/_/' || CAST(doc_id AS VARCHAR) || '/' END AS link
FROM fparent WHERE doc_id % 50 NOT IN (7, 9, 11, 13, 17)"""


@register("project_posts", EXPORT_POSTS_SQL)
def q_project_posts(spark, sf):
    return dumps.export_records(_parsed(spark, sf, "posts"), "posts")


@register("project_replies", EXPORT_REPLIES_SQL)
def q_project_replies(spark, sf):
    return dumps.export_records(_parsed(spark, sf, "replies"), "replies")


@register("quarantine", """
SELECT doc_id AS line_no, 'posts' AS kind,
       CASE WHEN doc_id % 50 IN (7, 9, 10) THEN 'bad_json' WHEN doc_id % 3 = 0 THEN 'missing_key' ELSE 'bad_value' END AS status,
       CASE WHEN doc_id % 50 IN (7, 9, 10) THEN 'undecodable JSON' WHEN doc_id % 3 = 0 THEN 'no key link_id'
            ELSE 'created_utc is no number' END AS reason
FROM documents WHERE doc_id % 40 = 0 AND (doc_id % 50 IN (7, 9, 10, 20, 30) OR doc_id % 3 = 0)
UNION ALL
SELECT doc_id AS line_no, 'replies' AS kind, CASE WHEN doc_id % 50 IN (13, 17) THEN 'bad_value' ELSE 'bad_json' END AS status,
       CASE WHEN doc_id % 50 IN (13, 17) THEN 'created_utc is no number' ELSE 'undecodable JSON' END AS reason
FROM documents WHERE doc_id % 40 <> 0 AND doc_id % 50 IN (7, 9, 11, 13, 17)""")
def q_quarantine(spark, sf):
    out = []
    for kind in ("posts", "replies"):
        out.append(dumps.quarantine(_parsed(spark, sf, kind)).select("line_no", F.lit(kind).alias("kind"),
                                                                     "status", "reason"))
    return out[0].unionByName(out[1])


@register("ingest_metrics", f"""WITH {O.FOREST}
SELECT 'posts' AS kind, count(*) AS n_lines, count(*) FILTER (WHERE doc_id % 50 IN (7, 9, 10)) AS n_bad,
       count(*) FILTER (WHERE doc_id % 50 NOT IN (7, 9, 10) AND doc_id % 3 = 0) AS n_missing,
       count(*) FILTER (WHERE doc_id % 50 IN (20, 30) AND doc_id % 3 <> 0) AS n_bad_value,
       strftime(max(created) FILTER (WHERE doc_id % 50 NOT IN (7, 9, 10, 20, 30) AND doc_id % 3 <> 0), {O.TS_FMT}) AS last_created
FROM fbase WHERE doc_id % 40 = 0
UNION ALL
SELECT 'replies' AS kind, count(*) AS n_lines, count(*) FILTER (WHERE doc_id % 50 IN (7, 9, 11)) AS n_bad, 0 AS n_missing,
       count(*) FILTER (WHERE doc_id % 50 IN (13, 17)) AS n_bad_value,
       strftime(max(created) FILTER (WHERE doc_id % 50 NOT IN (7, 9, 11, 13, 17)), {O.TS_FMT}) AS last_created
FROM fbase WHERE doc_id % 40 <> 0""")
def q_ingest_metrics(spark, sf):
    out = []
    for kind in ("posts", "replies"):
        out.append(_parsed(spark, sf, kind).agg(*dumps.metrics_columns()).select(F.lit(kind).alias("kind"), "*"))
    return out[0].unionByName(out[1])


def _csv_roundtrip(spark, sf, kind):
    path = stage_path(spark, f"{kind}_csv")
    dumps.write_csv(dumps.export_records(_parsed(spark, sf, kind), kind, "line_no"), path)
    return dumps.read_posts_csv(spark, path) if kind == "posts" else dumps.read_replies_csv(spark, path)


@register("scan_posts", f"""WITH e AS ({EXPORT_POSTS_SQL})
SELECT id, author, title, CAST(score AS BIGINT) AS score, created,
       {O.nt('text')} AS body, {O.nt('link_flair_text')} AS link_flair_text, {O.nt('distinguished')} AS distinguished
FROM e""")
def q_scan_posts(spark, sf):
    p = _csv_roundtrip(spark, sf, "posts")
    return p.select("id", "author", "title", "score", _ts(), "body", "link_flair_text", "distinguished")


@register("scan_replies", f"""WITH e AS ({EXPORT_REPLIES_SQL})
SELECT name AS id, parent_id, author, CAST(score AS BIGINT) AS score, created, {O.nt('body')} AS body,
       {O.nt('distinguished')} AS distinguished
FROM e""")
def q_scan_replies(spark, sf):
    r = _csv_roundtrip(spark, sf, "replies")
    return r.select("id", "parent_id", "author", "score", _ts(), "body", "distinguished")


@register("ingest_lines", """
SELECT n, count(*) AS n_lines FROM (
  SELECT CASE WHEN doc_id % 50 = 9 THEN 'blank' WHEN doc_id % 50 = 7 THEN 'cut'
    WHEN doc_id % 50 = CASE WHEN doc_id % 40 = 0 THEN 10 ELSE 11 END THEN 'tail' ELSE 'object' END AS n FROM documents)
GROUP BY n""")
def q_ingest_lines(spark, sf):
    """Dump lines written as compressed text files, scanned back and told apart
    by their ends. gzip here: Spark's text writer has no zstd codec in this build."""
    path = stage_path(spark, "dump_gz")
    lines = _lines(spark, sf, "posts").unionByName(_lines(spark, sf, "replies")).select("value")
    lines.write.mode("overwrite").option("compression", "gzip").text(path)
    v = F.col("value")
    kind = (F.when(v == "", "blank").when(v.endswith("} tail"), "tail").when(v.startswith("{") & v.endswith("}"), "object").otherwise("cut"))
    return (dumps.read_lines(spark, path, int(spark.conf.get("spark.sql.shuffle.partitions")))
            .groupBy(kind.alias("n")).agg(F.count(F.lit(1)).alias("n_lines")))


@register("jsonl_scan", """
SELECT CASE WHEN bad THEN NULL ELSE CAST(vec_id AS VARCHAR) END AS id, CASE WHEN bad THEN '{not json' END AS corrupt,
       CASE WHEN bad THEN NULL ELSE [CAST(x AS DOUBLE) FOR x IN embedding] END AS embeddings
FROM (SELECT *, vec_id % 97 = 3 AS bad FROM embeddings)""")
def q_jsonl_scan(spark, sf):
    """Corpus JSON lines (with undecodable and blank lines) scanned with an
    explicit schema; bad lines land in ``_corrupt_record``, blank ones are skipped."""
    path = stage_path(spark, "corpus_jsonl")
    e = table(spark, sf, "embeddings")
    good = e.select(F.to_json(F.struct(F.col("vec_id").cast("string").alias("id"),
                                       F.col("vec_id").cast("string").alias("query"),
                                       F.lit("").alias("thread"),
                                       F.transform("embedding", lambda x: x.cast("double")).alias("embeddings")))
                    .alias("value"), "vec_id")
    lines = good.select(F.when(F.col("vec_id") % 97 == 3, F.lit("{not json")).otherwise(F.col("value")).alias("value"))
    blank = good.where("vec_id % 50 = 1").select(F.lit("").alias("value"))
    lines.unionByName(blank).write.mode("overwrite").text(path)
    scanned = files.read_json(spark, path, schemas.CORPUS, corrupt="_corrupt_record")
    return scanned.select("id", F.col("_corrupt_record").alias("corrupt"), "embeddings")


# ---------------------------------------------------------------------------
# sinks, repeated ids, requests with a system message, retrieval over a corpus
# ---------------------------------------------------------------------------

@register("examples_roundtrip", PROMPTS_SQL + "\nSELECT prompt AS question, reasoning, answer FROM prompts")
def q_examples_roundtrip(spark, sf):
    path = stage_path(spark, "examples_jsonl")
    files.write_json(_gen(spark, sf).examples, path)
    return files.read_json(spark, path, schemas.EXAMPLES)


@register("examples_ascii", PROMPTS_SQL + "\nSELECT prompt AS question, reasoning, answer, true AS ascii FROM prompts")
def q_examples_ascii(spark, sf):
    """K3: training rows through ASCII-escaped JSON lines and back, and whether every line was ASCII."""
    path = stage_path(spark, "examples_ascii")
    files.write_ascii_json(_gen(spark, sf).examples, path)
    wide = spark.read.text(path).where(F.col("value").rlike("[^\\x00-\\x7F]")).limit(1).select(F.lit(False).alias("ascii"))
    rows = files.read_json(spark, path, schemas.EXAMPLES).withColumn("_one", F.lit(1))
    # at most one row says that some line was not
    return (rows.join(F.broadcast(wide.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")
            .withColumn("ascii", F.coalesce("ascii", F.lit(True))))


@register("corpus_roundtrip", PROMPTS_SQL + "\nSELECT thread_id AS id, question AS query, full_thread AS thread, embeddings FROM prompts")
def q_corpus_roundtrip(spark, sf):
    path = stage_path(spark, "corpus_out")
    files.write_json(_gen(spark, sf).corpus, path)
    return files.read_json(spark, path, schemas.CORPUS)


@register("requests_with_system", REQS_SQL + f"""
SELECT id AS thread_id, CAST(j AS INTEGER) AS j, {_Q(PR.DEFAULT_GEN_SYSTEM)} AS system,
       {_Q(PR.QUESTION_PROMPT + chr(10) + chr(10))} || {_user_prompt_sql('subthread', 'subthread_context')} AS request
FROM sampled, (SELECT unnest(range(0, {G.num_questions})) AS j)""")
def q_requests_with_system(spark, sf):
    return dataset.with_system(dataset.question_requests(_sampled(spark, sf), G.num_questions))


def _repeated_forest(spark, sf):
    """The forest with later copies of a seventh of its messages under the same ids."""
    posts, replies = bt.filtered_forest(spark, sf)
    later = (F.col("created") + F.expr("interval 90 minutes")).alias("created")

    def twice(df):
        copy = df.where("ord % 7 = 3 or ord % 80 = 0").select(
            *[later if c == "created" else F.lit("copy").alias("body") if c == "body" else F.col(c) for c in df.columns])
        return df.unionByName(copy)
    return twice(posts), twice(replies)


_WORDS_SQL = f"""toks AS (
  SELECT doc_id, i, regexp_extract(t, {O._q(sentence_model.WORD_PARTS)}, 1) AS w0, regexp_extract(t, {O._q(sentence_model.WORD_PARTS)}, 2) AS behind
  FROM (SELECT doc_id, unnest(ts) AS t, unnest(range(len(ts))) AS i FROM (
    SELECT doc_id, list_filter(string_split_regex(text, '[{WS}]+'), lambda t: regexp_matches(t, '[\\p{{L}}\\p{{N}}]')) AS ts FROM documents))),
rows_ AS (SELECT lower(w0) AS w, regexp_matches(behind, '^\\.([^.]|$)') AS stop, lead(lower(w0)) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM toks),
per_word AS (SELECT w, CAST(count(*) FILTER (stop) AS BIGINT) AS n_stop, count(*) AS n FROM rows_ GROUP BY w),
tot AS (SELECT CAST(sum(n) AS DOUBLE) AS m, CAST(sum(n_stop) AS DOUBLE) AS s FROM per_word),
shape AS (SELECT *, s / m AS p, n - n_stop AS bare, length(w) - length(replace(w, '.', '')) AS inn, length(replace(w, '.', '')) AS letters
  FROM per_word CROSS JOIN tot WHERE n_stop > 0 AND regexp_matches(w, '\\p{{L}}')),
scored_ AS (SELECT w, n_stop, n,
    -2 * ((n_stop * ln(p) + bare * ln(1 - p)) - (n_stop * ln(0.99::DOUBLE) + bare * ln(1 - 0.99::DOUBLE)))
      * exp(-letters) * (inn + 1) * pow(CAST(letters AS DOUBLE), -CAST(bare AS DOUBLE)) AS score FROM shape)"""


def _stop_counts(spark, sf):
    msgs = spread(table(spark, sf, "documents").select(F.col("text").alias("body")))
    return materialize(sentence_model.stop_counts(msgs), "stop_counts")


@register("abbreviations", f"""WITH {_WORDS_SQL}
SELECT w, n_stop, n, round(score, 6) + 0::DOUBLE AS score, score >= {sentence_model.ABBREVIATION_SCORE} AS abbreviation FROM scored_""")
def q_abbreviations(spark, sf):
    """X3: how much each word and a full stop behind it belong together."""
    scores = sentence_model.abbreviation_scores(_stop_counts(spark, sf))
    return scores.select("w", "n_stop", "n", (F.round("score", 6) + F.lit(0.0)).alias("score"), (F.col("score") >= sentence_model.ABBREVIATION_SCORE).alias("abbreviation"))


@register("sentence_starters", f"""WITH {_WORDS_SQL},
ends AS (SELECT * FROM rows_ WHERE stop AND length(w) > 1 AND next IS NOT NULL AND w NOT IN (
  SELECT w FROM scored_ WHERE score >= {sentence_model.ABBREVIATION_SCORE})),
after_ AS (SELECT next AS w, count(*) AS ab FROM ends GROUP BY next),
x AS (SELECT a.w, a.ab, p.n AS b, (SELECT count(*) FROM ends) AS a, CAST((SELECT m FROM tot) AS BIGINT) AS m
  FROM after_ a JOIN per_word p ON p.w = a.w WHERE regexp_matches(a.w, '\\p{{L}}')),
q AS (SELECT *, b / m AS p, ab / a AS p1, (b - ab) / (m - a) AS p2, m - a - b + ab AS r FROM x WHERE ab * m > a * b)
SELECT w, ab AS n_after, b AS n, round(-2 * (ab * ln(p) + (a - ab) * ln(1 - p) + (b - ab) * ln(p) + r * ln(1 - p)
  - (ab * ln(p1) + CASE WHEN p1 < 1 THEN (a - ab) * ln(1 - p1) ELSE 0 END)
  - (CASE WHEN p2 > 0 THEN (b - ab) * ln(p2) ELSE 0 END + r * ln(1 - p2))), 4) AS score FROM q""")
def q_sentence_starters(spark, sf):
    """X3: how much each word and a sentence end before it belong together."""
    counts = _stop_counts(spark, sf)
    known = sentence_model.abbreviations(counts)
    return sentence_model.starter_scores(counts, known).select("w", "n_after", "n", F.round("score", 4).alias("score"))


def _tangled_forest(spark, sf):
    """The repeated forest, in which some replies answer one another in rings, themselves, or nothing."""
    posts, replies = _repeated_forest(spark, sf)
    block = F.expr("ord - ord % 40")
    ring = F.expr(f"CASE ord % 40 {' '.join(f'WHEN {a} THEN {b}' for a, b in RING.items())} END")
    parent = (F.when((block % 120 == 0) & ring.isNotNull(), F.concat(F.lit("t1_"), (block + ring).cast("string")))
              .when(F.col("ord") % 131 == 7, F.col("id")).when(F.col("ord") % 40 == 33, F.lit("t1_gone"))
              .when(F.col("ord") % 40 == 38, F.lit(None)).otherwise(F.col("parent_id")))
    return posts, replies.withColumn("parent_id", parent)


RING = {2: 6, 6: 19, 19: 22, 22: 2, 3: 9, 9: 3, 11: 6, 12: 11, 14: 12}  # two rings, and replies that lead into the first
TANGLED = f"""tangled AS (
  SELECT id, ord, CASE WHEN (ord - ord % 40) % 120 = 0 AND ord % 40 IN ({", ".join(map(str, RING))})
      THEN 't1_' || (ord - ord % 40 + CASE ord % 40 {" ".join(f"WHEN {a} THEN {b}" for a, b in RING.items())} END)
    WHEN ord % 131 = 7 THEN id WHEN ord % 40 = 33 THEN 't1_gone' WHEN ord % 40 = 38 THEN NULL ELSE parent_id END AS parent_id
  FROM kreplies),
chain(id, cur, path) AS (
  SELECT id, parent_id, [id] FROM tangled
  UNION ALL
  SELECT c.id, t.parent_id, list_append(c.path, t.id) FROM chain c JOIN tangled t ON c.cur = t.id WHERE NOT list_contains(c.path, c.cur)),
ends AS (
  SELECT *, list_contains(path, cur) AS ring FROM chain c
  WHERE list_contains(path, cur) OR cur IS NULL OR cur NOT IN (SELECT id FROM tangled))"""


@register("tangled_attached", f"""WITH RECURSIVE {O.FOREST},{TANGLED}
SELECT id, cur AS post_id, CAST(len(path) AS BIGINT) AS depth FROM ends WHERE cur IN (SELECT id FROM kposts)""")
def q_tangled_attached(spark, sf):
    """T3, T4 over repeated ids and rings: one row of each attached id."""
    return tree.attach_all(*_tangled_forest(spark, sf)).select("id", "post_id", F.col("depth").cast("long"))


@register("tangled_parents", f"""WITH RECURSIVE {O.FOREST},{TANGLED}
SELECT t.id, t.parent_id, p.id AS parent_reply_id, p.ord AS parent_ord FROM tangled t LEFT JOIN tangled p ON t.parent_id = p.id""")
def q_tangled_parents(spark, sf):
    """T1 over repeated ids."""
    _, replies = _tangled_forest(spark, sf)
    return tree.parent_lookup(replies).select("id", "parent_id", "parent_reply_id", "parent_ord")


@register("detached_reasons", f"""WITH RECURSIVE {O.FOREST},{TANGLED}
SELECT id, CASE WHEN ring THEN 'cycle' WHEN cur IN (SELECT id FROM fposts UNION ALL SELECT id FROM freplies) THEN 'filtered ancestor'
    ELSE 'no parent' END AS reason,
  CASE WHEN ring THEN list_min(path[list_position(path, cur):]) ELSE cur END AS "at"
FROM ends WHERE cur IS NULL OR cur NOT IN (SELECT id FROM kposts)""")
def q_detached_reasons(spark, sf):
    """T3: why a reply is under no kept post."""
    posts, replies = _tangled_forest(spark, sf)
    every = bt.load_forest(spark, sf)
    return tree.detached(posts, replies, every[0].select("id").unionByName(every[1].select("id")))


@register("deduped_threads", O.thread_render_sql(P.ft_max_tok, P.gen_max_tok, _caps_sql(P), THREAD_COLS))
def q_deduped_threads(spark, sf):
    return bt.build_threads(*_repeated_forest(spark, sf), P)


@register("duplicate_ids", f"""WITH {O.FOREST}
SELECT 'posts' AS kind, count(*) FILTER (ord % 7 = 3 OR ord % 80 = 0) AS n_dropped FROM kposts
UNION ALL SELECT 'replies', count(*) FILTER (ord % 7 = 3 OR ord % 80 = 0) FROM kreplies""")
def q_duplicate_ids(spark, sf):
    posts, replies = _repeated_forest(spark, sf)
    return tree.duplicate_count(posts, "posts").unionByName(tree.duplicate_count(replies, "replies"))


@register("corpus_hits", PROMPTS_SQL + f""",
cv AS (SELECT thread_id || ':' || j AS cid, question AS query, full_thread AS thread, embeddings AS cv FROM prompts),
qv AS (SELECT vec_id AS qid, [CAST(x AS DOUBLE) FOR x IN embedding] AS qv FROM embeddings),
sc AS (SELECT qid, cid, query, thread, round(list_inner_product(qv, cv) / (sqrt(list_inner_product(qv, qv)) * sqrt(list_inner_product(cv, cv))), 12) AS score FROM qv, cv),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rank FROM sc)
SELECT qid, CAST(rank AS BIGINT) AS rank, query, md5(thread) AS thread_md5, round(score, 6) AS score FROM rk WHERE rank <= {TOP_K}""")
def q_corpus_hits(spark, sf):
    """R1 over the retrieval corpus: every embedding as a query, hits as query, thread, score."""
    prompts = _gen(spark, sf).rows
    corpus = prompts.select(F.concat_ws(":", "thread_id", "j").alias("id"), F.col("question").alias("query"),
                            F.col("full_thread").alias("thread"), "embeddings")
    corpus = materialize(corpus, "corpus")  # counted, cut into cells and joined to the hits
    queries = table(spark, sf, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    hits = retrieve.hits(corpus, queries, TOP_K)
    return hits.select("qid", F.col("rank").cast("long"), "query", F.md5("thread").alias("thread_md5"), F.round("score", 6).alias("score"))
