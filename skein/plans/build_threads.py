"""Job A: posts + replies -> thread rows (id, post_id, full_thread, subthread,
subthread_context).

scan -> quality filter -> frontier joins (max_depth + 1 levels) -> reply
counts -> top-k per parent -> long thread rows -> token totals -> (over
budget only) water-filling caps -> summaries -> render.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.counters import Counter, PatternCounter
from skein.functions.text import string_tokens
from skein.operators import budget, clean, reading_order, summarize, threads, tree
from skein.operators.sentence_model import SentenceModel
from skein.session import materialize, stage_run
from skein.sources import dumps, files, forest
from skein.sources.tables import table


@dataclass(frozen=True)
class ThreadParams:
    min_score: int = 5
    max_depth: int = 3
    max_replies: int = 3
    ft_max_tok: int = 4000
    gen_max_tok: int = 10000
    #: token counters of the two budgets; None is the built-in one, counted natively
    ft_counter: Counter | None = None
    gen_counter: Counter | None = None
    #: how summaries split sentences; None is the fixed pattern
    sentence_model: SentenceModel | None = None

    @property
    def native(self) -> bool:
        return self.ft_counter is None and self.gen_counter is None

    @property
    def counters(self) -> tuple[Counter, Counter]:
        return self.ft_counter or PatternCounter(), self.gen_counter or PatternCounter()

    def validate(self) -> None:
        budget.check_limits(self.ft_max_tok, self.gen_max_tok)
        if self.max_depth < 0 or self.max_replies < 1:
            raise ValueError("max_depth must be >= 0 and max_replies >= 1")


STRING_COLS_POSTS = ["author", "title", "body", "link_flair_text", "distinguished"]
STRING_COLS_REPLIES = ["author", "body", "parent_id", "distinguished"]


def load_forest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Posts and replies from ``documents``, missing-value strings nulled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    posts = clean.normalize_nulls(forest.forest_posts(docs), STRING_COLS_POSTS)
    replies = clean.normalize_nulls(forest.forest_replies(docs), STRING_COLS_REPLIES)
    return posts, replies


def filtered_forest(spark: SparkSession, sf_dir: str, min_score: int = 5) -> tuple[DataFrame, DataFrame]:
    posts, replies = load_forest(spark, sf_dir)
    return clean.quality_filter(posts, min_score), clean.quality_filter(replies, min_score)


@dataclass
class ThreadStages:
    """Intermediate tables of job A (all lazy)."""
    nodes: DataFrame      # posts + attached replies (depth <= max_depth+1), num_replies
    rows: DataFrame       # long thread rows
    records: DataFrame    # message records (head, body, token counts)
    long: DataFrame       # rows with their messages' token counts
    totals: DataFrame     # per-focus token totals, and the sums of their messages' counts


def stages(posts: DataFrame, replies: DataFrame, p: ThreadParams, persist: bool = True) -> ThreadStages:
    """``persist`` writes the forest and the long rows as stage tables (each is
    read by several later steps); without it everything stays one lazy plan."""
    nodes = threads.forest_nodes(posts, replies, p.max_depth)
    if persist:
        nodes = materialize(nodes, "nodes")
    rows = threads.thread_rows(nodes, p.max_depth, p.max_replies)
    kept_replies = nodes.where(F.col("depth") >= 1)
    records = threads.message_records(posts, kept_replies)
    # counts only: a message's text is in many threads, its copies are made when they are rendered
    counts = records.select("msg_id", "head_tok", "tok_body") if p.native else budget.message_counts(records, *p.counters)
    long = rows.join(counts, "msg_id")
    if persist:
        long = materialize(long, "long")
    totals = budget.thread_totals(long) if p.native else budget.totals_of_parts(long, *p.counters)
    return ThreadStages(nodes, rows, records, long, totals)


def over_budget_messages(st: ThreadStages, p: ThreadParams) -> DataFrame:
    """focus_id, view ('ft' | 'gen'), msg_id, tok, budget for every message of
    every thread view over its limit; tokens by the view's counter."""
    text = dict.fromkeys(budget.VIEWS, "text_total") if p.native else {v: f"{v}_text" for v in budget.VIEWS}
    tok = dict.fromkeys(budget.VIEWS, "tok_body") if p.native else {v: f"{v}_tok" for v in budget.VIEWS}
    limit = {"ft": p.ft_max_tok, "gen": p.gen_max_tok}
    views = st.totals.select("focus_id", F.explode(F.array(*[
        F.struct(F.lit(v).alias("view"), F.col(f"{v}_total").alias("total"), F.col(text[v]).alias("text"), F.lit(limit[v]).alias("lim"))
        for v in budget.VIEWS])).alias("v")).select("focus_id", "v.*").where(F.col("total") > F.col("lim"))
    views = views.withColumn("budget", F.greatest(F.lit(1).cast("long"), F.col("lim") - (F.col("total") - F.col("text"))))
    own = F.when(F.col("view") == "ft", F.col(tok["ft"])).otherwise(F.col(tok["gen"]))
    return (st.long.join(views.select("focus_id", "view", "budget"), "focus_id")
            .select("focus_id", "view", "msg_id", own.alias("tok"), "budget"))


def cut_bodies(st: ThreadStages, p: ThreadParams) -> DataFrame:
    """focus_id, msg_id, body_ft_cut, body_gen_cut: summaries replacing bodies
    that must shrink (only for over-budget views)."""
    caps = budget.waterfill_caps(over_budget_messages(st, p), ["focus_id", "view"])
    # small (over-budget messages only) and read twice below
    caps = materialize(caps.where(F.col("cap") != F.col("tok")).select("focus_id", "view", "msg_id", "cap"), "caps")
    bodies = st.records.select("msg_id", "body")

    def cut(own: DataFrame, counter=string_tokens) -> DataFrame:
        # a message's caps (one for each thread and view that cuts it) are met in one pass over its text
        wanted = own.groupBy("msg_id").agg(F.collect_set("cap").alias("caps"))
        return own.join(summarize.summaries(bodies.join(wanted, "msg_id"), counter, model=p.sentence_model), ["msg_id", "cap"])

    if p.native:
        done = cut(caps)
    elif p.counters[0] == p.counters[1]:
        done = cut(caps, p.counters[0])
    else:
        ft, gen = (cut(caps.where(F.col("view") == v), c) for v, c in zip(budget.VIEWS, p.counters))
        done = ft.unionByName(gen)
    return done.groupBy("focus_id", "msg_id").agg(
        F.max(F.when(F.col("view") == "ft", F.col("summary"))).alias("body_ft_cut"),
        F.max(F.when(F.col("view") == "gen", F.col("summary"))).alias("body_gen_cut"))


def _rendered(st: ThreadStages, p: ThreadParams) -> DataFrame:
    cut = cut_bodies(st, p)
    rows = (st.long.join(cut, ["focus_id", "msg_id"], "left").join(st.records.select("msg_id", "head", "body"), "msg_id")
            # a body travels once; views that do not cut it take it after the grouping
            .select("focus_id", "post_id", "kind", "pos", "head", F.when(F.col("body_ft_cut").isNull() | F.col("body_gen_cut").isNull(), F.col("body")).alias("body"),
                    F.col("body_ft_cut").alias("body_ft"), F.col("body_gen_cut").alias("body_gen")))
    return threads.render_threads(rows)


def build_threads(posts: DataFrame, replies: DataFrame, p: ThreadParams = ThreadParams()) -> DataFrame:
    """Threads of the filtered posts and replies; of an id that repeats the earliest message counts."""
    p.validate()
    return _rendered(stages(tree.dedupe_by_id(posts), tree.dedupe_by_id(replies), p), p)


def threads_in_order(posts: DataFrame, replies: DataFrame, p: ThreadParams = ThreadParams()) -> DataFrame:
    """``build_threads`` with ``position``: the place of each row when every post is
    read from top to bottom, replies by rank, a reply's own replies after it."""
    p.validate()
    st = stages(tree.dedupe_by_id(posts), tree.dedupe_by_id(replies), p)
    return _rendered(st, p).join(reading_order.positions(st.nodes, p.max_depth), "id")


def write_threads(spark: SparkSession, posts_csv: str, replies_csv: str, out_path: str, p: ThreadParams = ThreadParams()) -> None:
    """Job A on paths: exported CSV of posts and replies -> a thread table in
    reading order (its files by name, the rows within each)."""
    posts = clean.quality_filter(dumps.read_posts_csv(spark, posts_csv), p.min_score)
    replies = clean.quality_filter(dumps.read_replies_csv(spark, replies_csv), p.min_score)
    with stage_run(spark):
        # read once: several steps use them
        placed = threads_in_order(materialize(posts, "posts"), materialize(replies, "replies"), p)
        files.write_threads(placed, out_path, "position")
