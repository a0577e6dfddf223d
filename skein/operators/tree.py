"""Reply-tree operators: parent lookup, detached pruning, depth, post
attribution, ancestor paths, child counts, sibling ranking and top-k.

The tree is never materialised as a graph. Attachment is a level-wise
equi-join (the "frontier"): level 1 = replies whose parent is a kept post,
level n+1 = replies whose parent is in level n. A reply is attached iff its
parent is a kept post or an attached reply, which is exactly what the union
of levels holds; cycles are never reached because every chain starts at a
post. For threads only ``max_depth + 1`` levels are needed, so the loop is
unrolled at plan time into one lazy plan. The replies side of every level is
the same hash-partitioned exchange on ``parent_id`` (re-used by the planner);
only the small frontier is shuffled per level. A hot parent (one viral post)
lands in one join partition; AQE's skew-join splits it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.session import materialize

REPLY_COLS = ["id", "parent_id", "author", "score", "created", "body", "distinguished", "ord"]


def duplicate_count(df: DataFrame, kind: str) -> DataFrame:
    """kind, n_dropped: rows that ``dedupe_by_id`` leaves out (ids only are shuffled)."""
    per_id = df.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_dropped")).select(
        F.lit(kind).alias("kind"), "n_dropped")


def dedupe_by_id(df: DataFrame) -> DataFrame:
    """One row per id: the earliest ``(created, ord)``. Ids are counted first;
    rows with bodies are only shuffled when some id repeats."""
    if not duplicate_count(df, "").first()["n_dropped"]:
        return df
    w = Window.partitionBy("id").orderBy(F.col("created").asc_nulls_last(), F.col("ord").asc())
    return df.withColumn("_dup_rn", F.row_number().over(w)).where("_dup_rn = 1").drop("_dup_rn")


def _one_of_each(rows: DataFrame) -> DataFrame:
    """The earliest ``(created, ord)`` of the rows of an id; for rows that were
    just joined on id, so that the window needs no further exchange."""
    w = Window.partitionBy("id").orderBy(F.col("created").asc_nulls_last(), F.col("ord").asc())
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def _earliest(replies: DataFrame) -> DataFrame:
    """id, parent_id, ord of the earliest row of each id (no bodies are shuffled)."""
    first = F.min(F.struct(F.col("created").isNull().alias("undated"), "created", "ord", "parent_id")).alias("f")
    return replies.groupBy("id").agg(first).select("id", "f.parent_id", "f.ord")


def parent_lookup(replies: DataFrame) -> DataFrame:
    """Each reply with its parent reply's id and ord (null when the parent is
    not a reply in the table): a left equi self-join. Of an id that repeats the
    earliest row counts, as reply and as parent."""
    rows = dedupe_by_id(replies)
    parents = _earliest(replies).select(F.col("id").alias("_pid"), F.col("ord").alias("parent_ord"))
    return (rows.join(parents, rows["parent_id"] == parents["_pid"], "left")
            .select(*[rows[c] for c in replies.columns],
                    F.col("_pid").alias("parent_reply_id"), "parent_ord"))


def root_semi(replies: DataFrame, posts: DataFrame) -> DataFrame:
    """Replies whose parent is a kept post (left semi join)."""
    return replies.join(posts.select(F.col("id").alias("_post")),
                        replies["parent_id"] == F.col("_post"), "left_semi")


def _roots(posts: DataFrame) -> DataFrame:
    return posts.select(F.col("id").alias("_pid"), F.col("id").alias("post_id"),
                        F.array(F.col("id")).alias("_ppath"))


def _level(replies: DataFrame, frontier: DataFrame, depth: int) -> DataFrame:
    # name-based columns with fresh aliases: a checkpointed frontier keeps the
    # attribute ids of the plan it came from, which would make the self-join
    # with ``replies`` ambiguous
    f = frontier.select(F.col("_pid").alias("_fid"), F.col("post_id").alias("_fpost"),
                        F.col("_ppath").alias("_fpath"))
    return (replies.join(f, F.col("parent_id") == F.col("_fid"), "inner")
            .select(*[F.col(c) for c in replies.columns],
                    F.col("_fpost").alias("post_id"),
                    F.lit(depth).alias("depth"),
                    F.concat(F.col("_fpath"), F.array(F.col("id"))).alias("path")))


def attach_levels(posts: DataFrame, replies: DataFrame, max_level: int, stage: bool = False) -> DataFrame:
    """Attached replies with ``post_id``, ``depth`` (1 under a post) and
    ``path`` (ids root .. self), for depths 1..max_level. One lazy plan, in
    which a level is made again for each later one; ``stage`` writes every
    level once instead (for narrow replies: ids only)."""
    if max_level < 1:
        raise ValueError("max_level must be >= 1")
    frontier = _roots(posts)
    levels = []
    for depth in range(1, max_level + 1):
        lvl = _level(replies, frontier, depth)
        if stage:
            lvl = materialize(lvl, "level")
        levels.append(lvl)
        frontier = lvl.select(F.col("id").alias("_pid"), "post_id", F.col("path").alias("_ppath"))
    return reduce(DataFrame.unionByName, levels)


CLIMBING, AT_POST, AT_END = 0, 1, 2


def _climb(posts: DataFrame, replies: DataFrame) -> DataFrame:
    """id, up, dist, low, kind of each reply id: where its chain of parents ends.

    Pointer doubling on narrow columns: every reply points at its parent with
    distance 1; in each round a reply whose pointer is a reply takes over that
    reply's pointer, adds its distance and keeps the smaller of both labels
    ``low`` (the smallest id from the reply up to, not including, its pointer).
    A chain of depth d is done after log2(d) rounds, at a kept post (``AT_POST``)
    or at an id that is no kept message (``AT_END``). Of the chains that end, the
    unfinished reply nearest to its end is finished in each round; so when a
    round finishes none, what is left leads into cycles. A few more rounds, until the
    pointers have gone further than there are such replies, put every pointer
    on its cycle and the cycle's smallest id into its label.

    Of an id that repeats the earliest row counts. Each round is written to the
    shared folder."""
    roots = posts.select(F.col("id").alias("_root")).distinct()
    own = _earliest(replies).select("id", F.col("parent_id").alias("up"))
    known = own.select(F.col("id").alias("_reply"))
    start = (own.join(roots, F.col("up") == F.col("_root"), "left").join(known, F.col("up") == F.col("_reply"), "left")
             .select("id", "up", F.lit(1).cast("long").alias("dist"), F.col("id").alias("low"),
                     F.when(F.col("_root").isNotNull(), AT_POST).when(F.col("_reply").isNotNull(), CLIMBING).otherwise(AT_END).alias("kind")))
    state = materialize(start, "pointers")
    left, reach = state.where(F.col("kind") == CLIMBING).count(), 1
    finished = True
    while left and (finished or reach < left):
        at = state.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("dist").alias("_dist"),
                          F.col("low").alias("_low"), F.col("kind").alias("_kind"))
        climbing = state.where(F.col("kind") == CLIMBING)
        moved = climbing.join(at, F.col("up") == F.col("_id")).select(
            "id", F.col("_up").alias("up"), (F.col("dist") + F.col("_dist")).alias("dist"),
            F.least("low", "_low").alias("low"), F.col("_kind").alias("kind"))
        state = materialize(state.where(F.col("kind") != CLIMBING).unionByName(moved), "pointers")
        now = state.where(F.col("kind") == CLIMBING).count()
        finished, left, reach = now < left, now, 2 * reach
    return state


def attach_all(posts: DataFrame, replies: DataFrame) -> DataFrame:
    """All attached replies at every depth, with ``post_id`` and ``depth``; one
    row of each id. The other columns are joined once, at the end."""
    found = (_climb(posts, replies).where(F.col("kind") == AT_POST)
             .select("id", F.col("up").alias("post_id"), F.col("dist").cast("int").alias("depth")))
    return _one_of_each(replies.join(found, "id")).select(*replies.columns, "post_id", "depth")


def detached(posts: DataFrame, replies: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """id, reason, at of each reply id without a kept post above it.

    ``no parent``: the chain ends at an id that no message has (``at``; null
    for a null parent); ``filtered ancestor``: it ends at a message of ``removed`` (ids),
    that is one the filter took out; ``cycle``: it never ends, ``at`` is the
    smallest id of the cycle that it is in or leads into."""
    state = _climb(posts, replies)
    ended = state.where(F.col("kind") == AT_END).select("id", F.col("up").alias("at"))
    if removed is None:
        ended = ended.withColumn("_gone", F.lit(None).cast("string"))
    else:
        ended = ended.join(removed.select(F.col("id").alias("_gone")).distinct(), F.col("at") == F.col("_gone"), "left")
    reason = F.when(F.col("_gone").isNotNull(), "filtered ancestor").otherwise("no parent").alias("reason")
    circling = state.where(F.col("kind") == CLIMBING)
    label = circling.select(F.col("id").alias("_on"), F.col("low").alias("at"))
    cycles = circling.join(label, F.col("up") == F.col("_on")).select("id", F.lit("cycle").alias("reason"), "at")
    return ended.select("id", reason, "at").unionByName(cycles)


def with_posts_as_nodes(posts: DataFrame, attached: DataFrame) -> DataFrame:
    """Posts as depth-0 nodes next to attached replies (common node schema)."""
    p = posts.select(
        "id", F.lit(None).cast("string").alias("parent_id"), "author", "score", "created",
        "body", "distinguished", "ord", F.col("id").alias("post_id"),
        F.lit(0).alias("depth"), F.array("id").alias("path"))
    return p.unionByName(attached.select(*p.columns))


def child_counts(kept: DataFrame) -> DataFrame:
    """Number of kept direct replies per parent id (partial aggregation before
    the shuffle, so a hot parent costs one row per map task)."""
    return kept.groupBy(F.col("parent_id").alias("cid")).agg(F.count(F.lit(1)).alias("num_replies"))


def with_reply_counts(nodes: DataFrame, kept_replies: DataFrame) -> DataFrame:
    counts = child_counts(kept_replies)
    return (nodes.join(counts, nodes["id"] == counts["cid"], "left")
            .drop("cid").withColumn("num_replies", F.coalesce("num_replies", F.lit(0)).cast("long")))


def sibling_order():
    """Score desc, number of kept replies desc, then chronological, then input order."""
    return [F.col("score").desc(), F.col("num_replies").desc(),
            F.col("created").asc(), F.col("ord").asc()]


def rank_replies(replies_with_counts: DataFrame) -> DataFrame:
    """1-based rank among siblings (same parent)."""
    w = Window.partitionBy("parent_id").orderBy(*sibling_order())
    return replies_with_counts.withColumn("rank", F.row_number().over(w))


def rank_replies_spread(replies_with_counts: DataFrame, partitions: int | None = None) -> DataFrame:
    """Same ranks as ``rank_replies`` for every reply, without putting a hot
    parent's replies into one window task (range-partitioned ranking)."""
    from skein.operators.ordering import rank_within_groups

    return rank_within_groups(replies_with_counts, "parent_id", sibling_order(), "rank", partitions)


def top_replies(replies_with_counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` best replies per parent. ``rank <= k`` right above the window
    lets the planner add a partial WindowGroupLimit before the shuffle, so a
    hot parent ships at most k rows per map task."""
    return rank_replies(replies_with_counts).where(F.col("rank") <= F.lit(k))
