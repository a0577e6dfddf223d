"""Thread assembly: one output row per kept message that has kept replies.

A thread is held in *long form* (focus_id, kind, pos, msg_id): the focus's
ancestors (``kind='ancestor'``, pos = depth), the focus itself (pos = its
depth) and its top-k replies (pos = depth + rank). Each group has at most
``max_depth + 1 + k`` rows, so per-focus aggregation is bounded whatever the
shape of the forest. The JSON views are rendered from those rows with
higher-order functions; nesting needs no recursion because every ancestor
holds exactly one child (the next node on the path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import json_string, string_tokens
from skein.operators import tree
from skein.session import materialize

PLACEHOLDER_BODY = "..."


def forest_nodes(posts: DataFrame, replies: DataFrame, max_depth: int) -> DataFrame:
    """Posts (depth 0) and attached replies down to ``max_depth + 1`` with
    ``post_id``, ``depth``, ``path`` and ``num_replies`` (kept direct replies).

    The levels are joined on ids alone and written once each; bodies come in
    by one join at the end."""
    ids = materialize(replies.select("id", "parent_id"), "reply_ids")
    levels = tree.attach_levels(posts.select("id"), ids, max_depth + 1, stage=True)
    attached = replies.join(levels.select("id", "post_id", "depth", "path"), "id")
    nodes = tree.with_posts_as_nodes(posts, attached)
    return tree.with_reply_counts(nodes, levels)


def thread_rows(nodes: DataFrame, max_depth: int, k: int) -> DataFrame:
    """Long rows of every thread: focus_id, post_id, focus_depth, kind, pos, msg_id."""
    focus = nodes.where((F.col("depth") <= max_depth) & (F.col("num_replies") > 0))
    path_rows = (focus.select(F.col("id").alias("focus_id"), "post_id",
                              F.col("depth").alias("focus_depth"),
                              F.posexplode("path").alias("pos", "msg_id"))
                 .withColumn("kind", F.when(F.col("pos") == F.col("focus_depth"), F.lit("focus"))
                             .otherwise(F.lit("ancestor"))))
    replies = nodes.where(F.col("depth") >= 1)
    top = tree.top_replies(replies, k)
    reply_rows = top.select(
        F.col("parent_id").alias("focus_id"), "post_id",
        (F.col("depth") - 1).alias("focus_depth"),
        (F.col("depth") - 1 + F.col("rank")).cast("int").alias("pos"),
        F.col("id").alias("msg_id"),
        F.lit("reply").alias("kind"))
    return path_rows.select("focus_id", "post_id", "focus_depth", "kind",
                            F.col("pos").cast("int").alias("pos"), "msg_id").unionByName(reply_rows)


# --- message records -------------------------------------------------------

def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}": '), json_string(value))


def message_records(posts: DataFrame, replies: DataFrame) -> DataFrame:
    """Per message: ``head`` (its JSON record up to and including ``"body": ``),
    ``body``, and token counts ``head_tok`` (record without body, braces
    included) and ``tok_body`` (body as a JSON string value).

    Record keys and their order follow the reference: posts
    ``id, author, title, [flair], body``; replies ``id, parent_id, author, body``.
    Flair appears only when present and non-empty.
    """
    flair = F.col("link_flair_text")
    has_flair = flair.isNotNull() & (flair != "")
    post_head = F.concat(
        F.lit("{"), _field("id", F.col("id")), F.lit(", "),
        _field("author", F.col("author")), F.lit(", "),
        _field("title", F.col("title")), F.lit(", "),
        F.when(has_flair, F.concat(_field("flair", flair), F.lit(", "))).otherwise(F.lit("")),
        F.lit('"body": '))
    # 5 tokens per key ("key": plus a comma or closing brace) + opening brace
    post_head_tok = (F.when(has_flair, F.lit(26)).otherwise(F.lit(21))
                     + string_tokens(F.col("id")) + string_tokens(F.col("author"))
                     + string_tokens(F.col("title"))
                     + F.when(has_flair, string_tokens(flair)).otherwise(F.lit(0)))
    p = posts.select(F.col("id").alias("msg_id"), post_head.alias("head"), "body",
                     post_head_tok.cast("long").alias("head_tok"))
    reply_head = F.concat(
        F.lit("{"), _field("id", F.col("id")), F.lit(", "),
        _field("parent_id", F.col("parent_id")), F.lit(", "),
        _field("author", F.col("author")), F.lit(", "), F.lit('"body": '))
    reply_head_tok = (F.lit(21) + string_tokens(F.col("id")) + string_tokens(F.col("parent_id"))
                      + string_tokens(F.col("author")))
    r = replies.select(F.col("id").alias("msg_id"), reply_head.alias("head"), "body",
                       reply_head_tok.cast("long").alias("head_tok"))
    return p.unionByName(r).withColumn("tok_body", string_tokens(F.col("body")))


# --- rendering ---------------------------------------------------------------

def _js(c: Column) -> Column:
    return json_string(c)


def render_threads(rows: DataFrame) -> DataFrame:
    """Render the three JSON views per focus.

    ``rows``: focus_id, post_id, kind, pos, head, body, body_ft, body_gen, where the
    last two are the message text after the fine-tune and the generation
    budget, null where ``body`` was not cut.
    """
    views = ["body_ft", "body_gen"]
    g = rows.groupBy("focus_id", "post_id").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "head", *views, "body"))).alias("m"))
    g = g.withColumn("m", F.transform("m", lambda x: F.struct(
        x["kind"].alias("kind"), x["head"].alias("head"), *(F.coalesce(x[v], x["body"]).alias(v) for v in views))))
    anc = F.filter("m", lambda x: x["kind"] == "ancestor")
    foc = F.filter("m", lambda x: x["kind"] == "focus")[0]
    rep = F.filter("m", lambda x: x["kind"] == "reply")
    n_anc = F.size(anc)
    closers = F.repeat(F.lit("]}"), n_anc)

    def opened(body_field: str) -> Column:
        return F.array_join(F.transform(anc, lambda x: F.concat(x["head"], _js(x[body_field]),
                                                                  F.lit(', "comments": ['))), "")

    def focus_doc(body_field: str) -> Column:
        leaves = F.array_join(F.transform(rep, lambda x: F.concat(x["head"], _js(x[body_field]), F.lit("}"))), ", ")
        return F.concat(foc["head"], _js(foc[body_field]), F.lit(', "comments": ['), leaves, F.lit("]}"))

    full = F.concat(F.lit('{"post": '), opened("body_ft"), focus_doc("body_ft"), closers, F.lit("}"))
    gen_full = F.concat(F.lit('{"post": '), opened("body_gen"), focus_doc("body_gen"), closers, F.lit("}"))
    context = F.concat(F.lit('{"post": '), opened("body_gen"), foc["head"], _js(F.lit(PLACEHOLDER_BODY)),
                       F.lit("}"), closers, F.lit("}"))
    return g.select(
        F.col("focus_id").alias("id"), "post_id",
        full.alias("full_thread"),
        F.when(n_anc == 0, gen_full).otherwise(focus_doc("body_gen")).alias("subthread"),
        F.when(n_anc == 0, F.lit(None).cast("string")).otherwise(context).alias("subthread_context"),
    )
