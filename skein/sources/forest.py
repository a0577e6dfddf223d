"""Posts and replies derived from the ``documents`` table.

No given table has parent pointers, so a reply forest is computed from
``doc_id`` by integer arithmetic (every rule is also plain SQL, used by the
DuckDB oracle). All modular arithmetic is done on reduced operands so it
cannot overflow for any ``doc_id`` that fits a long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the derivation.
ROOT_EVERY = 40            # doc_id % 40 = 0 -> post
EPOCH_2024 = 1704067200    # 2024-01-01 00:00:00 UTC in seconds


def _d() -> Column:
    return F.col("doc_id")


def first_line() -> Column:
    return F.substring_index("text", "\n", 1)


def is_post() -> Column:
    return (_d() % ROOT_EVERY) == 0


def parent_doc() -> Column:
    d = _d()
    m = d % ROOT_EVERY
    # the planner may evaluate this before the is-post filter: keep it total
    safe = F.when(m == 0, F.lit(1)).otherwise(m)
    r = d % safe
    return d - m + ((r * r * 7 + r * 3) % safe)


def msg_id(doc: Column) -> Column:
    prefix = F.when((doc % ROOT_EVERY) == 0, F.lit("t3_")).otherwise(F.lit("t1_"))
    return F.concat(prefix, doc.cast("string"))


def _common(docs: DataFrame) -> DataFrame:
    d = _d()
    return docs.select(
        "doc_id", "text", "source",
        ((d * 37) % 41 - 1).alias("score"),
        F.when(d % 97 == 1, F.lit("moderator"))
         .when(d % 89 == 1, F.lit("admin")).alias("distinguished"),
        F.when(d % 53 == 2, F.lit("[removed]")).otherwise(F.col("text")).alias("body"),
        F.concat(F.lit("u/user"), (d % 50).cast("string")).alias("author"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + (d - d % 2) * 60).alias("created"),
    )


def forest_posts(docs: DataFrame) -> DataFrame:
    """Posts: id, author, title, score, created, body, link_flair_text, distinguished, ord."""
    base = _common(docs.where(is_post()))
    return base.select(
        msg_id(F.col("doc_id")).alias("id"),
        "author",
        first_line().alias("title"),
        "score", "created", "body",
        F.when(F.col("doc_id") % 80 == 0, F.col("source")).alias("link_flair_text"),
        "distinguished",
        F.col("doc_id").alias("ord"),
    )


def forest_replies(docs: DataFrame) -> DataFrame:
    """Replies: id, parent_id, author, score, created, body, distinguished, ord."""
    base = _common(docs.where(~is_post())).withColumn("pdoc", parent_doc())
    return base.select(
        msg_id(F.col("doc_id")).alias("id"),
        msg_id(F.col("pdoc")).alias("parent_id"),
        "author", "score", "created", "body", "distinguished",
        F.col("doc_id").alias("ord"),
    )


# --- the same forest as a raw JSON-lines dump (input of the export job) ----

def dump_lines(docs: DataFrame, kind: str) -> DataFrame:
    """JSON lines shaped like a forum dump, one column ``value`` plus ``line_no``.

    Optional keys are left out for some rows (``permalink`` when doc_id % 3 = 0,
    ``name`` when doc_id % 5 = 0, ``distinguished`` when it is null) so that the
    fallbacks of the export are exercised.
    """
    d = _d()
    base = _common(docs.where(is_post() if kind == "posts" else ~is_post()))
    raw_author = F.concat(F.lit("user"), (d % 50).cast("string"))
    created_utc = F.unix_seconds(F.col("created"))
    bare_id = d.cast("string")
    if kind == "posts":
        obj = F.struct(
            raw_author.alias("author"),
            first_line().alias("title"),
            F.col("score"),
            created_utc.alias("created_utc"),
            F.col("body").alias("selftext"),
            bare_id.alias("id"),
            F.when(d % 80 == 0, F.col("source")).otherwise(F.lit("")).alias("link_flair_text"),
            F.col("distinguished"),
            F.lit("forum").alias("subreddit"),
            F.when(d % 3 != 0, F.concat(F.lit("/r/forum/comments/"), bare_id, F.lit("/_/")))
             .alias("permalink"),
        )
    else:
        base = base.withColumn("pdoc", parent_doc())
        post_doc = d - d % ROOT_EVERY
        obj = F.struct(
            raw_author.alias("author"),
            F.col("score"),
            created_utc.alias("created_utc"),
            F.col("body"),
            F.when(d % 5 != 0, msg_id(d)).alias("name"),
            bare_id.alias("id"),
            msg_id(F.col("pdoc")).alias("parent_id"),
            F.col("distinguished"),
            F.lit("forum").alias("subreddit"),
            F.when(d % 3 != 0, F.concat(F.lit("/r/forum/comments/"), bare_id, F.lit("/_/")))
             .alias("permalink"),
            F.concat(F.lit("t3_"), post_doc.cast("string")).alias("link_id"),
        )
    return base.select(F.to_json(obj).alias("value"), d.alias("line_no"))


def dump_with_defects(docs: DataFrame, kind: str) -> DataFrame:
    """``dump_lines`` with seeded defects by doc_id % 50: 7 a truncated
    (undecodable) line, 9 a blank one, 11 text behind the object, 13 a creation
    time that is no number, 17 one that is null; posts (multiples of 10 only)
    have 10, 20 and 30 for the last three."""
    lines = dump_lines(docs, kind)
    d = F.col("line_no")
    value = (F.when(d % 50 == 7, F.substring("value", 1, 20))
             .when(d % 50 == 9, F.lit(""))
             .when(d % 50 == (10 if kind == "posts" else 11), F.concat("value", F.lit(" tail")))
             .when(d % 50 == (20 if kind == "posts" else 13), F.regexp_replace("value", r'"created_utc":\d+', '"created_utc":"abc"'))
             .when(d % 50 == (30 if kind == "posts" else 17), F.regexp_replace("value", r'"created_utc":\d+', '"created_utc":null'))
             .otherwise(F.col("value")))
    return lines.select(value.alias("value"), "line_no")
