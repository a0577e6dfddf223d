"""The place of every thread row when the forest is read from top to bottom.

Posts come in input order, the replies of a message by rank, and a reply's own
replies right after it. A message's place is that of its parent, plus one, plus
the sizes of the subtrees of its earlier siblings. Sizes are summed up from the
deepest level, places handed down from the posts: two passes of ``max_depth``
equi-joins on narrow rows. Only messages with a thread row count; their ancestors
have one too, so nothing else is needed.

The sums over earlier siblings are prefix sums over range partitions
(``running_sum_within_groups``): the replies of a viral post, or all posts,
which are one group, are spread over all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.ordering import running_sum_within_groups
from skein.session import materialize


def positions(nodes: DataFrame, max_depth: int) -> DataFrame:
    """id, position (from 0, gapless) of each message with a thread row: depth at
    most ``max_depth`` and at least one kept reply.

    ``nodes``: id, parent_id, depth, num_replies, score, created, ord (posts
    have depth 0 and are ordered by ``ord``)."""
    reply = F.col("depth") > 0
    rows = materialize(
        nodes.where((F.col("depth") <= max_depth) & (F.col("num_replies") > 0)).select(
            "id", F.when(reply, F.col("parent_id")).otherwise(F.lit("")).alias("parent"), "depth",
            F.when(reply, -F.col("score")).alias("k1"), F.when(reply, -F.col("num_replies")).alias("k2"),
            F.when(reply, F.col("created")).alias("k3"), "ord"), "focus")
    levels: list[DataFrame] = []
    below = None
    for depth in range(max_depth, -1, -1):
        own = rows.where(F.col("depth") == depth)
        if below is None:
            sized = own.withColumn("size", F.lit(1).cast("long"))
        else:
            inner = below.groupBy(F.col("parent").alias("_of")).agg(F.sum("size").alias("_inner"))
            sized = (own.join(inner, F.col("id") == F.col("_of"), "left")
                     .withColumn("size", F.lit(1).cast("long") + F.coalesce("_inner", F.lit(0))).drop("_of", "_inner"))
        below = materialize(sized, "sizes")
        levels.append(below)
    order = [F.col(c).asc() for c in ("k1", "k2", "k3", "ord")]
    placed = running_sum_within_groups(reduce(DataFrame.unionByName, levels), ["depth", "parent"], order, "size")
    placed = materialize(placed.select("id", "parent", "depth", "before"), "before")
    level = placed.where(F.col("depth") == 0).select("id", F.col("before").alias("position"))
    out = [level]
    for depth in range(1, max_depth + 1):
        above = level.select(F.col("id").alias("_id"), F.col("position").alias("_at"))
        level = (placed.where(F.col("depth") == depth).join(above, F.col("parent") == F.col("_id"))
                 .select("id", (F.col("_at") + 1 + F.col("before")).alias("position")))
        out.append(level)
    return reduce(DataFrame.unionByName, out)
