"""Missing-value normalisation and the quality filter of posts and replies."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import null_if_token

REMOVED_BODIES = ["[removed]", "[deleted]"]


def normalize_nulls(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Turn missing-value strings (``None``, ``NA``, ``nan``, empty, ...) into nulls."""
    cols = set(columns)
    return df.select(*[null_if_token(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def quality_filter(df: DataFrame, min_score: int = 5) -> DataFrame:
    """Keep messages with ``score >= min_score``, not distinguished as moderator
    (null passes), and a real body (not null, not removed/deleted).

    Pure column predicates: Catalyst pushes them into the scan.
    """
    return df.where(
        (F.col("score") >= F.lit(min_score))
        & ~F.col("distinguished").eqNullSafe(F.lit("moderator"))
        & F.col("body").isNotNull()
        & ~F.col("body").isin(REMOVED_BODIES)
    )
