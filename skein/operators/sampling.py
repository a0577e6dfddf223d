"""Seeded shuffles, dense indices, samples, oracle flags, distractors, splits.

A shuffle is an order key ``md5(seed || '|' || id)`` (reproducible, the same
in any engine). The dense index (0..N-1 in key order) is computed without a
global single-partition window: rows are bucketed by the first hex digits of
the key (uniform, so buckets are even), bucket sizes are counted (a table
with at most 16^digits rows, a proven size bound, so it is broadcast),
prefix-summed, and each row's index = bucket offset + its position inside
its bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import md5_int

DEFAULT_SEED = 42


def order_key(id_col: Column, seed: int | str = DEFAULT_SEED) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.lit("|"), id_col.cast("string")))


def dense_index(df: DataFrame, id_col: str = "id", seed: int | str = DEFAULT_SEED,
                out: str = "idx", bucket_digits: int = 4) -> DataFrame:
    """Adds ``out`` = 0-based rank of each row in seeded-shuffle order and
    ``n_total`` = number of rows. ``id_col`` must be unique."""
    if not 1 <= bucket_digits <= 5:
        raise ValueError("bucket_digits must be in 1..5 (at most 16^5 buckets are broadcast)")
    # only ids are numbered; all other columns are joined to the numbers once
    keyed = df.select(id_col).withColumn("_key", order_key(F.col(id_col), seed)) \
              .withColumn("_bucket", F.substring("_key", 1, bucket_digits))
    sizes = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w_all = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most 16^bucket_digits rows: safe to order in one task and to broadcast
    offsets = (sizes.withColumn("_off", F.coalesce(F.sum("_n").over(w_all), F.lit(0)))
               .withColumn("n_total", F.sum("_n").over(Window.partitionBy())))
    w_in = Window.partitionBy("_bucket").orderBy("_key", id_col)
    numbered = (keyed.join(F.broadcast(offsets.select("_bucket", "_off", "n_total")), "_bucket")
                .withColumn(out, (F.col("_off") + F.row_number().over(w_in) - 1).cast("long"))
                .drop("_key", "_bucket", "_off"))
    return numbered if df.columns == [id_col] else df.join(numbered, id_col)


def sample_n(indexed: DataFrame, n: int | None, idx: str = "idx") -> DataFrame:
    """First ``n`` rows of the shuffle (``None``/0 = all)."""
    return indexed if not n else indexed.where(F.col(idx) < F.lit(n))


def oracle_flags(indexed: DataFrame, p: float, idx: str = "idx", seed2: int | str = DEFAULT_SEED,
                 id_col: str = "id") -> DataFrame:
    """``include_oracle`` true for exactly floor(N*p) rows (the first of the
    shuffle); when p < 1 the rows are re-shuffled (``idx`` is recomputed with a
    second key)."""
    if not 0 <= p <= 1:
        raise ValueError("p must be in between 0 and 1")
    flagged = indexed.withColumn("include_oracle", F.col(idx) < F.floor(F.col("n_total") * F.lit(float(p))))
    if p < 1:
        flagged = dense_index(flagged.drop(idx, "n_total"), id_col, f"{seed2}|again", idx)
    return flagged


def distractor_offsets(i: Column, n: Column, salt: list[Column], m: int) -> Column:
    """``m`` distinct offsets in 1..n-1 (so ``(i + offset) mod n`` is never i),
    drawn without replacement: draw s picks the r-th unused value of 1..n-1,
    r uniform in [0, n-1-s). O(m^2) per row, no candidate lists."""
    def draw(acc, s):
        r = md5_int(*salt, s) % (n - 1 - s)
        picked = F.aggregate(F.array_sort(acc), (r + 1).cast("long"),
                             lambda v, p: v + F.when(v >= p, F.lit(1)).otherwise(F.lit(0)))
        return F.concat(acc, F.array(picked))
    return F.aggregate(F.sequence(F.lit(0), F.lit(m - 1)), F.array().cast("array<long>"), draw)


def distractors(indexed: DataFrame, requests: DataFrame, m: int, seed: int | str = DEFAULT_SEED,
                id_col: str = "id", idx: str = "idx") -> DataFrame:
    """For each request (id, j): ``m`` distinct other rows of ``indexed``.

    Returns id, j, slot (0..m-1), distractor_id. Targets are found by an
    equi-join on the dense index (no cross join, no candidate pairs).
    """
    if m < 0:
        raise ValueError("number of distractors must be >= 0")
    if m == 0:
        return requests.select(id_col, "j").limit(0).withColumn("slot", F.lit(0)) \
                       .withColumn("distractor_id", F.lit(None).cast("string"))
    base = requests.join(indexed.select(id_col, idx, "n_total"), id_col)
    offs = distractor_offsets(F.col(idx), F.col("n_total"),
                              [F.lit(str(seed)), F.col(id_col), F.col("j")], m)
    drawn = base.select(id_col, "j", idx, "n_total", F.posexplode(offs).alias("slot", "off"))
    target = ((F.col(idx) + F.col("off")) % F.col("n_total")).alias("t_idx")
    tgt = indexed.select(F.col(idx).alias("t_idx"), F.col(id_col).alias("distractor_id"))
    return drawn.select(id_col, "j", "slot", target).join(tgt, "t_idx").drop("t_idx")


def check_distractors(m: int, n_rows: int) -> None:
    if m > n_rows - 1:
        raise ValueError("number of distractors cannot exceed number of discussions - 1")


def split_labels(indexed: DataFrame, test_fraction: float, idx: str = "idx") -> DataFrame:
    """``split`` = 'test' for the first ceil(f*N) rows of the shuffle, else
    'train'; f = 0 means no test set."""
    if not 0 <= test_fraction < 1:
        raise ValueError("test fraction must be in [0, 1)")
    n_test = F.ceil(F.col("n_total") * F.lit(float(test_fraction)))
    return indexed.withColumn("split", F.when(F.col(idx) < n_test, F.lit("test")).otherwise(F.lit("train")))
