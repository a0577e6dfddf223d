"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import materialize, stage_path  # noqa: F401  (re-exported for the operators)

#: stands for a null document id inside joins and groupings
NO_ID = -(2 ** 63)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def doc_key(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def back_to_id(key: str) -> Column:
    return F.when(F.col(key) != F.lit(NO_ID), F.col(key))


def global_rank(df: DataFrame, order: list[str], name: str, out: str = "rank") -> tuple[DataFrame, int]:
    """``df`` with ``out`` = 0-based position of each row in the order of the
    columns ``order``, and the number of rows.

    Rows are range-partitioned on the whole key (sampled splitters; one hot
    leading value spreads over several partitions when later columns differ),
    sorted inside each partition and written once with their partition-local
    position. A row's rank is that position plus the number of rows in earlier
    partitions: a table with one row per partition, read by the driver.
    Rows equal in every ordering column are interchangeable.
    """
    n = partitions(df)
    numbered = materialize(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id()), name)
    part = F.shiftright("_mid", 33)
    # one row per partition (at most the number of shuffle partitions)
    sizes = sorted((r["_part"], r["_n"]) for r in
                   numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).collect())
    offsets, total = [], 0
    for p, k in sizes:
        offsets.append((p, total))
        total += k
    side = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_part long, _off long")
    ranked = (numbered.withColumn("_part", part).join(F.broadcast(side), "_part")
              .withColumn(out, F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
              .drop("_part", "_off", "_mid"))
    return ranked, total


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node of the undirected
    ``edges`` (two long columns u, v).

    Alternates large-star and small-star steps: every node links its larger
    neighbours, then its smaller ones, to the smallest node it knows, until the
    edges are stars. Each step is a minimum (partially aggregated) and an
    equi-join; a hot centre's edges are split by the skew join. Each round is
    written to the shared folder, which cuts the lineage.
    """
    greater = F.greatest("u", "v").alias("u")
    e = materialize(edges.where("u <> v").select(greater, F.least("u", "v").alias("v")).distinct(), "cc")
    while not _all_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(small, "cc")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _all_stars(e: DataFrame) -> bool:
    """Whether each u has one v and no v is a u."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not seen.where("up > 1 or (up = 1 and down = 1)").take(1)


def whole_groups(batches, keys: list[str]):
    """From Arrow batches sorted by ``keys`` (longs), tables that hold only whole
    groups, with the positions where groups start (and the end)."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        cols = [table.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.nonzero(new)[0]
        last = int(starts[-1])
        held = table.slice(last)
        if last:
            yield table.slice(0, last).combine_chunks(), starts
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.array([0, held.num_rows])


def binary_parts(column):
    """The bytes of a binary column as one array, and the offsets of its rows."""
    import numpy as np
    import pyarrow as pa

    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(c, pa.ChunkedArray):
        c = c.chunk(0) if c.num_chunks else pa.array([], pa.binary())
    kind = np.int64 if pa.types.is_large_binary(c.type) else np.int32
    _, offsets, data = c.buffers()
    at = np.frombuffer(offsets, kind)[c.offset:c.offset + len(c) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and len(c) else np.zeros(0, np.uint8)
    return raw, at - at[0]


FILTER_BITS = 1 << 24


def only_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``df`` without most rows whose ``on`` columns are not in ``keys``.

    A bitmap of ``FILTER_BITS`` bits (at most FILTER_BITS / 64 rows of two
    longs: 4 MB, whatever the data) is broadcast, so rows that no join can use
    are not shuffled. It keeps every matching row and some others; with far
    more keys than bits it just filters less."""
    bit = F.pmod(F.xxhash64(*on), F.lit(FILTER_BITS))
    mask = F.expr("shiftleft(1L, cast(_bit % 64 as int))")
    words = (keys.select(bit.alias("_bit")).groupBy(F.expr("_bit div 64").alias("_word"))
             .agg(F.bit_or(mask).alias("_mask")))
    marked = df.withColumn("_bit", bit).withColumn("_word", F.expr("_bit div 64"))
    return (marked.join(F.broadcast(words), "_word").where(F.col("_mask").bitwiseAND(mask) != 0)
            .drop("_bit", "_word", "_mask"))


def split_by_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` (which has the columns ``on``) in two: rows whose key may be in
    ``keys``, and rows whose key is surely not, told by the bitmap of
    ``only_keys``. The second part needs no join, so it is not shuffled."""
    bit = F.pmod(F.xxhash64(*on), F.lit(FILTER_BITS))
    mask = F.expr("shiftleft(1L, cast(_bit % 64 as int))")
    words = (keys.select(bit.alias("_bit")).groupBy(F.expr("_bit div 64").alias("_word"))
             .agg(F.bit_or(mask).alias("_mask")))
    marked = (df.withColumn("_bit", bit).withColumn("_word", F.expr("_bit div 64"))
              .join(F.broadcast(words), "_word", "left")
              .withColumn("_maybe", F.coalesce(F.col("_mask").bitwiseAND(mask) != 0, F.lit(False))).drop("_bit", "_word", "_mask"))
    return marked.where("_maybe").drop("_maybe"), marked.where("not _maybe").drop("_maybe")
