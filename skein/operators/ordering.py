"""Rank within groups without sorting a whole group in one task.

``Window.partitionBy(g).orderBy(...)`` puts every row of a group in one
task; with one group holding a third of the data that task is the job. Here
the rows are range-partitioned on the full key (group, order...), so a large
group spreads over consecutive range partitions. The partition assignment is
written once (range bounds come from sampling; the stage table pins them),
rows are numbered inside each (partition, group) piece, and each piece gets
the count of the group's rows in earlier partitions as offset. The offset
table has at most (#groups + #partitions) rows; a group contributes one row
per partition it spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import materialize


def rank_within_groups(df: DataFrame, group: str, order: list[Column], out: str = "rank",
                       partitions: int | None = None) -> DataFrame:
    """Adds ``out`` = 1-based position of each row inside its group by ``order``
    (``order`` must make rows unique within a group)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(df.repartitionByRange(n, F.col(group), *order)
                        .withColumn("_part", F.spark_partition_id()), "range_parts")
    local = parts.withColumn("_local", F.row_number().over(Window.partitionBy("_part", group).orderBy(*order)))
    counts = parts.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (local.join(offsets, [group, "_part"])
            .withColumn(out, (F.col("_off") + F.col("_local")).cast("int"))
            .drop("_part", "_local", "_off"))


def running_sum_within_groups(df: DataFrame, group: list[str], order: list[Column], value: str, out: str = "before",
                              partitions: int | None = None) -> DataFrame:
    """Adds ``out`` = the sum of ``value`` over the rows of a row's group that come
    before it by ``order`` (which must make rows unique within a group). As
    ``rank_within_groups``: a group that holds everything spreads over all partitions."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(df.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()), "range_parts")
    piece = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumn("_local", F.coalesce(F.sum(value).over(piece), F.lit(0)))
    sums = parts.groupBy(*group, "_part").agg(F.sum(value).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return (local.join(offsets, [*group, "_part"]).withColumn(out, F.col("_off") + F.col("_local"))
            .drop("_part", "_local", "_off"))
