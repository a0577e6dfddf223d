"""Readers for the driver's parquet tables (column-pruned by the callers)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores when it is read in fewer tasks than there are:
    one row group is one task, however much is made of each of its rows and
    however many splits its file has. Tables with more pieces than cores stay as
    they are read, without a shuffle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    # splits with rows; no column is read for it
    pieces = df.select(F.spark_partition_id().alias("_part")).distinct().count()
    return df.repartition(n) if pieces < n else df
