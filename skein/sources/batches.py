"""Tables written batch by batch that survive a stop.

A batch's rows go to a folder of their own below ``data``; only then one small
commit record (batch, folder, its number) is added below ``commits``. A reader
takes the folders named by the last record of each batch and no others. So

* a run that stops between write and commit leaves a folder that nobody reads;
* a batch that is written again replaces its own rows and no others;
* batches written before are never touched, whatever happens to a later one.

Everything goes through Spark's readers and writers. One writer at a time may
write a given batch; different batches may be written at the same time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMITS = T.StructType([T.StructField("batch", T.StringType()), T.StructField("folder", T.StringType()), T.StructField("n", T.LongType())])


def _commits(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(COMMITS).json(f"{path}/commits")
    except AnalysisException as e:  # nothing was committed yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMITS)


def committed(spark: SparkSession, path: str) -> dict[str, tuple[str, int]]:
    """batch -> (folder, number of its commit): one small row for each batch."""
    last = Window.partitionBy("batch").orderBy(F.col("n").desc())
    rows = _commits(spark, path).withColumn("_r", F.row_number().over(last)).where("_r = 1").collect()
    return {r["batch"]: (r["folder"], r["n"]) for r in rows}


def write_data(df: DataFrame, path: str, batch: str, fmt: str = "parquet") -> str:
    """The first half: rows in a new folder, not yet visible. Returns its name."""
    folder = f"{batch}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").format(fmt).save(f"{path}/data/{folder}")
    return folder


def commit(spark: SparkSession, path: str, batch: str, folder: str) -> None:
    """The second half: from now on the batch's rows are those of ``folder``."""
    n = committed(spark, path).get(batch, ("", 0))[1] + 1
    spark.createDataFrame([(batch, folder, n)], COMMITS).coalesce(1).write.mode("append").json(f"{path}/commits")


def write_batch(df: DataFrame, path: str, batch: str, fmt: str = "parquet") -> None:
    """Add a batch, or replace the batch of that name."""
    commit(df.sparkSession, path, batch, write_data(df, path, batch, fmt))


def read_batches(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", batches: list[str] | None = None) -> DataFrame:
    """The rows of all committed batches (or of those named)."""
    known = committed(spark, path)
    folders = [f"{path}/data/{folder}" for batch, (folder, _) in sorted(known.items()) if batches is None or batch in batches]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load(folders)
