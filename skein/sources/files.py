"""Tables on given paths: thread rows as Parquet, training rows, the corpus,
requests and responses as JSON lines. Every reader states its schema."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein import schemas
from skein.functions.text import ascii_json_string


def write_threads(threads: DataFrame, path: str, order: str | None = None) -> None:
    """``order``: a column by which the files (by name) and the rows within them are sorted."""
    if order:
        n = int(threads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        threads = threads.repartitionByRange(n, order).sortWithinPartitions(order)
    threads.select(*schemas.THREADS.fieldNames()).write.mode("overwrite").parquet(path)


def read_threads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.THREADS).parquet(path)


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """One JSON object a line; ``by`` makes a folder for each value of a column."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def write_ascii_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines of string columns in ASCII alone, byte for byte as the standard
    encoder writes them: keys in column order, ``", "`` and ``": "`` between,
    nulls kept. ``by`` makes a folder for each value of a column."""
    fields = [c for c in df.columns if c != by]
    parts = [F.concat(F.lit(f"{', ' if i else ''}{json.dumps(c)}: "), ascii_json_string(F.col(c))) for i, c in enumerate(fields)]
    lines = df.select(*([by] if by else []), F.concat(F.lit("{"), *parts, F.lit("}")).alias("value"))
    writer = lines.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).text(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType, corrupt: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, undecodable ones are null rows (kept
    as text in the column ``corrupt``, if it is named)."""
    reader = spark.read.option("mode", "PERMISSIVE")
    if corrupt:
        schema = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.schema(schema).json(path)
