"""Reading tables of few row groups."""

from pyspark.sql import functions as F

from skein.sources.tables import spread


def _pieces(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_a_single_row_group_in_many_splits_is_dealt_out(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(20000).selectExpr("id", "md5(cast(id as string)) as text").coalesce(1).write.parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        read = spark.read.parquet(path)
        cores = spark.sparkContext.defaultParallelism
        assert read.rdd.getNumPartitions() >= cores and _pieces(read) == 1
        assert _pieces(spread(read)) == cores and spread(read).count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
