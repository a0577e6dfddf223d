"""Incremental dump export with Structured Streaming.

New dump files dropped into a folder are parsed with the same native
expressions as the batch export (``skein.sources.dumps.parse_lines``); good
records go to a Parquet table, undecodable / incomplete lines to a
quarantine table. Progress and exactly-once file tracking live in a
checkpoint folder below the shared checkpoint dir, so a restarted query (or
a lost executor) resumes where it stopped. ``availableNow`` processes what
is there and stops, which is how a periodic batch job runs it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.session import shared_dir, stage_run
from skein.sources import dumps

METRICS = T.StructType([T.StructField("batch", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_lines", "n_bad", "n_missing", "n_bad_value")),
                        T.StructField("last_created", T.StringType())])


def start_ingest(spark: SparkSession, source_dir: str, out_dir: str, kind: str,
                 checkpoint: str | None = None, max_files_per_trigger: int = 64):
    """Start the streaming export; returns the StreamingQuery."""
    lines = (spark.readStream.format("text").option("maxFilesPerTrigger", max_files_per_trigger)
             .load(source_dir))
    parsed = dumps.parse_lines(lines.withColumn("source_file", F.input_file_name()), kind)
    ckpt = checkpoint or os.path.join(shared_dir(spark), "streams", f"ingest-{kind}")

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        # one micro-batch: good rows and quarantine, both appended; the epoch id
        # makes a re-run of the same batch replace its own output only
        with stage_run(batch.sparkSession):
            parsed, metrics = dumps.staged(batch, f"ingest_{kind}")
            good = dumps.export_records(parsed, kind).withColumn("epoch", F.lit(epoch_id))
            bad = dumps.quarantine(parsed).withColumn("epoch", F.lit(epoch_id))
            counted = batch.sparkSession.createDataFrame([(epoch_id, *(metrics[c] for c in METRICS.fieldNames()[1:]))], METRICS)
            counted.write.mode("overwrite").parquet(os.path.join(out_dir, f"{kind}_metrics", f"epoch={epoch_id}"))
            good.write.mode("overwrite").parquet(os.path.join(out_dir, kind, f"epoch={epoch_id}"))
            bad.write.mode("overwrite").parquet(os.path.join(out_dir, f"{kind}_quarantine", f"epoch={epoch_id}"))

    return (parsed.writeStream.foreachBatch(write_batch)
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start())


def read_metrics(spark: SparkSession, out_dir: str, kind: str) -> DataFrame:
    """batch, n_lines, n_bad, n_missing, n_bad_value, last_created of each micro-batch."""
    return spark.read.schema(METRICS).parquet(os.path.join(out_dir, f"{kind}_metrics"))


def read_ingested(spark: SparkSession, out_dir: str, kind: str) -> DataFrame:
    return spark.read.parquet(os.path.join(out_dir, kind))
