"""Streaming export over dump files derived from the documents table."""

import os
import tempfile

from pyspark.sql import functions as F

from skein.sources import dumps, forest
from skein.sources.tables import table
from skein.streaming.ingest import read_ingested, start_ingest


def test_streaming_matches_batch(spark, sf_dir):
    base = tempfile.mkdtemp(prefix="skein-stream-")
    src, out = os.path.join(base, "src"), os.path.join(base, "out")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    lines = forest.dump_with_defects(docs, "replies")
    lines.select("value").write.mode("overwrite").text(src)
    q = start_ingest(spark, src, out, "replies", checkpoint=os.path.join(base, "ckpt"))
    q.awaitTermination(300)
    got = read_ingested(spark, out, "replies").drop("epoch")
    want = dumps.export_records(dumps.parse_lines(lines, "replies"), "replies")
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0
    bad = spark.read.parquet(os.path.join(out, "replies_quarantine"))
    assert bad.count() == dumps.quarantine(dumps.parse_lines(lines, "replies")).count()
