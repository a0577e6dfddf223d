"""Spark session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "skein",
                  driver_memory: str = "8g") -> SparkSession:
    """A session configured the way every job in this package expects.

    AQE re-plans joins at runtime (broadcast by measured size, skew-join
    splitting of hot parent / post keys), timestamps are UTC, the UI is off.
    Without ``shuffle_partitions`` a local session takes 8 and a cluster keeps
    its own setting.
    """
    if shuffle_partitions is None and (master or "").startswith("local"):
        shuffle_partitions = 8
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for lineage cuts and stage tables.

    Read from the session (``spark.checkpoint.dir`` / the context's checkpoint
    dir). A folder is only made when nothing is configured and the master is
    local (tests): on a cluster a machine-local folder would lose data, so
    there it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if not current:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not configured:
            configured = tempfile.mkdtemp(prefix="skein-ckpt-")
        sc.setCheckpointDir(configured)
        current = sc.getCheckpointDir()
    return current


#: the folder of the run that stage tables are written for, if it is one that removes them
_RUN: ContextVar[str | None] = ContextVar("stage_run", default=None)


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one written stage table."""
    return os.path.join(_RUN.get() or os.path.join(shared_dir(spark), "stages"), f"{name}-{uuid.uuid4().hex}")


@contextmanager
def stage_run(spark: SparkSession) -> Iterator[None]:
    """Stage tables that are written inside are removed at the end: for jobs whose
    result is written by then. A lazy result still reads its stage tables, so
    functions that return one leave them to the caller's run."""
    folder = os.path.join(shared_dir(spark), "stages", f"run-{uuid.uuid4().hex}")
    token = _RUN.set(folder)
    try:
        yield
    finally:
        _RUN.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df, name: str):
    """Write ``df`` as a Parquet stage table in the shared folder and read it
    back: cuts the lineage (small plans, no recomputation of a stage that
    several later steps read) and survives executor loss. Later reads get
    column pruning and filter pushdown on the stage table."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
