"""The size of Arrow batches that texts are handed to Python in."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

ROWS = 1000
PIECE_BYTES = 1 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session hands rows to Python in batches of at most ``ROWS``
    from now on. Texts are long: the default of 10,000 rows would hold tens of
    MB, several times over, in every Python worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    return df


def pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``PIECE_BYTES`` of the string column ``text`` (a row at
    least): what Python objects are made of at a time, whatever a batch holds."""
    column = batch.column(text)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > PIECE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` that gives its free memory back when a task ends. A Python worker
    lives on for other tasks; what large arrays left in its heap would count
    against the executor until it ends."""

    @wraps(run)
    def trimmed(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
            if trim:
                trim(0)

    return trimmed
