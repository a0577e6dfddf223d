"""Packed queries next to all rows of a table, without a broadcast or the driver.

The query rows (packed by the caller: few, of bounded size) are sent once to
each partition and read there before the partition's other rows, which stream
by. So the queries cross the network once for each partition, a task holds
them and one batch of rows, and nothing passes through the driver.

Queries too many for one task come in ``stripes``: a partition then gets one
stripe of the queries and one part of the rows, so with as many stripes as
parts both cross the network as often as the square root of the partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(queries: DataFrame, rows: DataFrame, key: str, parts: int,
           run: Callable[[list[pa.RecordBatch], Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str,
           stripes: int = 1) -> DataFrame:
    """``run(query batches, row batches)`` in each of ``parts`` partitions; rows
    are dealt out by a hash of ``key``, every partition gets all ``queries``.
    With more ``stripes`` than one there are ``parts`` partitions for each value
    (from 0) of the queries' int column ``stripe``; they get its queries only."""
    first = F.col("stripe") * F.lit(parts) if stripes > 1 else F.lit(0)
    q = queries.select(F.explode(F.sequence(first, first + F.lit(parts - 1))).alias("_part"), F.lit(0).alias("_kind"),
                       F.struct(*queries.columns).alias("_q"), F.lit(None).cast(rows.schema).alias("_r"))
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    if stripes > 1:
        part = F.explode(F.sequence(part, part + F.lit((stripes - 1) * parts), F.lit(parts)))
    r = rows.select(part.alias("_part"), F.lit(1).alias("_kind"),
                    F.lit(None).cast(queries.schema).alias("_q"), F.struct(*rows.columns).alias("_r"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def others() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cut = int(np.searchsorted(batch.column("_kind").to_numpy(), 1))
                if cut:
                    held.append(pa.RecordBatch.from_struct_array(batch.column("_q").slice(0, cut)))
                if cut < batch.num_rows:
                    yield pa.RecordBatch.from_struct_array(batch.column("_r").slice(cut))

        rest = others()
        first = next(rest, None)
        if first is not None:
            yield from run(held, chain([first], rest))

    return q.unionByName(r).repartitionById(stripes * parts, "_part").sortWithinPartitions("_kind").mapInArrow(split, schema)
