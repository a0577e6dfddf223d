"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query, block by block. No scores are
shuffled: each round only counts, for each query, how many scores fall into
each of ``BINS`` bins of its current interval; the counts are summed over all
blocks and the bin that holds the k-th best score becomes the next interval.
After ceil(log_BINS(range)) rounds the bin is one integer wide, so the k-th
value is known exactly; the last pass keeps the scores above it and breaks
ties at it by the smaller id.

A block may cut its counts at its own k best scores (the global k-th value is
never below a block's k-th), so it counts at most k scores for a query however
many equal vectors there are; a task adds its counts up before it sends them.
Queries are numbered and packed into blocks of ``QUERY_BLOCK`` rows (fewer
when vectors are long: ``BLOCK_BYTES``), whatever way the input was split. All
blocks of up to ``GROUP_BLOCKS`` go through one job a round, next to the
candidates of each partition; only more queries than that need a further chain.

Edge cases: vectors that are null or hold null, NaN or infinite components
take no part, nor do null ids; rows of one id count once (the smallest vector
in array order); only vectors of one length are compared (others have no
inner product); a query with fewer candidates returns them all; an empty
table gives an empty result; further input columns are ignored. Scores must
fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import global_rank, materialize, partitions
from skein.operators.beside import beside

BINS = 1024
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 4096
BLOCK_BYTES = 1 << 23
GROUP_BLOCKS = 8
_COUNTS = 1 << 20  # counts that a task holds before it adds them up
_SLICE = 256  # queries scored at a time inside a task: memory is _SLICE * CANDIDATE_BLOCK scores


def integer_vectors(df: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v array<long> = floor(scale * x); rows that take no part are gone."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return (df.where(F.col(id_col).isNotNull() & v.isNotNull() & ~bad)
            .select(F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long")).alias("v"))
            .groupBy("vec_id").agg(F.min("v").alias("v")))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows and ``BLOCK_BYTES`` of vectors, all of one
    length and one ``block``: dim, ids, vectors, lows (little-endian longs).
    ``rows``: block, vec_id, v, low."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[list, list, list]] = {}

        def block(key):
            ids, vs, lows = held.pop(key)
            columns = (np.array(x, "<i8").tobytes() for x in (ids, vs, lows))
            return pa.RecordBatch.from_arrays([pa.array([key[1]], pa.int32()), *(pa.array([c], pa.binary()) for c in columns)],
                                              ["dim", "ids", "vectors", "lows"])

        for batch in batches:
            for b, i, v, low in zip(*(batch.column(c).to_pylist() for c in ("block", "vec_id", "v", "low"))):
                ids, vs, lows = held.setdefault((b, len(v)), ([], [], []))
                ids.append(i)
                vs.append(v)
                lows.append(low)
                if len(ids) >= size or 8 * len(ids) * len(v) >= BLOCK_BYTES:
                    yield block((b, len(v)))
        for key in list(held):
            yield block(key)

    return rows.select("block", "vec_id", "v", "low").mapInArrow(pack, "dim int, ids binary, vectors binary, lows binary")


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products; floating point where it is exact."""
    if q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) < 2.0 ** 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


class _Block:
    """An unpacked block, ids ascending."""

    def __init__(self, row):
        ids = np.frombuffer(row["ids"], "<i8")
        order = np.argsort(ids, kind="stable")
        self.dim, self.ids = row["dim"], ids[order]
        self.vectors = np.frombuffer(row["vectors"], "<i8").reshape(len(ids), row["dim"])[order]
        self.lows = np.frombuffer(row["lows"], "<i8")[order]


def _slices(c: _Block, q: _Block, k: int):
    """For each slice of the queries ``q``: positions, scores of the candidates
    ``c``, and the k-th best of them; a query's own place is marked."""
    none = np.iinfo(np.int64).min
    for s in range(0, len(q.ids), _SLICE):
        at = np.arange(s, min(s + _SLICE, len(q.ids)))
        score = _scores(q.vectors[at], c.vectors)
        own = np.searchsorted(c.ids, q.ids[at])
        hit = (own < len(c.ids)) & (c.ids[np.minimum(own, len(c.ids) - 1)] == q.ids[at])
        score[np.nonzero(hit)[0], own[hit]] = none
        m = min(k, score.shape[1])
        edge = -np.partition(-score, m - 1, axis=1)[:, m - 1]
        yield at, score, edge, none


def _pairs(held: list[pa.RecordBatch], rest: Iterator[pa.RecordBatch]):
    """Each candidate block with each query block of its vector length."""
    queries = [_Block(row) for batch in held for row in batch.to_pylist()]
    for batch in rest:
        for i in range(batch.num_rows):
            c = _Block(batch.slice(i, 1).to_pylist()[0])
            for q in queries:
                if q.dim == c.dim:
                    yield c, q


def _summed(found: list[tuple]) -> list[np.ndarray]:
    """query, bin and the sum of counts of each (query, bin)."""
    query, place, n = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((place, query))
    query, place, n = query[by], place[by], n[by]
    head = np.flatnonzero(np.append(True, (query[1:] != query[:-1]) | (place[1:] != place[:-1])))
    return [query[head], place[head], np.add.reduceat(n, head)]


def top_k(candidates: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``candidates`` (vec_id, v)
    where ``is_query`` holds, its k best other rows."""
    n = partitions(candidates)
    rows = materialize(candidates, "topk_vectors")
    spread = rows.repartition(n, F.xxhash64("vec_id")).select(F.lit(0).alias("block"), "vec_id", "v", F.lit(0).cast("long").alias("low"))
    blocks = materialize(_packed(spread, CANDIDATE_BLOCK).drop("lows"), "topk_candidates").withColumn("lows", F.col("ids"))
    ranked, n_queries = global_rank(rows.where(is_query), ["vec_id"], "topk_queries", "_n")
    queries = ranked.select("vec_id", "v", F.expr(f"_n div {QUERY_BLOCK}").alias("block"))
    norm = F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    longest = rows.agg(norm).first()[0] or 0.0
    bound = int(longest) + 1  # Cauchy-Schwarz: |score| <= |q||c| <= max norm squared
    out = candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for g in range(0, -(-n_queries // QUERY_BLOCK), GROUP_BLOCKS):  # one chain of jobs for QUERY_BLOCK * GROUP_BLOCKS queries
        own = queries.where((F.col("block") >= g) & (F.col("block") < g + GROUP_BLOCKS))
        out = out.unionByName(materialize(_one_group(blocks, own, bound, k, n), "topk_result"))
    return out


def _one_group(blocks: DataFrame, queries: DataFrame, bound: int, k: int, parts: int) -> DataFrame:
    """The rounds for a group of query blocks (vec_id, v, block)."""
    width, low = 2 * bound + 1, -bound
    state = queries.select(F.col("vec_id").alias("query_id"), F.lit(low).cast("long").alias("low"), F.lit(0).cast("long").alias("above"))

    def packed(state: DataFrame) -> DataFrame:
        """The queries with the starts of their intervals; one without candidates is gone."""
        known = queries.join(state.select(F.col("query_id").alias("vec_id"), "low"), "vec_id")
        return _packed(known.repartition("block"), QUERY_BLOCK)

    while width > 1:
        step = -(-width // BINS)

        def count(held, rest, step=step, width=width):
            found, size = [], 0
            for c, q in _pairs(held, rest):
                for at, score, edge, none in _slices(c, q, k):
                    lo = q.lows[at]
                    use = (score >= edge[:, None]) & (score > none) & (score >= lo[:, None]) & (score < lo[:, None] + width)
                    r, j = np.nonzero(use)
                    if not len(r):
                        continue
                    place, times = np.unique(np.stack([r, (score[r, j] - lo[r]) // step]), axis=1, return_counts=True)
                    # no more than k of a bin can matter
                    found.append((q.ids[at[place[0]]], place[1], np.minimum(times, k)))
                    size += len(times)
                if size > _COUNTS:
                    found = [tuple(_summed(found))]
                    size = len(found[0][0])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _summed(found)], ["query_id", "bin", "n"])

        hist = (beside(packed(state), blocks, "ids", parts, count, "query_id long, bin long, n long")
                .groupBy("query_id", "bin").agg(F.sum("n").alias("n")).join(state, "query_id"))
        down = Window.partitionBy("query_id").orderBy(F.col("bin").desc())
        cum = (F.col("above") + F.sum("n").over(down)).alias("cum")
        # the bin of the k-th score, or the lowest one when there are fewer than k
        found = (hist.select("query_id", "bin", "n", "low", "above", cum)
                 .withColumn("enough", F.col("cum") >= k)
                 .withColumn("pick", F.row_number().over(Window.partitionBy("query_id").orderBy(
                     F.col("enough").desc(), F.when(F.col("enough"), -F.col("bin")).otherwise(F.col("bin")))))
                 .where("pick = 1"))
        state = materialize(found.select("query_id", (F.col("low") + F.col("bin") * step).alias("low"),
                                         (F.col("cum") - F.col("n")).alias("above")), "topk_state")
        width = step

    def keep(held, rest):
        for c, q in _pairs(held, rest):
            for at, score, edge, none in _slices(c, q, k):
                floor = q.lows[at]
                use = (score >= np.maximum(edge, floor)[:, None]) & (score > none)
                tie = use & (score == floor[:, None])
                use &= ~tie | (np.cumsum(tie, axis=1) <= k)  # ids ascend: the k smallest at the edge
                r, j = np.nonzero(use)
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(q.ids[at[r]]), pa.array(c.ids[j]), pa.array(score[r, j])],
                                                     ["query_id", "vec_id", "score"])

    best = beside(packed(state), blocks, "ids", parts, keep, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
