"""Cosine top-k retrieval over an embedding corpus, exact and pruned, and what
is made of the hits.

The corpus is cut into cells: up to ``CENTRES`` of its vectors (those of the
smallest hashes of their ids; they only decide the layout) are the centres, each
vector goes to the nearest one, and a cell's vectors are packed into blocks
with the centre and the radius (the largest angle to it). On unit vectors
angles obey the triangle inequality, so no vector of a block scores above
cos(max(0, angle(query, centre) - radius)) and a block whose bound is below the
k-th best score known for a query is skipped for that query.

1. A query is scored against ``SEED_ROWS`` vectors of each of the ``HOME_CELLS``
   cells whose centres are nearest; the k-th best of these scores is its floor.
2. It is scored against every block whose bound reaches the floor; the floor
   rises within a task as better blocks are met. Scores are first taken in
   single precision; only those that reach the floor within its error are
   taken again in double precision, and a task sends k hits of a query.

Queries come in stripes of up to ``GROUP_QUERIES`` rows and ``GROUP_BYTES``. They
are packed on Spark and travel next to the blocks (``beside``), one stripe and
one part of the corpus to a task, so a task's memory is bounded and all stripes
go through one job. The number of pairs grows with the product of both tables,
as every query may meet every vector. Nothing but the centres (a bounded number
of vectors) passes through the driver. A hot cell is many blocks, spread by
their hash, not one group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.beside import beside
from skein.session import materialize

CENTRES = 256
HOME_CELLS = 2
BLOCK_ROWS = 2048
BLOCK_BYTES = 1 << 23
GROUP_QUERIES = 1 << 16
GROUP_BYTES = 1 << 25
SEED_ROWS = 256
TASK_PAIRS = 1 << 24  # tasks are not made smaller than this, however many partitions there are
_SLICE_PAIRS = 1 << 20  # scores that a task holds at a time
_SLACK = 1e-9  # scores are rounded to 12 digits; bounds must not cut what rounding ties


def _unit(vectors: list | np.ndarray) -> np.ndarray:
    m = np.array(vectors, float)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and rows of the vectors of each length."""
    ends = np.cumsum(sizes := column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, flat[(ends[at] - d)[:, None] + np.arange(d)]


def _usable(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """id, v (doubles) of the rows that take part."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (df.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad))


def _centres(corpus: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """Unit centres by vector length, at most CENTRES in all."""
    picked = corpus.orderBy(F.xxhash64("id"), "id").limit(min(CENTRES, max(1, math.isqrt(rows)))).collect()
    by_size: dict[int, list] = {}
    for r in picked:
        by_size.setdefault(len(r["v"]), []).append(r["v"])
    return {d: _unit(sorted(vs)) for d, vs in by_size.items()}


def _blocks(corpus: DataFrame, centres: dict[int, np.ndarray], parts: int) -> DataFrame:
    """cell, ids, units (bytes), dim, centre (bytes), radius: blocks of one cell each, ids ascending."""
    id_type = corpus.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, dims = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows, np.int32)
            for d, at, m in _matrices(batch.column("v")):
                dims[at] = d
                if d in centres:
                    cells[at] = (_unit(m) @ centres[d].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(dims), batch.column("id"), batch.column("v")],
                                             ["cell", "dim", "id", "v"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        of = None

        def block():
            held.sort(key=lambda r: r[0])
            units = _unit([r[1] for r in held])
            centre = centres[of[0]][of[1]] if of[1] >= 0 else np.zeros(of[0])
            cosine = np.clip(units @ centre, -1, 1)
            # a zero vector scores 0 with every query: no angle bounds it, so such blocks are never skipped
            plain = of[1] >= 0 and units.any(axis=1).all() and centre.any()
            radius = float(np.arccos(cosine.min())) if plain else math.pi
            return pa.RecordBatch.from_arrays(
                [pa.array([of[1]], pa.int32()), pa.array([of[0]], pa.int32()), pa.array([[r[0] for r in held]], pa.list_(kind)),
                 pa.array([units.tobytes()], pa.binary()), pa.array([centre.tobytes()], pa.binary()), pa.array([radius])],
                ["cell", "dim", "ids", "units", "centre", "radius"])

        kind = None
        for batch in batches:
            kind = batch.column("id").type
            vectors = [None] * batch.num_rows
            for _, at, m in _matrices(batch.column("v")):
                for i, v in zip(at.tolist(), m):
                    vectors[i] = v
            for cell, dim, i, v in zip(*(batch.column(c).to_pylist() for c in ("cell", "dim", "id")), vectors):
                if held and (of != (dim, cell) or len(held) >= BLOCK_ROWS or 8 * dim * len(held) >= BLOCK_BYTES):
                    yield block()
                    held.clear()
                of = dim, cell
                held.append((i, v))
        if held:
            yield block()

    schema = corpus.schema
    assigned = corpus.mapInArrow(assign, f"cell int, dim int, id {id_type}, v {schema['v'].dataType.simpleString()}")
    dealt = (assigned.withColumn("_h", F.xxhash64("id")).repartitionByRange(parts, "dim", "cell", "_h")
             .sortWithinPartitions("dim", "cell", "_h", "id").drop("_h"))
    return dealt.mapInArrow(pack, f"cell int, dim int, ids array<{id_type}>, units binary, centre binary, radius double")


def _extent(vectors: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of their vectors."""
    r = vectors.agg(F.count("*"), F.sum(F.size("v").cast("long"))).first()
    return r[0], 8 * (r[1] or 0)


def _grid(n: int, query_bytes: int, rows: int, row_bytes: int, parts: int) -> tuple[int, int]:
    """Stripes of the queries and parts of the corpus, each small enough for a
    task; about ``parts`` tasks at least, unless they have few pairs."""
    tasks = min(parts, n * rows // TASK_PAIRS + 1)
    stripes = max(-(-n // GROUP_QUERIES), -(-query_bytes // GROUP_BYTES), math.isqrt(tasks))
    return stripes, max(-(-row_bytes // GROUP_BYTES), -(-tasks // stripes))


def _rounded(cosines: np.ndarray) -> np.ndarray:
    """Rounding makes equal vectors score alike."""
    return np.round(cosines, 12) + 0.0


def _rows_of(rest: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    for batch in rest:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i] for c in batch.schema.names}


def _units(row: dict[str, pa.Scalar]) -> np.ndarray:
    return np.frombuffer(row["units"].as_buffer()).reshape(-1, row["dim"].as_py())


def _floors(blocks: DataFrame, centres: dict[int, np.ndarray], asked: DataFrame, k: int, stripes: int) -> DataFrame:
    """stripe, dim, ids, units, floors: the queries (id, v) packed, each with the k-th
    best of its scores against the first vectors of its home cells."""
    id_type = asked.schema["id"].dataType.simpleString()
    queries = asked.groupBy("id").agg(F.min("v").alias("v")).withColumn(
        "stripe", F.pmod(F.xxhash64("id"), F.lit(stripes)).cast("int"))
    first = blocks.groupBy("dim", "cell").agg(F.min(F.col("ids")[0]).alias("_first"))
    seeds = (blocks.join(first, ["dim", "cell"]).where(F.col("ids")[0] == F.col("_first"))
             .select("dim", "cell", F.expr(f"substring(units, 1, {max(SEED_ROWS, k)} * 8 * dim)").alias("units")))

    def nearest(u: np.ndarray, of: np.ndarray) -> np.ndarray:
        own = min(HOME_CELLS, len(of))
        return np.concatenate([np.argpartition(-(u[s:s + BLOCK_ROWS] @ of.T), own - 1, axis=1)[:, :own]
                               for s in range(0, len(u), BLOCK_ROWS)])

    def run(held, rest):
        if not held:
            return
        given: dict[int, list] = {}
        for batch in held:
            stripe = batch.column("stripe").to_numpy()
            for d, at, m in _matrices(batch.column("v")):
                given.setdefault(d, []).append((stripe[at], batch.column("id").take(pa.array(at)), _unit(m)))
        known = {}
        for d, found in given.items():
            u = np.concatenate([x[2] for x in found])
            home = nearest(u, centres[d]) if d in centres else np.zeros((len(u), 0), int)
            known[d] = (np.concatenate([x[0] for x in found]), pa.concat_arrays([x[1] for x in found]), u, home,
                        np.full((len(u), k), -2.0))
        given.clear()
        for row in _rows_of(rest):
            if (d := row["dim"].as_py()) not in known:
                continue
            _, _, u, home, best = known[d]
            units = _units(row)
            at = np.flatnonzero((home == row["cell"].as_py()).any(axis=1))
            for s in range(0, len(at), step := max(1, _SLICE_PAIRS // (len(units) + k))):
                own = at[s:s + step]
                both = np.concatenate([best[own], _rounded(u[own] @ units.T)], axis=1)
                best[own] = -np.partition(-both, k - 1, axis=1)[:, :k]
        for d, (stripe, ids, u, _, best) in known.items():
            floor = best.min(axis=1)
            for s in range(0, len(u), step := max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * d)))):
                own = slice(s, s + step)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(stripe[s:s + 1]), pa.array([d], pa.int32()), pa.array([ids[own].to_pylist()], pa.list_(ids.type)),
                     pa.array([u[own].tobytes()], pa.binary()), pa.array([floor[own].tobytes()], pa.binary())],
                    ["stripe", "dim", "ids", "units", "floors"])

    return beside(queries, seeds, "cell", 1, run, f"stripe int, dim int, ids array<{id_type}>, units binary, floors binary", stripes)


class _Best:
    """The k best hits of each query above its floor, equal scores by the smaller id."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = floor, k
        self.held: list[tuple] = []
        self.new = 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Takes hits; with as many new ones as all queries can keep, the floors rise."""
        if not len(query):
            return
        self.held.append((query, ids, score))
        self.new += len(query)
        if self.new <= self.k * len(self.floor):
            return
        query, ids, score = self._all()
        # scores have 12 digits, so a query and a score are one integer
        by = np.argsort((query << 46) - np.rint(score * 1e12).astype(np.int64))
        self._raise(query[by], score[by])
        keep = score >= self.floor[query]
        self.held, self.new = [(query[keep], ids[keep], score[keep])], 0
        if keep.sum() > 2 * self.k * len(self.floor):  # many ties at the floors
            self.held = [self.best()]

    def _all(self) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*self.held)]

    def _raise(self, query: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Places within the queries of hits in order; the k-th ones are floors."""
        head = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        place = np.arange(len(query)) - np.repeat(head, np.diff(np.append(head, len(query))))
        at = place == self.k - 1
        self.floor[query[at]] = np.maximum(self.floor[query[at]], score[at])
        return place

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, ids, score = self._all()
        by = np.lexsort((ids, -score, query))
        query, ids, score = query[by], ids[by], score[by]
        keep = self._raise(query, score) < self.k
        return query[keep], ids[keep], score[keep]


def _leading(cosine: np.ndarray, k: int) -> np.ndarray:
    """Flat places of the k best of each row, of equal ones the first."""
    n, size = cosine.shape
    if size <= k:
        return np.arange(n * size)
    if k > 16:
        best = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
    else:
        left, best = cosine.copy(), np.empty((n, k), np.int64)
        for j in range(k):
            best[:, j] = left.argmax(axis=1)
            left[np.arange(n), best[:, j]] = -np.inf
    return (np.arange(n)[:, None] * size + np.sort(best, axis=1)).ravel()


def _scores(blocks: DataFrame, packed: DataFrame, k: int, stripes: int, lanes: int) -> DataFrame:
    """query, id, score, scored: for each query candidates that hold its k best
    (score null: how many corpus vectors it was scored against in a task)."""
    q_type, id_type = (df.schema["ids"].dataType.elementType.simpleString() for df in (packed, blocks))

    def run(held, rest):
        given: dict[int, list] = {}
        for row in _rows_of(held):
            given.setdefault(row["dim"].as_py(), []).append((row["ids"].values, _units(row), np.frombuffer(row["floors"].as_buffer())))
        known = {}
        for d, found in given.items():
            u = np.concatenate([x[1] for x in found])
            known[d] = (pa.concat_arrays([x[0] for x in found]), u, u.astype(np.float32), u.any(axis=1), np.zeros(len(u), np.int64),
                        _Best(np.concatenate([x[2] for x in found]), k))
        given.clear()
        c_kind = None
        for row in _rows_of(rest):
            c_kind = row["ids"].type.value_type
            if (d := row["dim"].as_py()) not in known:
                continue
            _, u, narrow, plain, scored, best = known[d]
            units, radius = _units(row), row["radius"].as_py()
            angle = np.arccos(np.clip(u @ np.frombuffer(row["centre"].as_buffer()), -1, 1)) - radius
            bound = np.where(plain, np.cos(np.maximum(angle, 0)), 1.0)
            at = np.flatnonzero(bound + _SLACK >= best.floor)
            scored[at] += len(units)
            ids = row["ids"].values
            ids = ids.to_numpy() if pa.types.is_integer(c_kind) else np.array([*ids.to_pylist(), None], object)[:-1]
            error = _SLACK + (d + 8) * 2.0 ** -23  # of single precision
            corpus = units.astype(np.float32).T
            for s in range(0, len(at), step := max(1, _SLICE_PAIRS // len(units))):
                own = at[s:s + step]
                hit = np.flatnonzero(narrow[own] @ corpus >= (best.floor[own] - error).astype(np.float32)[:, None])
                if 32 * len(hit) > len(own) * len(units):
                    hit = _leading(_rounded(u[own] @ units.T), k)
                for t in range(0, len(hit), some := max(1, BLOCK_BYTES // (8 * d))):
                    r, c = np.divmod(hit[t:t + some], len(units))
                    r = own[r]
                    value = _rounded(np.einsum("ij,ij->i", u[r], units[c]))
                    keep = value >= best.floor[r]
                    best.add(r[keep], ids[c[keep]], value[keep])
        for _, (qids, _, _, _, scored, best) in known.items():
            if best.held:
                query, ids, score = best.best()
                for s in range(0, len(query), BLOCK_ROWS * k):
                    own = slice(s, s + BLOCK_ROWS * k)
                    yield pa.RecordBatch.from_arrays(
                        [qids.take(pa.array(query[own])), pa.array(ids[own], c_kind), pa.array(score[own]), pa.nulls(len(query[own]), pa.int64())],
                        ["query", "id", "score", "scored"])
            at = np.flatnonzero(scored)
            if len(at):
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(at)), pa.nulls(len(at), c_kind), pa.nulls(len(at), pa.float64()),
                                                  pa.array(scored[at])], ["query", "id", "score", "scored"])

    return beside(packed, blocks, "ids", lanes, run, f"query {q_type}, id {id_type}, score double, scored long", stripes)


def search(corpus: DataFrame, queries: DataFrame, k: int, vec: str = "embedding", corpus_id: str = "vec_id",
           query_id: str = "qid", query_vec: str = "qvec") -> tuple[DataFrame, DataFrame]:
    """The hits of ``top_k``, and query_id, n_scored: against how many corpus
    vectors each query was scored (the others were excluded by their cell)."""
    spark = corpus.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given, asked = _usable(corpus, corpus_id, vec), _usable(queries, query_id, query_vec)
    (rows, size), (n, asked_size) = _extent(given), _extent(asked)
    if n and rows:
        stripes, lanes = _grid(n, asked_size + 16 * k * n, rows, size, parts)
        centres = _centres(given, rows)
        blocks = materialize(_blocks(given, centres, parts), "cells")
        packed = materialize(_floors(blocks, centres, asked, k, stripes), "queries")
        every = materialize(_scores(blocks, packed, k, stripes, lanes), "hits")
    else:
        every = spark.createDataFrame([], f"query {queries.schema[query_id].dataType.simpleString()}, id "
                                          f"{corpus.schema[corpus_id].dataType.simpleString()}, score double, scored long")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc())
    best = (every.where("score is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.lit(k))
            .select(F.col("query").alias(query_id), F.col("id").alias(corpus_id), "score", "rank"))
    report = every.where("scored is not null").groupBy(F.col("query").alias(query_id)).agg(F.sum("scored").alias("n_scored"))
    return best, report


def top_k(corpus: DataFrame, queries: DataFrame, k: int, vec: str = "embedding",
          corpus_id: str = "vec_id", query_id: str = "qid", query_vec: str = "qvec") -> DataFrame:
    """query_id, corpus_id, score, rank (1..k) for each query; score 0 when
    either vector has zero norm, ties by smaller corpus id. Null ids, and vectors
    that are null or empty or hold null or non-finite components, take no part; vectors of
    another length are not compared; of a query id that repeats the smallest vector counts."""
    return search(corpus, queries, k, vec, corpus_id, query_id, query_vec)[0]


def hits(corpus: DataFrame, queries: DataFrame, k: int, query_id: str = "qid", query_vec: str = "qvec") -> DataFrame:
    """query_id, rank, query, thread, score over a corpus (id, query, thread, embeddings)."""
    best = top_k(corpus, queries, k, "embeddings", "id", query_id, query_vec)
    return best.join(corpus.select("id", "query", "thread"), "id").select(query_id, "rank", "query", "thread", "score")


def context_prompts(hits: DataFrame, texts: DataFrame, questions: DataFrame,
                    query_id: str = "qid", corpus_id: str = "vec_id") -> DataFrame:
    """Prompt per query: retrieved threads in rank order as
    ``<threadN>\\n...\\n</threadN>`` blocks (empty for a hit without a text), then
    ``Question: ...``, joined by blank lines. ``texts``: corpus_id, thread.
    ``questions``: query_id, question."""
    h = hits.join(texts, corpus_id, "left").withColumn("thread", F.coalesce("thread", F.lit("")))
    g = h.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("rank", "thread"))).alias("xs"))
    blocks = F.transform("xs", lambda x: F.concat(F.lit("<thread"), x["rank"].cast("string"), F.lit(">\n"),
                                                 x["thread"], F.lit("\n</thread"), x["rank"].cast("string"),
                                                 F.lit(">")))
    return (questions.join(g, query_id, "left")
            .select(query_id, F.array_join(F.concat(F.coalesce(blocks, F.array().cast("array<string>")),
                                                    F.array(F.concat(F.lit("Question: "), F.col("question")))),
                                           "\n\n").alias("prompt")))
