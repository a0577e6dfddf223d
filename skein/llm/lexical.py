"""Ranked lexical search over bit-sliced Bloom signatures, exact.

Index. Documents of like size are put into blocks. In a block every document
has a Bloom signature of the same number of bits, stored across documents: bit
i of all of them is one bitmap, a row of document bits. A term goes into the
signature once for each level of ``LEVELS`` that its frequency reaches. The
bitmaps of a (term, level) and-ed together name all documents that have the
term so often, and a few more.

Bounds. For a query the bitmaps of each level, weighted by the terms' weights,
are summed up over its terms; each level adds what a term can score more when
it is reached (up to just below the next level). The sum is never below the
exact score. So, for each query:

1. the k documents of the highest bounds are scored exactly, which gives a
   floor (the k-th best score and its document);
2. every document whose bound is not below the floor (at the floor: whose id
   is not above) is scored exactly from its text. No other can be among the k
   best, so the answer is exact.

Queries travel in packed blocks next to the rows they are compared with; what
is shuffled besides are k rows for each query and partition and the documents
that the bounds could not exclude.

Scores. A term is a run of ASCII letters and digits and of characters beyond
ASCII, A-Z lower-cased. N counts the documents with a term, L all terms, n
those of one document, df the documents with a term, tf its occurrences. A
term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))); a document has
m = 100 - B + (B n N) div L with B = 75 and a score of the sum of
w * ((10^9 tf) div (1000 tf + 8 m)) over the query's terms, repeats included.

Edge cases: a null text has no term, as an empty one; texts of any length are
read whole; every row is a document of its own (repeated rows count in N, L
and df and are ranked each); a null doc_id comes last among ties; of an item
id that repeats the smallest text counts; an item without terms, or empty
tables, give no rows; further input columns are ignored. Terms are compared as
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.batches import small_batches
from skein.llm.common import FILTER_BITS, NO_ID, back_to_id, doc_key, global_rank, materialize, only_keys, partitions
from skein.llm.shingles import mix
from skein.llm.words import FOLDED, TERM, groups, words
from skein.operators.beside import beside

K = 10
B = 75
BLOCK_ITEMS = 256  # queries in a packed block; fewer when their texts are long
GROUP_BLOCKS = 32  # query blocks that a task holds at a time
LEVELS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256, 512, 1024, 4096, 16384], np.int64)
BITS = 8  # signature bits for each (term, level), at least
HASHES = 4
_BLOCK_BITS = 1 << 21
_MOST_DOCS = 1024
_SLICE = 64  # queries bounded at a time
_TURN = mix(np.arange(1, 1 + HASHES, dtype=np.uint64)) | np.uint64(1)
_LEVEL = mix(np.arange(100, 100 + len(LEVELS), dtype=np.uint64)) | np.uint64(1)


def _bits(hashes: np.ndarray, level: int, log_bits: int) -> np.ndarray:
    """The signature bits (HASHES columns) of terms at a level."""
    h = mix(hashes * _LEVEL[level] + np.uint64(level))
    return ((h[:, None] * _TURN) >> np.uint64(64 - log_bits)).astype(np.int64)


def _part(tf, m):
    return 1000000000 * tf // (1000 * tf + 8 * m)


class _Blocks:
    """Collects documents by signature size and packs them into blocks."""

    def __init__(self):
        self.open: dict[int, list] = {}

    def add(self, key: int, th: int, n: int, hashes: np.ndarray, tf: np.ndarray):
        reached = np.searchsorted(LEVELS, tf, "right")
        log_bits = max(6, int(BITS * int(reached.sum()) - 1).bit_length())
        held = self.open.setdefault(log_bits, [])
        held.append((key, th, n, hashes, reached))
        if len(held) >= min(max(_BLOCK_BITS >> log_bits, 8), _MOST_DOCS):
            yield self.pack(log_bits)

    def pack(self, log_bits: int) -> tuple:
        docs = sorted(self.open.pop(log_bits), key=lambda d: d[:2])
        slices = np.zeros((1 << log_bits, -(-len(docs) // 8)), np.uint8)
        for i, (_, _, _, hashes, reached) in enumerate(docs):
            for level in range(int(reached.max())):
                bits = _bits(hashes[reached > level], level, log_bits).ravel()
                slices[bits, i // 8] |= np.uint8(1 << (i % 8))
        ids, ths, ns = (np.array(c, "<i8") for c in zip(*(d[:3] for d in docs)))
        return log_bits, ids.tobytes(), ths.tobytes(), ns.tobytes(), slices.tobytes()

    def rest(self):
        for log_bits in list(self.open):
            yield self.pack(log_bits)


_INDEX = "log_bits int, ids binary, ths binary, ns binary, slices binary, docs long, terms long, hash long, df long"


def index(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Block rows (log_bits, ids, ths, ns, slices; docs and terms counted), and
    rows (hash, df): in how many documents of a task terms occur whose bit in
    ``wanted`` (a bitmap of FILTER_BITS) is set. ``docs``: _id, _th, raw."""
    names = [c.split()[0] for c in _INDEX.split(", ")]
    kinds = [pa.int32(), *[pa.binary()] * 4, *[pa.int64()] * 4]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)

    def block(packed: tuple) -> pa.RecordBatch:
        ns = np.frombuffer(packed[3], "<i8")
        return rows([(*packed, len(ns), int(ns.sum()), None, None)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, seen, pending = _Blocks(), [], 0
        for batch, raw, at in groups(batches, "raw"):
            _, _, hashes, first = words(raw, at, TERM, FOLDED)
            for key, th, a, b in zip(batch.column("_id").to_pylist(), batch.column("_th").to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                if a == b:
                    continue
                distinct, tf = np.unique(hashes[a:b], return_counts=True)
                for packed in blocks.add(key, th, b - a, distinct, tf):
                    yield block(packed)
                hit = distinct[_in_bitmap(distinct, wanted)]
                seen.append(hit)
                pending += len(hit)
            if pending > 1 << 20:
                yield _counted(seen)
                seen, pending = [], 0
        for packed in blocks.rest():
            yield block(packed)
        if pending:
            yield _counted(seen)

    def _counted(seen: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(seen), return_counts=True)
        none = [pa.nulls(len(h), t) for t in kinds[:7]]
        return pa.RecordBatch.from_arrays([*none, pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names)

    return docs.mapInArrow(run, _INDEX)


def _in_bitmap(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bit = hashes % np.uint64(FILTER_BITS)
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _bitmap(terms: DataFrame) -> np.ndarray:
    """The bits of all term hashes: 2 MB, whatever the number of queries."""
    # the unsigned remainder by a power of two is the low bits
    bit = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    found = (terms.select(F.shiftright(bit, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast((hash & {FILTER_BITS - 1}) % 64 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).collect())  # at most FILTER_BITS / 64 rows
    out = np.zeros(FILTER_BITS // 64, "<i8")
    for r in found:
        out[r["w"]] = r["b"]
    return out.view(np.uint8)


def query_terms(items: DataFrame, item_col: str = "item_id") -> DataFrame:
    """item, hash, times: the terms of each item and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, at in groups(batches, "raw"):
            _, _, hashes, first = words(raw, at, TERM, FOLDED)
            for item, a, b in zip(batch.column("item").to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                h, n = np.unique(hashes[a:b], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), item)), pa.array(h.view(np.int64)), pa.array(n, pa.int64())],
                                                 ["item", "hash", "times"])

    one = items.groupBy(doc_key(item_col).alias("item")).agg(F.min("text").alias("text"))
    rows = one.select("item", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    return rows.mapInArrow(run, "item long, hash long, times long")


def _packed(terms: DataFrame, floors: DataFrame | None) -> DataFrame:
    """One row for each block of queries: their terms, and their floors."""
    per_item = terms.groupBy("item", "block").agg(F.sort_array(F.collect_list(F.struct("hash", "gain"))).alias("terms"))
    if floors is None:
        per_item = per_item.withColumns({"score": F.lit(1).cast("long"), "last": F.lit(2 ** 63 - 1), "last_th": F.lit(2 ** 63 - 1)})
    else:
        per_item = per_item.join(floors, "item", "left").withColumns(
            {"score": F.coalesce("score", F.lit(1).cast("long")), "last": F.coalesce("last", F.lit(2 ** 63 - 1)),
             "last_th": F.coalesce("last_th", F.lit(2 ** 63 - 1))})
    return (per_item.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("item", "score", "last", "last_th", "terms"))).alias("q"))
            .select("block", *[F.col(f"q.{c}").alias(c) for c in ("item", "score", "last", "last_th")],
                    F.transform("q", lambda x: F.size(x["terms"])).alias("sizes"), *[F.flatten(F.transform("q", lambda x: x["terms"][c])).alias(c) for c in ("hash", "gain")]))


class _Query:
    """A slice of queries: their terms as a weight matrix."""

    def __init__(self, items, score, last, last_th, sizes, hashes, gains):
        self.items, self.score, self.last, self.last_th = items, score, last, last_th
        self.hashes, where = np.unique(hashes.view(np.uint64), return_inverse=True)
        self.weights = np.zeros((len(items), len(self.hashes)))
        np.add.at(self.weights, (np.repeat(np.arange(len(items)), sizes), where), gains)
        if self.weights.sum(axis=1).max(initial=0) < 1 << 24:  # sums stay exact
            self.weights = self.weights.astype(np.float32)


def _queries(held: list[pa.RecordBatch]) -> list[_Query]:
    out = []
    for batch in held:
        for row in batch.to_pylist():
            start = np.append(0, np.cumsum(row["sizes"]))
            arrays = {c: np.array(row[c], np.int64) for c in ("item", "score", "last", "last_th", "sizes", "hash", "gain")}
            for s in range(0, len(row["item"]), _SLICE):
                e = min(s + _SLICE, len(row["item"]))
                terms = slice(start[s], start[e])
                out.append(_Query(*(arrays[c][s:e] for c in ("item", "score", "last", "last_th", "sizes")), arrays["hash"][terms], arrays["gain"][terms]))
    return out


def bounds(query: _Query, slices: np.ndarray, log_bits: int, m: np.ndarray) -> np.ndarray:
    """For each query and document of a block a score that it does not exceed."""
    total = np.zeros((len(query.items), len(m)))
    alive = np.arange(len(query.hashes))
    bitmap = None
    before = np.zeros(len(m), np.int64)
    for level in range(len(LEVELS)):
        rows = slices[_bits(query.hashes[alive], level, log_bits)]
        found = np.bitwise_and.reduce(rows, axis=1)
        bitmap = found if bitmap is None else bitmap & found
        some = bitmap.any(axis=1)
        alive, bitmap = alive[some], bitmap[some]
        if not len(alive):
            break
        most = LEVELS[level + 1] - 1 if level + 1 < len(LEVELS) else 1 << 40
        best = np.full(len(m), 1000000) if most > 1 << 30 else _part(most, m)
        present = np.unpackbits(bitmap, axis=1, count=len(m), bitorder="little")
        total += (query.weights[:, alive] @ present.astype(query.weights.dtype)).astype(np.float64) * (best - before)
        before = best
    return total.astype(np.int64)


def _best(terms: DataFrame, blocks: DataFrame, n_docs: int, n_terms: int, k: int, parts: int) -> DataFrame:
    """item, _id, _th, bound: the k documents of the highest bounds."""

    def run(held: list[pa.RecordBatch], rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = _queries(held)
        best: list = [None] * len(queries)
        for ids, ths, m, slices, log_bits in _unpacked(rest, n_docs, n_terms):
            for i, q in enumerate(queries):
                bound = bounds(q, slices, log_bits, m)
                own = np.argsort(-bound, axis=1, kind="stable")[:, :k]  # documents of a block ascend
                found = [np.take_along_axis(bound, own, 1), ids[own], ths[own]]
                if best[i] is not None:
                    found = [np.concatenate([a, b], axis=1) for a, b in zip(best[i], found)]
                    top = np.lexsort((found[2], found[1], -found[0]))[:, :k]
                    found = [np.take_along_axis(c, top, 1) for c in found]
                best[i] = found
        for q, found in zip(queries, best):
            r, c = np.nonzero(found[0] > 0)
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(q.items[r]), pa.array(found[1][r, c]), pa.array(found[2][r, c]),
                                                  pa.array(found[0][r, c])], ["item", "_id", "_th", "bound"])

    found = beside(_packed(terms, None), blocks, "ids", parts, run, "item long, _id long, _th long, bound long")
    order = Window.partitionBy("item").orderBy(F.col("bound").desc(), "_id", "_th")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def _unpacked(rest: Iterator[pa.RecordBatch], n_docs: int, n_terms: int):
    for batch in rest:
        for i in range(batch.num_rows):
            log_bits, ids, ths, ns, slices = (batch.column(c)[i].as_py() for c in ("log_bits", "ids", "ths", "ns", "slices"))
            ids, ths, ns = (np.frombuffer(x, "<i8") for x in (ids, ths, ns))
            yield ids, ths, _length(ns, n_docs, n_terms), np.frombuffer(slices, np.uint8).reshape(1 << log_bits, -1), log_bits


def _length(n, n_docs: int, n_terms: int):
    return 100 - B + B * n * n_docs // n_terms


def _not_excluded(terms: DataFrame, floors: DataFrame, blocks: DataFrame, n_docs: int, n_terms: int, parts: int) -> DataFrame:
    """item, _id, _th of every document whose bound reaches the query's floor."""

    def run(held: list[pa.RecordBatch], rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = _queries(held)
        for ids, ths, m, slices, log_bits in _unpacked(rest, n_docs, n_terms):
            for q in queries:
                bound = bounds(q, slices, log_bits, m)
                floor, last, last_th = q.score[:, None], q.last[:, None], q.last_th[:, None]
                r, c = np.nonzero((bound > floor) | (bound == floor) & ((ids < last) | (ids == last) & (ths <= last_th)))
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(q.items[r]), pa.array(ids[c]), pa.array(ths[c])], ["item", "_id", "_th"])

    return beside(_packed(terms, floors), blocks, "ids", parts, run, "item long, _id long, _th long")


def _scored(docs: DataFrame, pairs: DataFrame, terms: DataFrame, n_docs: int, n_terms: int, parts: int) -> DataFrame:
    """item, _id, _th, score: exact scores of ``pairs`` (item, _id, _th)."""

    def run(held: list[pa.RecordBatch], rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for batch in held:
            for row in batch.to_pylist():
                start = np.append(0, np.cumsum(row["sizes"])).tolist()
                hashes, gains = np.array(row["hash"], np.int64).view(np.uint64), np.array(row["gain"], np.int64)
                for i, item in enumerate(row["item"]):
                    known[item] = hashes[start[i]:start[i + 1]], gains[start[i]:start[i + 1]]
        for batch, raw, at in groups(rest, "raw"):
            _, _, every, first = words(raw, at, TERM, FOLDED)
            out = []
            for i, (key, th, items) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_id", "_th", "items")))):
                own, tf = np.unique(every[first[i]:first[i + 1]], return_counts=True)
                m = _length(int(first[i + 1] - first[i]), n_docs, n_terms)
                for item in items:
                    hashes, gains = known[item]
                    place = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
                    n = np.where(own[place] == hashes, tf[place], 0)
                    out.append((item, key, th, int((gains * _part(n, m)).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["item", "_id", "_th", "score"])

    wanted = pairs.groupBy("_id", "_th").agg(F.collect_set("item").alias("items"))
    texts = only_keys(docs, wanted, ["_id", "_th"]).join(wanted, ["_id", "_th"])
    return beside(_packed(terms, None), texts, "_id", parts, run, "item long, _id long, _th long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item."""
    parts = partitions(docs)
    text = F.coalesce("text", F.lit(""))
    keyed = small_batches(docs).select(doc_key(id_col).alias("_id"), F.xxhash64(text).alias("_th"), F.encode(text, "UTF-8").alias("raw"))
    keyed = keyed.withColumn("_id", F.when(F.col("_id") == F.lit(NO_ID), F.lit(2 ** 63 - 1)).otherwise(F.col("_id")))  # null ids are last
    asked = materialize(query_terms(items, item_col), "query_terms")
    built = materialize(index(keyed, _bitmap(asked)), "signatures")
    blocks = built.where("ids is not null").select("log_bits", "ids", "ths", "ns", "slices")
    size = built.agg(F.sum("docs").alias("n"), F.sum("terms").alias("l")).first()
    n_docs, n_terms = size["n"] or 0, size["l"] or 0
    empty = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not n_docs:
        return empty
    df = built.where("hash is not null").groupBy("hash").agg(F.sum("df").alias("df"))
    ranked, n_items = global_rank(asked.select("item").distinct(), ["item"], "query_items", "_n")
    weight = F.floor(1000 * F.log((2 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    terms = materialize(asked.join(df, "hash").join(ranked, "item").select(
        "item", F.expr(f"_n div {BLOCK_ITEMS}").alias("block"), "hash", (F.col("times") * weight).alias("gain")).where("gain > 0"), "query_weights")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "_id", "_th")
    results = []
    n_blocks = -(-n_items // BLOCK_ITEMS)
    for g in range(0, n_blocks, GROUP_BLOCKS):  # one chain of jobs for each BLOCK_ITEMS * GROUP_BLOCKS queries
        own = terms.where((F.col("block") >= g) & (F.col("block") < g + GROUP_BLOCKS))
        first = _scored(keyed, _best(own, blocks, n_docs, n_terms, k, parts), own, n_docs, n_terms, parts)
        floors = (first.where("score > 0").withColumn("_n", F.row_number().over(order)).where(F.col("_n") == k)
                  .select("item", "score", F.col("_id").alias("last"), F.col("_th").alias("last_th")))
        floors = materialize(floors, "floors")
        pairs = materialize(_not_excluded(own, floors, blocks, n_docs, n_terms, parts), "not_excluded")
        best = (_scored(keyed, pairs, own, n_docs, n_terms, parts).where("score > 0")
                .withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k))
        results.append(materialize(best, "ranked"))
    out = empty
    for r in results:
        key = F.when(F.col("_id") != F.lit(2 ** 63 - 1), F.col("_id"))
        out = out.unionByName(r.select(back_to_id("item").alias("item_id"), "rank", key.alias("doc_id"), "score"))
    return out
