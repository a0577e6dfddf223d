"""Sharding by Hilbert-curve order.

Several metadata dimensions (by default text size, source and language) are
quantised to ``bits`` bits each at sampled quantile boundaries, each row gets
its index on the Hilbert curve through that grid, rows are put in curve order
and the order is cut into runs of equal row counts. Neighbours on the curve
are neighbours in every dimension, so each shard covers a small box of the
metadata space and file statistics prune on any of the dimensions.

Only DataFrame functions run: the curve is a state machine (one lookup per
bit level) evaluated by ``aggregate`` over a literal table, and the rank comes
from range partitioning plus one offset per partition. Texts never cross the
network, only (id, size, checksum, dimensions).

Edge cases: a null text has size 1 and checksum 0 (as an empty text); null
ids, sources and languages sort first and are kept; repeated rows each get a
slot of their own; an empty table gives an empty result; further columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import global_rank, materialize, text_or_empty
from skein.operators.ordering import running_sum_within_groups


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """``digit`` and ``next state`` of the Hilbert curve in ``dims`` dimensions,
    indexed by ``state * 2**dims + code``; a state is the entry corner and the
    direction of a cell, a code has one bit of each dimension."""
    size, mask = 1 << dims, (1 << dims) - 1

    def left(x: int, k: int) -> int:
        k %= dims
        return ((x << k) | (x >> (dims - k))) & mask

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    position = {gray(i): i for i in range(size)}

    def entry(w: int) -> int:
        return 0 if w == 0 else gray(2 * ((w - 1) // 2))

    def direction(w: int) -> int:
        if w == 0:
            return 0
        odd = w if w % 2 else w - 1
        return (((odd + 1) & -(odd + 1)).bit_length() - 1) % dims

    states, digit, following = {(0, 0): 0}, [], []
    queue = [(0, 0)]
    for e, d in queue:
        for code in range(size):
            w = position[left(code ^ e, dims - ((d + 1) % dims))]
            to = (e ^ left(entry(w), d + 1), (d + direction(w) + 1) % dims)
            if to not in states:
                states[to] = len(states)
                queue.append(to)
            digit.append(w)
            following.append(states[to])
    return digit, following


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Index on the curve of the grid cell with the given coordinates (0 to 2**bits - 1 each)."""
    dims = len(cells)
    digit, following = curve_tables(dims)
    digits, nexts = F.array(*map(F.lit, digit)), F.array(*map(F.lit, following))
    level_codes = F.array(*[
        sum((F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1)), j) for j, c in enumerate(cells)), F.lit(0)).cast("int")
        for b in range(bits - 1, -1, -1)])
    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"))

    def step(acc, code):
        at = acc["s"] * F.lit(1 << dims) + code
        return F.struct(F.get(nexts, at).alias("s"),
                        (F.shiftleft(acc["h"], dims) + F.get(digits, at)).cast("long").alias("h"))

    return F.aggregate(level_codes, start, step)["h"]


def with_value_cell(df: DataFrame, column: str, out: str, bits: int) -> DataFrame:
    """``df`` with ``out``: the cell of a text column's value. The distinct values
    are put in order (nulls first) and the rows before each are counted; a
    value's cell is that share of all rows, so cells hold like numbers of rows
    whatever the values look like, and a common start of them hides nothing."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_sum_within_groups(counts.withColumn("_all", F.lit(0)), ["_all"], [F.col(column).asc_nulls_first()], "_n", "_before")
    total = df.count()
    cells = placed.select(F.col(column).alias("_value"), F.expr(f"_before * {1 << bits} div {max(total, 1)}").cast("int").alias(out))
    return df.join(cells, F.col(column).eqNullSafe(F.col("_value"))).drop("_value")


def quantised(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """Cells of numeric columns: the number of sampled quantile boundaries below the value."""
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(c, steps).alias(c) for c in dims]).first()

    def cell(c: str) -> Column:
        bounds = sorted(set(found[c] or []))
        if not bounds:
            return F.lit(0)
        return F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b < F.col(c)))

    return [cell(c) for c in dims]


def shard_documents(docs: DataFrame, shards: int = 16, bits: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve.

    Law ``rows``: shard s holds the ranks from s*N/shards to (s+1)*N/shards,
    rounded down, so counts differ by one at most; slots follow the curve.
    Equal texts of one source lie next to each other (ties on the curve are
    ordered by checksum, then id)."""
    text = text_or_empty()
    narrow = materialize(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.col("source").cast("string").alias("_source"), F.col("lang").cast("string").alias("_lang")), "shard_rows")
    valued = with_value_cell(with_value_cell(narrow, "_source", "_source_cell", bits), "_lang", "_lang_cell", bits)
    cells = [*quantised(narrow, ["size"], bits), F.col("_source_cell"), F.col("_lang_cell")]
    placed = valued.select("doc_id", "size", "text_crc32", hilbert_index(cells, bits).alias("curve"))
    ranked, total = global_rank(placed, ["curve", "text_crc32", "size", "doc_id"], "shard_order")
    # shard s holds rank r when floor(s*N/k) <= r < floor((s+1)*N/k), so s = floor((r*k + k - 1) / N)
    shard = F.expr(f"(rank * {shards} + {shards - 1}) div {max(total, 1)}").cast("long")
    return ranked.withColumn("_shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"),
        (F.col("rank") - F.expr(f"(_shard * {total}) div {shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve")
