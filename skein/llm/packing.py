"""Best-fit packing by a configuration linear program.

Documents are encoded, cut into pieces of at most ``capacity`` ids and packed
into sequences. Only the histogram of piece lengths (at most ``capacity``
numbers, for any corpus) reaches the driver. There the configuration program
"fewest sequences that cover all pieces" is solved by multiplicative weights:
the price of a length falls as it gets covered, and the best configuration at
the current prices is a knapsack, solved by dynamic programming over the
capacity; this goes on until every length is covered. The fractional answer is
rounded down, configurations of the longest pieces first; what is left over is packed best-fit
decreasing, also on the histogram, by multiplicity and not piece by
piece. The plan (a few thousand rows) goes back to the executors, where a
piece finds its place from its rank among the pieces of its length.

Texts are never shuffled: the encoder writes one narrow row per piece.

Edge cases: a null or empty text is the single id 0; null ids are kept;
repeated rows are packed each; texts of any length are encoded whole; an empty
table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.batches import small_batches
from skein.llm.common import global_rank, materialize

CAPACITY = 2048
END_ID = 0
_SEPARATED = re.compile(r" \s| \Z")  # blanks that do not simply part two words
_CACHE_WORDS = 150_000
_LONG_WORD = 2000


class Encoder:
    """The ids of a byte-level BPE vocabulary, with a bounded cache of words.

    A blank between two words always starts a new unit of the vocabulary's
    splitting pattern, so a text is split there; words not met before are
    encoded together in one call and cut by their byte lengths. Texts with
    other runs of blanks are encoded whole; texts with the vocabulary's special
    strings or with very long words go to the vocabulary file's own library."""

    def __init__(self, folder: str | None = None):
        import base64
        import os

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = (lambda n: os.path.join(folder, n)) if folder else public_tokenizers.path
        self.full = Tokenizer.from_file(path("byte_bpe_50k.json"))
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        with open(path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        self.words: dict[str, bytes] = {}

    def _learn(self, fresh: list[str]) -> None:
        if len(self.words) + len(fresh) > _CACHE_WORDS:
            self.words.clear()
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(fresh)), "<u4")
        ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in fresh), np.int64, len(fresh)))
        cut = np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="right") * 4
        raw, start = ids.tobytes(), 0
        for w, end in zip(fresh, cut.tolist()):
            self.words[w] = raw[start:end]
            start = end

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for s in range(0, len(texts), 64):
            yield from self._some(texts[s:s + 64])

    def _some(self, texts: list[str]) -> Iterator[bytes]:
        split = [None if _SEPARATED.search(t) else t.split(" ") for t in texts]
        split = [None if w is not None and (any(s in t for s in self.special) or max(map(len, w)) > _LONG_WORD) else w
                 for w, t in zip(split, texts)]
        need = set()
        for w in split:
            if w is not None:
                need.update(w[1:])
        fresh = [w for w in need if w not in self.words]
        if fresh:
            self._learn(fresh)
            if len(self.words) < len(need):  # the cache was emptied for this group
                self._learn([w for w in need if w not in self.words])
        for w, t in zip(split, texts):
            if w is not None:
                yield array("I", self.fast.encode_ordinary(w[0])).tobytes() + b"".join(map(self.words.__getitem__, w[1:]))
            elif any(s in t for s in self.special) or max(map(len, t.split()), default=0) > _LONG_WORD:
                yield np.array(self.full.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                yield array("I", self.fast.encode_ordinary(t)).tobytes()


@lru_cache(maxsize=1)
def _encoder(folder: str | None) -> Encoder:
    return Encoder(folder)


def pieces(docs: DataFrame, capacity: int = CAPACITY, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned
    32-bit) of every piece; the first piece of a long document takes the odd length."""
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(folder)
        for batch in batches:
            out: list[tuple] = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, raw in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts)):
                raw += end
                total, start, k = len(raw) // 4, 0, 0
                length = total % capacity or min(total, capacity)
                while start < total:
                    part = raw[4 * start:4 * (start + length)]
                    out.append((doc, k, start, length, zlib.crc32(part), part if with_ids else None))
                    start, k, length = start + length, k + 1, capacity
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                cols = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(cols[:6 if with_ids else 5], names[:6 if with_ids else 5])
        encoder.words.clear()  # the worker lives on, its next task may be another operator's

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


Config = tuple[tuple[int, int], ...]  # (length, times), longest first


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, Config]:
    """The most valuable multiset of ``lengths`` (ascending) within the capacity."""
    value = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1, np.int64)
    below = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        k = below[c]
        worth = value[c - lengths[:k]] + prices[:k]
        i = worth.argmax()
        if worth[i] > value[c - 1]:
            value[c], pick[c] = worth[i], i
        else:
            value[c] = value[c - 1]
    used: dict[int, int] = {}
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            length = int(lengths[pick[c]])
            used[length] = used.get(length, 0) + 1
            c -= length
    return float(value[capacity]), tuple(sorted(used.items(), reverse=True))


def solve_program(histogram: dict[int, int], capacity: int) -> tuple[dict[Config, float], float]:
    """Multiplicative weights for: fewest configurations covering the histogram.
    Configurations with their (fractional) numbers, and a lower bound of any
    packing by the dual prices.

    A length's price falls as it gets covered; a round takes the best
    configuration as often as it covers one of its lengths once more, until
    every length is covered."""
    lengths = np.array(sorted(histogram), np.int64)
    count = np.array([histogram[int(n)] for n in lengths], float)
    at = {int(n): i for i, n in enumerate(lengths)}
    covered = np.zeros(len(lengths))
    chosen: dict[Config, float] = {}
    bound = 0.0
    while len(lengths) and covered.min() < 1 - 1e-9:
        # long ones start a little dearer, so that short ones are still there to fill what rounding leaves
        prices = lengths * (lengths / capacity) ** 0.1 * np.exp(-3.0 * covered)
        worth, config = knapsack(lengths, prices, capacity)
        bound = max(bound, float((count * prices).sum() / worth))  # no configuration is worth more
        step = min(count[at[n]] / k for n, k in config)
        chosen[config] = chosen.get(config, 0.0) + step
        for n, k in config:
            covered[at[n]] += step * k / count[at[n]]
    return chosen, bound


def best_fit(histogram: dict[int, int], capacity: int) -> dict[Config, int]:
    """Best-fit decreasing by multiplicity: sequences with equal free room are filled together."""
    free: dict[int, dict[tuple[int, ...], int]] = {}
    room: list[int] = []

    def put(r: int, content: tuple[int, ...], n: int) -> None:
        if r not in free:
            free[r] = {}
            room.insert(bisect_left(room, r), r)
        free[r][content] = free[r].get(content, 0) + n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            i = bisect_left(room, length)
            if i < len(room):
                r = room[i]
                content, n = free[r].popitem()
                if not free[r]:
                    del free[r]
                    room.pop(i)
                used = min(n, left)
                if n > used:
                    put(r, content, n - used)
                put(r - length, content + (length,), used)
                left -= used
            else:
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, (length,) * each, left // each)
                    left %= each
                else:
                    put(capacity - left * length, (length,) * left, 1)
                    left = 0
    out: dict[Config, int] = {}
    for groups in free.values():
        for content, n in groups.items():
            config = tuple(sorted(((x, content.count(x)) for x in set(content)), reverse=True))
            out[config] = out.get(config, 0) + n
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Config, int]]:
    """(configuration, copies) that hold exactly the histogram's pieces."""
    left = dict(histogram)
    out: list[tuple[Config, int]] = []
    whole = left.pop(capacity, 0)
    if whole:
        out.append((((capacity, 1),), whole))
    chosen, _ = solve_program(left, capacity)
    # those of the longest pieces first: short ones find a place anywhere
    for config, x in sorted(chosen.items(), key=lambda kv: -kv[0][0][0]):
        copies = min([int(x), *(left.get(n, 0) // k for n, k in config)])
        if copies > 0:
            out.append((config, copies))
            for n, k in config:
                left[n] -= copies * k
    return out + sorted(best_fit({n: k for n, k in left.items() if k}, capacity).items())


def places(planned: list[tuple[Config, int]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, pieces in a copy, first sequence, offset), by first rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for config, copies in planned:
        offset = 0
        for length, k in config:
            rows.setdefault(length, []).append((ranks.get(length, 0), k, sequence, offset))
            ranks[length] = ranks.get(length, 0) + k * copies
            offset += k * length
        sequence += copies
    return {n: np.array(x, np.int64) for n, x in rows.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialize(pieces(docs, capacity, folder), "pieces")
    # at most ``capacity`` rows
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = places(plan(histogram, capacity))
    below, first = 0, {}
    for n in sorted(histogram):
        first[n] = below
        below += histogram[n]
    ranked, _ = global_rank(cut, ["length", "doc_id", "piece", "ids_crc32"], "piece_order")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.nonzero(length == n)[0]
                rows = table[int(n)]
                r = rank[at] - first[int(n)]
                hit = rows[np.searchsorted(rows[:, 0], r, side="right") - 1]
                copy, slot = np.divmod(r - hit[:, 0], hit[:, 1])
                sequence[at] = hit[:, 2] + copy
                offset[at] = hit[:, 3] + slot * n
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
