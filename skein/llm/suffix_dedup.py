"""Removal of repeated passages with a distributed, sparse suffix array.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts
somewhere else. The suffixes that are sorted are those at anchors: in each
window of ``LENGTH`` bytes, the position of the smallest hash of ``GRAM``
bytes (the leftmost, if there are several). The anchor is a function of the
window's bytes, so equal windows have their anchor at the same place in them,
and each window belongs to exactly one anchor.

1. Anchors are hashed; only those whose leading bytes occur again go on.
2. Their suffixes, with the bytes to the left that their windows reach, are
   range-partitioned by leading bytes at sampled splitters. Leading bytes that
   occur more than ``HEAVY`` times are salted, so they spread over several
   buckets; all others stay together.
3. A bucket sorts its suffixes and its reversed left parts by multikey
   quicksort, eight bytes at a time, which also gives the longest common
   prefixes. Two windows that take t bytes from the suffix are equal when
   the suffixes share t bytes and the left parts the other ``LENGTH - t``.
4. Strings that lie across buckets' boundaries (the salted ones) are compared
   by a digest of each window, counted within the bucket before it is sent; a
   bucket's digests travel packed, one message for each range of digests.

Equal windows of one document are found where the anchors are made, so a
document that repeats one word sends one suffix and not thousands.

The same jobs find repeated passages of ``PASSAGE`` words (runs of anything but
blanks): there a text is the string of its words' 32-bit hashes, so that short words
do not hide a passage that is long in words but not in bytes.

Edge cases: a null text is empty; each row is a document of its own, so
repeated rows are copies of each other and give a row each; null ids are kept;
texts of any length are read whole, in segments; an empty table gives an empty
result; further input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.batches import frugal, small_batches
from skein.llm.common import back_to_id, binary_parts, doc_key, materialize, only_keys, partitions
from skein.llm.shingles import mix
from skein.llm.words import groups, words

LENGTH = 400
GRAM = 64
HEAVY = 1024
PASSAGE = 51  # words
PASSAGE_GRAM = 32  # bytes: eight words
_WORD = 4  # bytes of a word's hash
_SEGMENT = 1 << 18
_DIGEST = np.dtype([("w1", "<i8"), ("w2", "<i8"), ("n", "<i4"), ("id", "<i8"), ("th", "<i8"), ("lo", "<i8")])
_LOW = (1 << 20) - 1
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two) from each position; of as many
    words, where ``raw`` holds words' hashes."""
    h, width, times = _BYTE[raw] if raw.dtype == np.uint8 else raw, 1, 0x5851F42D4C957F2D
    while width < gram:
        h = h[:-width] * np.uint64(times) + h[width:]
        width, times = 2 * width, times * times % 2 ** 64
    return mix(h)


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, from running minima of blocks of w."""
    m = -(-len(x) // w) * w
    blocks = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    blocks[:len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:len(x) - w + 1], ahead[w - 1:len(x)])


def anchors(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """hash, position, first and last window start of each anchor of a text."""
    out: list[tuple] = []
    windows = len(raw) - length + 1
    for s in range(0, windows, _SEGMENT):
        n = min(_SEGMENT, windows - s)
        h = gram_hashes(raw[s:s + n + length - 1], gram)
        place = np.arange(len(h), dtype=np.uint64)
        low = _window_min((h & np.uint64(~_LOW & (2 ** 64 - 1))) | place, length - gram + 1)
        at = (low & np.uint64(_LOW)).astype(np.int64)
        first = np.nonzero(np.append(True, at[1:] != at[:-1]))[0]
        last = np.append(first[1:], n) - 1
        out.append((h[at[first]].view(np.int64), s + at[first], s + first, s + last))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(4))


def group_anchors(values: np.ndarray, at: np.ndarray, length: int, gram: int):
    """text, hash, position, first and last window start of each anchor of the
    texts values[at[i]:at[i + 1]], all in one go: of the windows that an anchor
    owns those stay that lie in its text."""
    h, pos, lo, hi = anchors(values, length, gram)
    text = np.searchsorted(at, pos, "right") - 1
    lo, hi = np.maximum(lo, at[text]), np.minimum(hi, at[text + 1] - length)
    own = lo <= hi
    text, start = text[own], at[text[own]]
    return text, h[own], pos[own] - start, lo[own] - start, hi[own] - start


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _word_bytes(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype("<u4").view(np.uint8)


def _by_words(raw: bytes) -> bytes:
    return _word_bytes(words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[2]).tobytes()


def _anchor_rows(docs: DataFrame, length: int, gram: int, by_word: bool = False) -> DataFrame:
    """_id, _th, hash, pos, lo, hi of each distinct anchor of a document; rows
    without a hash are spans [lo, hi) that repeat inside the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "_th", "hash", "pos", "lo", "hi"]
        for batch, data, at in groups(batches, "raw"):
            if by_word:
                _, _, hashes, first = words(data, at)
                data, at = _word_bytes(hashes), first * _WORD
            ids, ths = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_th"))
            if by_word:  # windows of whole words only
                doc, h, *places = group_anchors(hashes, first, length // _WORD, gram // _WORD)
                pos, lo, hi = (x * _WORD for x in places)
            else:
                doc, h, pos, lo, hi = group_anchors(data, at, length, gram)
            keep, inner = np.ones(len(h), bool), []
            order = np.lexsort((h, doc))
            equal = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
            again = np.zeros(len(h), bool)
            again[order[1:][equal]] = True
            again[order[:-1][equal]] = True
            again = np.flatnonzero(again)
            for k in np.unique(doc[again]).tolist():  # documents with an anchor that occurs twice
                seen, spans = {}, []
                whole = data[at[k]:at[k + 1]].tobytes()
                for i in again[doc[again] == k].tolist():
                    a, b = int(lo[i]), int(hi[i]) + length
                    bytes_ = (int(pos[i]) - a, whole[a:b])
                    if bytes_ in seen:
                        keep[i] = False
                        spans += [(a, b), seen[bytes_]]
                    else:
                        seen[bytes_] = (a, b)
                inner += [(ids[k], ths[k], a, b) for a, b in merged(spans)]
            if keep.any():
                columns = (ids[doc[keep]], ths[doc[keep]], h[keep], pos[keep], lo[keep], hi[keep])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
            if inner:
                i, t, a, b = zip(*inner)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(t, pa.int64()), pa.nulls(len(i), pa.int64()),
                                                  pa.array(a, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)

    return docs.mapInArrow(frugal(run), "_id long, _th long, hash long, pos long, lo long, hi long")


def _suffixes(docs: DataFrame, wanted: DataFrame, length: int, gram: int, by_word: bool = False) -> DataFrame:
    """_id, _th, pos, gram, salt, right (the suffix as far as its windows reach), left (reversed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "_th", "pos", "gram", "salt", "right", "left"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
        for batch in batches:
            rows: list[tuple] = []
            for i, t, raw, found in zip(*(batch.column(c).to_pylist() for c in ("_id", "_th", "raw", "found"))):
                raw = _by_words(raw) if by_word else raw
                for x in found:
                    p, lo, hi = x["pos"], x["lo"], x["hi"]
                    salt = 1 + (i * 31 + t + p * 17) % 2 ** 61 % -(-x["n"] // HEAVY) if x["n"] > HEAVY else 0
                    rows.append((i, t, p, raw[p:p + gram], salt, raw[p:hi + length], raw[lo:p][::-1]))
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return (only_keys(docs, wanted, ["_id", "_th"]).join(wanted, ["_id", "_th"])
            .mapInArrow(frugal(run), "_id long, _th long, pos long, gram binary, salt long, right binary, left binary"))


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix (width a multiple of eight), and each
    row's common prefix with the one before it in that order (0 for the first).

    Multikey quicksort with words of eight bytes as keys: all parts that are
    still equal are split by their next word in one step, parts of one row are
    done."""
    n, width = rows.shape
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order, common = np.arange(n), np.full(n, width, np.int64)
    if n:
        common[0] = 0
    part = np.zeros(n, np.int64)  # the part of the row at each place
    active = np.arange(n) if n > 1 else np.zeros(0, np.int64)  # places still in parts of two or more
    for d in range(width // 8):
        if not len(active):
            break
        key = words[order[active], d]
        by = np.lexsort((key, part[active]))
        order[active] = order[active][by]
        key, own = key[by], part[active]
        new = np.append(True, (own[1:] != own[:-1]) | (key[1:] != key[:-1]))
        split = np.nonzero(new[1:] & (own[1:] == own[:-1]))[0] + 1
        if len(split):
            differ = (key[split] ^ key[split - 1]).astype(">u8").view(np.uint8).reshape(-1, 8)
            common[active[split]] = 8 * d + (differ != 0).argmax(axis=1)
        label = np.cumsum(new)
        size = np.bincount(label)
        part[active] = label
        active = active[size[label] > 1]
    return order, common


def _matrix(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a binary column, padded with zeros, and their lengths."""
    raw, at = binary_parts(column)
    size = np.diff(at)
    out = np.zeros((len(size), width), np.uint8)
    out[np.arange(width) < size[:, None]] = raw
    return out, size


def repeated_windows(right: np.ndarray, right_len: np.ndarray, left: np.ndarray, left_len: np.ndarray, length: int, gram: int, step: int = 1):
    """For each suffix the smallest and largest t at which its window occurs
    again (0 if none does). A window of t takes t bytes of the suffix; windows
    begin ``step`` bytes apart."""
    n = len(right)
    by_right, common_right = multikey_sort(right)
    by_left, common_left = multikey_sort(left)
    rank_right, rank_left = np.empty(n, np.int64), np.empty(n, np.int64)
    rank_right[by_right] = np.arange(n)
    rank_left[by_left] = np.arange(n)
    group = np.cumsum(common_right < gram)[rank_right]
    size = np.bincount(group)
    alike = size[group] > 1
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    first, last = length - left_len, right_len
    rows = np.nonzero(alike)[0]
    if len(rows):
        for t in range(int(first[rows].min()), int(last[rows].max()) + 1, step):
            own = rows[(first[rows] <= t) & (last[rows] >= t)]
            if len(own) < 2:
                continue
            same = np.cumsum(common_right < t)[rank_right[own]] * (n + 1) + np.cumsum(common_left < length - t)[rank_left[own]]
            by = np.argsort(same, kind="stable")
            equal = same[by][1:] == same[by][:-1]
            twice = np.zeros(len(own), bool)
            twice[by[1:][equal]] = True
            twice[by[:-1][equal]] = True
            hit = own[twice]
            low[hit] = np.where(low[hit] == 0, t, low[hit])
            high[hit] = t
    return low, high


def _compare(suffixes: DataFrame, length: int, gram: int, step: int = 1) -> DataFrame:
    """Spans (lo, hi) of repeated windows, and messages (part, digests) of the
    windows of salted strings: how often each occurs in this bucket, and where
    the first one is."""
    n = partitions(suffixes)
    wide = -(-length // 8) * 8
    names = ["_id", "_th", "lo", "hi", "part", "digests"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        ids, ths, pos, salt = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("_id", "_th", "pos", "salt"))
        right, right_len = _matrix(table.column("right"), wide)
        left, left_len = _matrix(table.column("left"), wide)
        low, high = repeated_windows(right, right_len, left, left_len, length, gram, step)
        hit = np.nonzero(high)[0]
        none = pa.nulls(len(hit), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ths[hit]), pa.array(pos[hit] + low[hit] - length),
                                          pa.array(pos[hit] + high[hit]), none, pa.nulls(len(hit), pa.binary())], names)
        windows: dict[bytes, list] = {}
        for i in np.nonzero(salt)[0].tolist():
            reach = int(left_len[i])
            whole = left[i, :reach][::-1].tobytes() + right[i, :right_len[i]].tobytes()
            for s in range(0, len(whole) - length + 1, step):
                digest = hashlib.blake2b(whole[s:s + length], digest_size=16).digest()
                seen = windows.get(digest)
                if seen is None:
                    windows[digest] = [1, int(ids[i]), int(ths[i]), int(pos[i]) - reach + s]
                else:
                    seen[0] += 1
        if windows:
            packed = np.empty(len(windows), _DIGEST)
            parts = np.frombuffer(b"".join(windows), "<i8").reshape(-1, 2)
            packed["w1"], packed["w2"] = parts[:, 0], parts[:, 1]
            for name, column in zip(("n", "id", "th", "lo"), zip(*windows.values())):
                packed[name] = column
            to = packed["w1"] % n
            packed = packed[np.argsort(to, kind="stable")]
            which, first = np.unique(np.sort(to), return_index=True)
            messages = [m.tobytes() for m in np.split(packed, first[1:])]
            none = pa.nulls(len(which), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(which.astype(np.int64)), pa.array(messages, pa.binary())], names)

    return (suffixes.repartitionByRange(n, "gram", "salt")
            .mapInArrow(frugal(run), "_id long, _th long, lo long, hi long, part long, digests binary"))


def _crossing(messages: DataFrame, length: int) -> DataFrame:
    """Spans of windows that occur once in their bucket and again in another one."""
    n = partitions(messages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [m for b in batches for m in b.column("digests").to_pylist()]
        if not held:
            return
        x = np.frombuffer(b"".join(held), _DIGEST)
        x = x[np.lexsort((x["w2"], x["w1"]))]
        new = np.append(True, (x["w1"][1:] != x["w1"][:-1]) | (x["w2"][1:] != x["w2"][:-1]))
        total = np.add.reduceat(x["n"].astype(np.int64), np.nonzero(new)[0])[np.cumsum(new) - 1]
        x = x[(total > 1) & (x["n"] == 1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (x["id"], x["th"], x["lo"], x["lo"] + length)],
                                         ["_id", "_th", "lo", "hi"])

    return messages.select("part", "digests").repartition(n, "part").mapInArrow(frugal(run), "_id long, _th long, lo long, hi long")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, by_word: bool = False) -> DataFrame:
    """_id, _th, spans: the (start, end) byte spans, unmerged but all, of each
    document with a repeated string. ``docs`` has _id, _th, raw. ``by_word``: in
    the texts as strings of word hashes."""
    every = materialize(_anchor_rows(docs, length, gram, by_word), "anchors")
    found = every.where("hash is not null")
    again = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    wanted = materialize(found.join(again, "hash").groupBy("_id", "_th").agg(
        F.collect_set(F.struct("pos", "lo", "hi", "n")).alias("found")), "suffix_places")
    compared = materialize(_compare(_suffixes(docs, wanted, length, gram, by_word), length, gram, _WORD if by_word else 1), "suffix_spans")
    crossing = _crossing(compared.where("part is not null"), length)
    spans = (compared.where("part is null").select("_id", "_th", "lo", "hi").unionByName(crossing)
             .unionByName(every.where("hash is null").select("_id", "_th", "lo", "hi")))
    return spans.groupBy("_id", "_th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def _keyed(docs: DataFrame, id_col: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(doc_key(id_col).alias("_id"), F.xxhash64(text).alias("_th"), F.encode(text, "UTF-8").alias("raw"))


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """_id, _th, n_removed, n_spans, kept (the remaining bytes) of documents with spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t, raw, found in zip(*(batch.column(c).to_pylist() for c in ("_id", "_th", "raw", "spans"))):
                runs = merged([(x["lo"], x["hi"]) for x in found])
                ends = [0, *(b for _, b in runs)]
                kept = b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in runs), len(raw)]))
                out.append((i, t, len(raw) - len(kept), len(runs), kept))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 ["_id", "_th", "n_removed", "n_spans", "kept"])

    return (only_keys(docs, spans, ["_id", "_th"]).join(spans, ["_id", "_th"])
            .mapInArrow(frugal(run), "_id long, _th long, n_removed long, n_spans long, kept binary"))


def passages(docs: DataFrame, least: int = PASSAGE, gram: int = PASSAGE_GRAM) -> DataFrame:
    """_id, _th, passages: the (start, end) word spans of each document in which
    every word is part of ``least`` words that occur elsewhere too (same
    document included). ``docs`` has _id, _th, raw; repeated rows give one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for i, t, found in zip(*(batch.column(c).to_pylist() for c in ("_id", "_th", "spans"))):
                runs = merged([(x["lo"], x["hi"]) for x in found])
                out.append((i, t, [{"start": a // _WORD, "end": b // _WORD} for a, b in runs]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), kind))],
                                                 ["_id", "_th", "passages"])

    spans = repeated_spans(docs, least * _WORD, gram, True)
    return spans.mapInArrow(run, "_id long, _th long, passages array<struct<start:long,end:long>>")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", passage: int = PASSAGE,
                   passage_gram: int = PASSAGE_GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the removal of repeated
    strings, and n_passage_words, n_passages: the words in, and the number
    of, the passages of ``passage`` words that repeat (they are only reported:
    the removal goes by bytes)."""
    keyed = _keyed(small_batches(docs), id_col)
    spans = materialize(repeated_spans(keyed, length, gram), "repeats")
    changed = (cut(keyed, spans).select("_id", "_th", "n_removed", "n_spans", F.sha2("kept", 256).alias("_sha"))
               .dropDuplicates(["_id", "_th"]))
    found = passages(keyed, passage, passage_gram).select(
        "_id", "_th", F.aggregate("passages", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_passage_words"),
        F.size("passages").cast("long").alias("n_passages"))
    both = changed.join(found, ["_id", "_th"], "full")
    whole = keyed.select("_id", "_th", F.octet_length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("_whole"))
    number = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans", "n_passage_words", "n_passages")}
    return whole.join(both, ["_id", "_th"], "left").select(
        back_to_id("_id").alias("doc_id"), "n_bytes", number["n_removed"], number["n_spans"],
        F.coalesce("_sha", "_whole").alias("kept_sha256"), number["n_passage_words"], number["n_passages"])
