"""Quality rules of whole texts, repetition by a suffix array of the words.

Words are runs of anything but blanks, case-sensitive. For each text the
suffixes that share their first ``BLOCK`` words with another one are sorted by
prefix doubling (blocks of 5, 10, 20, ... words; an alphabet of word hashes
gives the order), and the longest common prefixes of neighbours are read off
the ranks of the doubling rounds. Intervals of the common prefixes are the
right-maximal repeats; those whose occurrences have different words before
them (or the start of the text) are the maximal repeated substrings. Their
spans are united: at each suffix only its deepest interval counts, as all
others that hold it begin there too and end earlier, or begin earlier at a
suffix of their own. Repeats of ``MIN_REPEAT`` words and more count.

A text fails when it has fewer than ``MIN_WORDS`` words, when over
``MAX_REPEAT_PERCENT`` of its words lie in windows of five words found twice
or more, when maximal repeats cover more than ``MAX_COVERED_PERCENT`` of its
words, or when the longest one has more than ``MAX_LONGEST`` words.

A text depends on nothing but itself, so nothing is shuffled; texts are worked
on about a MB at a time (a longer one alone, whole: about 60 bytes a word, and
4 more for each doubling round that still has ties). Words, windows and lines
are compared as 64-bit hashes.

Edge cases: a null text has no words and fails; each row gives a row, null and
repeated ids included; an empty table gives an empty result; further input
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.batches import small_batches
from skein.llm.shingles import mix
from skein.llm.words import BEGINS, SOLID, byte_class, counts, groups, words

BLOCK = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_REPEAT = 8
MAX_COVERED_PERCENT = 15
MAX_LONGEST = 100
_SYMBOL = byte_class("#*$%&|<>")
_LINE = np.ones(256, bool)
_LINE[10] = False
_TURN = mix(np.arange(1, BLOCK + 1, dtype=np.uint64)) | np.uint64(1)
_SALT = np.uint64(0xD6E8FEB86659FD93)


def repeated_blocks(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each position whether its BLOCK words occur again in its text."""
    n = len(hashes)
    flags = np.zeros(n, bool)
    if n >= BLOCK:
        text = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
        key = text[:n - BLOCK + 1] * _SALT
        for k in range(BLOCK):
            key += hashes[k:n - BLOCK + 1 + k] * _TURN[k]
        at = np.flatnonzero(text[:n - BLOCK + 1] == text[BLOCK - 1:])
        key = mix(key[at])
        order = np.argsort(key, kind="stable")
        equal = key[order][1:] == key[order][:-1]
        flags[at[order[1:][equal]]] = True
        flags[at[order[:-1][equal]]] = True
    return flags


def _block_ranks(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of the BLOCK words from each position in the order of words
    (a text that ends comes first; texts do not mix), and the positions, by
    rank, whose block occurs again in their text."""
    n = len(hashes)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    left = first[1:][text] - np.arange(n)
    keys = [mix(hashes + text.astype(np.uint64) * _SALT)]
    for k in range(1, BLOCK):
        keys.append(np.where(left > k, np.append(hashes[k:], np.zeros(min(k, n), np.uint64)), np.uint64(0)))
    order = np.lexsort(keys[::-1])
    new = np.ones(n, bool)
    for k in range(n and BLOCK):
        ordered = keys[k][order]
        new[1:] &= ordered[1:] == ordered[:-1]
    new[1:] = ~new[1:]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, size)
    return rank, order[np.repeat(size > 1, size)]


def suffix_order(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions whose BLOCK words occur again in their text, in the order
    of their suffixes, and each one's common prefix (words) with the one before
    it; prefixes below BLOCK are 0."""
    rank, order = _block_ranks(hashes, first)
    size = len(order)
    common = np.zeros(size, np.int64)
    if not size:
        return order, common
    stop = first[np.searchsorted(first, np.arange(len(hashes)), "right")]
    levels = [rank]
    place = np.arange(size)  # places still tied with a neighbour
    h = BLOCK
    while len(place):
        at = order[place]
        own = levels[-1][at]
        after = np.where(at + h < stop[at], levels[-1][np.minimum(at + h, len(hashes) - 1)], -1)  # a text that ends comes first
        by = np.lexsort((after, own))
        at, own, after = at[by], own[by], after[by]
        order[place] = at
        new = np.append(True, own[1:] != own[:-1])
        split = ~new
        split[1:] &= after[1:] != after[:-1]
        common[place[split]] = -h  # at least h, less than 2 h: measured below
        start = new | split
        head = np.flatnonzero(start)
        count = np.diff(np.append(head, len(at)))
        group = np.flatnonzero(new)
        offset = np.arange(len(at)) - np.repeat(group, np.diff(np.append(group, len(at))))
        refined = levels[-1].copy()
        refined[at] = own + np.repeat(offset[head], count)
        levels.append(refined)
        place = place[np.repeat(count > 1, count)]
        h *= 2
    for k in range(len(levels) - 1):  # pairs that were told apart in round k
        step = BLOCK << k
        pair = np.flatnonzero(common == -step)
        x, y = order[pair - 1], order[pair]
        length = np.full(len(pair), step)
        for lower in range(k - 1, -1, -1):
            length += np.where(_same(levels[lower], x + length, y + length), BLOCK << lower, 0)
        text_end = stop[x]
        more = np.ones(len(pair), bool)
        for _ in range(BLOCK - 1):
            more &= (np.maximum(x, y) + length < text_end) & _same(hashes, x + length, y + length)
            length += more
        common[pair] = length
    return order, common


def _same(values: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    inside = np.maximum(x, y) < len(values)
    return inside & (values[np.minimum(x, len(values) - 1)] == values[np.minimum(y, len(values) - 1)])


def prefix_intervals(common: np.ndarray, least: int) -> np.ndarray:
    """Rows (length, from, to) of the intervals of places whose suffixes share
    ``length`` >= ``least`` words, and no more all together."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # (length, first place)
    for i, length in enumerate([*common.tolist(), 0]):
        start = i - 1
        while stack and stack[-1][0] > length:
            value, start = stack.pop()
            out.append((value, start, i - 1))
        if length >= least and (not stack or stack[-1][0] < length):
            stack.append((length, start))
    return np.array(out, np.int64).reshape(-1, 3)


def maximal_repeats(hashes: np.ndarray, first: np.ndarray, least: int = MIN_REPEAT, again: np.ndarray | None = None):
    """text, length (words) and number of occurrences of each maximal repeated
    substring of at least ``least`` words, and for each word whether one of
    them covers it. Only texts in which ``least`` words in a row can be a
    repeat (all their blocks occur again: ``repeated_blocks``) are sorted."""
    again = repeated_blocks(hashes, first) if again is None else again
    held = np.append(0, np.cumsum(again))
    reach = least - BLOCK + 1
    full = held[reach:] - held[:-reach] == reach if len(hashes) >= reach else np.zeros(0, bool)
    texts = np.unique(np.searchsorted(first, np.flatnonzero(full), "right") - 1)
    covered = np.zeros(len(hashes), bool)
    none = np.zeros(0, np.int64)
    if not len(texts):
        return none, none, none, covered
    inside = np.concatenate([np.arange(first[t], first[t + 1]) for t in texts.tolist()])
    text, length, times, own = _maximal(hashes[inside], np.append(0, np.cumsum(first[texts + 1] - first[texts])), least)
    covered[inside] = own
    return texts[text], length, times, covered


def _maximal(hashes: np.ndarray, first: np.ndarray, least: int):
    order, common = suffix_order(hashes, first)
    covered = np.zeros(len(hashes) + 1, np.int64)
    if not len(order):
        none = np.zeros(0, np.int64)
        return none, none, none, covered[:-1] > 0
    deepest = np.maximum(common, np.append(common[1:], 0))
    deepest[deepest < least] = 0
    np.add.at(covered, order, deepest > 0)
    np.add.at(covered, order + deepest, -(deepest > 0).astype(np.int64))
    near = np.flatnonzero(deepest)  # only these can be in an interval
    breaks = common[near].copy()
    breaks[breaks < least] = 0
    found = prefix_intervals(breaks, least)
    at = order[near]
    text = np.searchsorted(first, at, "right") - 1
    before = np.where(at > first[text], hashes[np.maximum(at - 1, 0)], np.uint64(0))
    lone = at == first[text]  # nothing stands before it: it differs from all others
    differ = np.append(0, np.cumsum((before[1:] != before[:-1]) | lone[1:] | lone[:-1]))
    diverse = differ[found[:, 2]] > differ[found[:, 1]]
    found = found[diverse]
    return text[found[:, 1]], found[:, 0], found[:, 2] - found[:, 1] + 1, np.cumsum(covered)[:-1] > 0


def _runs(flags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each run of flagged words, cut at texts' ends."""
    pos = np.flatnonzero(flags)
    if not len(pos):
        return pos, pos
    begins = np.zeros(len(flags) + 1, bool)
    begins[first] = True
    new = np.append(True, (pos[1:] != pos[:-1] + 1) | begins[pos[1:]])
    head = np.flatnonzero(new)
    return pos[head], pos[np.append(head[1:], len(pos)) - 1]


_SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, "
           "longest_repeat long, n_repeats long, spans array<struct<start:long,end:long>>")


def measure(raw: np.ndarray, at: np.ndarray, least: int = MIN_REPEAT) -> list:
    """The columns of ``_SCHEMA`` for the texts raw[at[i]:at[i + 1]]; spans are bytes."""
    start, size, hashes, first = words(raw, at)
    n_texts = len(at) - 1
    solid = SOLID[raw]
    again = repeated_blocks(hashes, first)
    inside = np.convolve(again, np.ones(BLOCK, np.int64))[:len(hashes)] > 0 if len(hashes) else again
    line_at, line_size, line_hash, line_first = words(raw, at, _LINE)
    filled = np.append(0, np.cumsum(solid))
    with_word = filled[line_at + line_size] > filled[line_at]
    line_text = np.repeat(np.arange(n_texts), np.diff(line_first))[with_word]
    line_key = line_hash[with_word] + line_text.astype(np.uint64) * _SALT
    _, earliest = np.unique(line_key, return_index=True)
    dup = np.bincount(line_text, minlength=n_texts) - np.bincount(line_text[earliest], minlength=n_texts)
    text, length, _, covered = maximal_repeats(hashes, first, least, again)
    longest = np.zeros(n_texts, np.int64)
    np.maximum.at(longest, text, length)
    begin, end = _runs(covered, first)
    origin = at[np.searchsorted(first, begin, "right") - 1]
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(begin, first), pa.int32()),
        pa.StructArray.from_arrays([pa.array(start[begin] - origin, pa.int64()), pa.array(start[end] + size[end] - origin, pa.int64())],
                                   ["start", "end"]))
    numbers = [np.diff(first), counts(solid & BEGINS[raw], at), counts(_SYMBOL[raw], at), dup, counts(inside, first),
               counts(covered, first), longest, np.bincount(text, minlength=n_texts)]
    return [*(pa.array(x, pa.int64()) for x in numbers), spans]


def repetition(docs: DataFrame, least: int = MIN_REPEAT, id_col: str = "doc_id") -> DataFrame:
    """doc_id and the measures of each text: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, covered_words, longest_repeat, n_repeats and
    the united spans (bytes) of its maximal repeats."""

    def run(batches):
        for batch, raw, at in groups(batches, "raw"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *measure(raw, at, least)],
                                             ["doc_id", *(c.split()[0] for c in _SCHEMA.split(", "))])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("raw"))
    return small_batches(rows).mapInArrow(run, f"doc_id long, {_SCHEMA}")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def repetitive(covered_percent: int = MAX_COVERED_PERCENT, longest: int = MAX_LONGEST) -> Column:
    return (100 * F.col("covered_words") > covered_percent * F.col("n_words")) | (F.col("longest_repeat") > longest)


def quality(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The measures of every text with base_failed and kept."""
    rows = repetition(docs, MIN_REPEAT, id_col)
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~repetitive())
