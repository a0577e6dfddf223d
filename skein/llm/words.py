"""Words of many texts at a time as 64-bit hashes, in NumPy.

Texts come as one byte array (UTF-8) with the offsets of the texts in it. A
word is a run of bytes of a class; it never crosses from one text to the next.
Long arrays are worked on in segments cut where no word is, so that besides
the result (24 bytes a word) only a few MB are held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from skein.llm.common import binary_parts
from skein.llm.shingles import mix

_SEGMENT = 1 << 20
_GROUP = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP) | np.uint64(1)

#: runs of anything but space and the characters 9 to 13, as they are
SOLID = np.ones(256, bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False
#: runs of ASCII letters and digits and of any character beyond ASCII, A-Z lower-cased
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True
FOLDED = _BYTE.copy()
FOLDED[65:91] = _BYTE[97:123]


def words(raw: np.ndarray, at: np.ndarray, solid: np.ndarray = SOLID, value: np.ndarray = _BYTE):
    """start, size (bytes), hash of each word of the texts raw[at[i]:at[i + 1]],
    and the index of the first word of each text (and the end)."""
    starts, sizes, hashes = [], [], []
    begin = 0
    while begin < len(raw):
        end = min(begin + _SEGMENT, len(raw))
        while end < len(raw) and solid[raw[end]]:  # cut before a blank; a word of any length stays whole
            gaps = np.flatnonzero(~solid[raw[end:end + _SEGMENT]])
            end = min(end + (int(gaps[0]) if len(gaps) else _SEGMENT), len(raw))
        part = raw[begin:end]
        pos = np.flatnonzero(solid[part])
        if len(pos):
            first = np.empty(len(pos), bool)
            first[0] = True
            np.not_equal(pos[1:], pos[:-1] + 1, out=first[1:])
            cuts = at[np.searchsorted(at, begin):np.searchsorted(at, end)] - begin
            hit = np.searchsorted(pos, cuts)
            ok = hit < len(pos)
            first[hit[ok][pos[hit[ok]] == cuts[ok]]] = True
            head = np.flatnonzero(first)
            size = np.diff(np.append(head, len(pos)))
            place = np.arange(len(pos)) - np.repeat(head, size)
            weight = mix(np.arange(1000, 1001 + int(size.max()), dtype=np.uint64) * _STEP) | np.uint64(1)
            h = np.add.reduceat(value[part[pos]] * weight[place], head)
            starts.append(pos[head] + begin)
            sizes.append(size)
            hashes.append(mix(h + size.astype(np.uint64)))
        begin = end
    none = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else none
    return (start, np.concatenate(sizes) if sizes else none, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64),
            np.searchsorted(start, at))


def groups(batches, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches whose binary ``column`` holds about a MB (or one
    longer text), with its bytes and offsets; empty batches are left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, at = binary_parts(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + _GROUP, "right")) - 1)
            yield batch.slice(first, last - first), raw[at[first]:at[last]], at[first:last + 1] - at[first]
            first = last


def counts(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    return np.diff(np.searchsorted(np.flatnonzero(flags), at))


def byte_class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


#: bytes that begin a code point
BEGINS = (np.arange(256) & 0xC0) != 0x80
