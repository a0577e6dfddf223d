"""Word-shingle sets as sorted 64-bit hashes, many texts at a time in NumPy.

Words are runs of anything but blanks (space and the characters 9 to 13),
A-Z lower-cased. A shingle is five words in a row; a shorter text is one
shingle as a whole; a text without words has none. All arithmetic is modulo
2**64 with fixed odd multipliers, so hashes agree between tasks and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, shift, multiply, shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _series(start: int, n: int) -> np.ndarray:
    return mix(np.arange(start, start + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


_BYTE = _series(1, 256) | np.uint64(1)
for _b in range(65, 91):
    _BYTE[_b] = _BYTE[_b + 32]
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_PLACE = _series(1000, 4096) | np.uint64(1)
_TURN = _series(500, WORDS) | np.uint64(1)
_SHORT = _series(700, WORDS)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = _series(1000, max(n, 2 * len(_PLACE))) | np.uint64(1)
    return _PLACE


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a byte array."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~_BLANK[raw]
    at = np.nonzero(solid)[0]
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.empty(len(at), bool)
    first[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=first[1:])
    starts = np.nonzero(first)[0]
    sizes = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, sizes)
    h = _BYTE[raw[at]] * _places(int(sizes.max()))[place]
    return mix(np.add.reduceat(h, starts) + sizes.astype(np.uint64)), at[starts]


def _windows(words: np.ndarray) -> np.ndarray:
    """Hash of the five words from each position (no text ends considered)."""
    n = len(words) - WORDS + 1
    h = words[:n] * _TURN[0]
    for k in range(1, WORDS):
        h += words[k:k + n] * _TURN[k]
    return mix(h)


def _one(words: np.ndarray) -> np.ndarray:
    if not len(words):
        return words
    if len(words) < WORDS:
        return mix((words * _TURN[:len(words)]).sum(keepdims=True) + _SHORT[len(words)])
    return _windows(words)


def _long_words(raw: np.ndarray) -> np.ndarray:
    """Word hashes of a long text, a chunk at a time, cut at blanks."""
    out, start = [], 0
    while start < len(raw):
        end = min(start + _CHUNK, len(raw))
        while end < len(raw):
            blanks = np.nonzero(_BLANK[raw[start:end]])[0]
            if len(blanks):
                end = start + int(blanks[-1]) + 1
                break
            end = min(end + _CHUNK, len(raw))
        out.append(word_hashes(raw[start:end])[0])
        start = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    group: list[bytes] = []
    size = 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        if len(raw) >= _CHUNK:
            if group:
                yield from _group(group)
                group, size = [], 0
            yield np.unique(_one(_long_words(np.frombuffer(raw, np.uint8))))
            continue
        group.append(raw)
        size += len(raw)
        if size >= _CHUNK:
            yield from _group(group)
            group, size = [], 0
    if group:
        yield from _group(group)


def _group(texts: list[bytes]) -> Iterator[np.ndarray]:
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    words, at = word_hashes(raw)
    ends = np.cumsum([len(t) + 1 for t in texts])
    stop = np.searchsorted(at, ends)
    every = _windows(words) if len(words) >= WORDS else words[:0]
    start = 0
    for end in stop.tolist():
        yield np.unique(every[start:end - WORDS + 1] if end - start >= WORDS else _one(words[start:end]))
        start = end
