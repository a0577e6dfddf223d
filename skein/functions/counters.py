"""Token counters with counts that can be put together from parts.

A counter counts the tokens of whole texts. What it must promise is one cut
rule: a text may be cut before white space that follows something else, and
the counts of both sides add up. That holds for any pattern whose tokens hold no
white space and for vocabularies that split words before they merge.

The count of a text is then kept as a *summary*: the open left end (up to the
first cut), the number of tokens between the first and the last cut, and the
open right end. Summaries of neighbouring parts merge without the texts: only
the two open ends that meet are counted anew, so tokens that cross the seam
are right. ``inner`` is null (None) while a text has no cut; it is all ``left``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import lru_cache

import pyarrow as pa

from skein.functions.text import TOKEN_PATTERN, WS

_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])")

Summary = tuple[str, "int | None", str]
EMPTY: Summary = ("", None, "")
SUMMARY_TYPE = "struct<left:string,inner:bigint,right:string>"
SUMMARY_ARROW = pa.struct([("left", pa.string()), ("inner", pa.int64()), ("right", pa.string())])


class Counter:
    """Counts tokens of texts; equal counters may share their results."""

    def count(self, texts: Sequence[str]) -> list[int]:
        raise NotImplementedError


class PatternCounter(Counter):
    """The matches of a pattern that holds no white space and looks at nothing outside of a match."""

    def __init__(self, pattern: str = TOKEN_PATTERN):
        self.pattern = pattern

    def __eq__(self, other) -> bool:
        return isinstance(other, PatternCounter) and other.pattern == self.pattern

    def __hash__(self) -> int:
        return hash(self.pattern)

    def count(self, texts: Sequence[str]) -> list[int]:
        found = re.compile(self.pattern).findall
        return [len(found(t)) for t in texts]


#: runs of anything but white space: tokens do cross the quotes and commas of a document
RUN_PATTERN = f"[^{WS}]+"


@lru_cache(maxsize=8)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings are ordinary text in a message
    t.no_padding()
    t.no_truncation()
    return t


class VocabularyCounter(Counter):
    """A tokenizer file (JSON of the ``tokenizers`` library) that all executors
    can read under ``path``; it is loaded once in each worker."""

    def __init__(self, path: str):
        self.path = path

    def __eq__(self, other) -> bool:
        return isinstance(other, VocabularyCounter) and other.path == self.path

    def __hash__(self) -> int:
        return hash(self.path)

    def count(self, texts: Sequence[str]) -> list[int]:
        return [len(e.ids) for e in _tokenizer(self.path).encode_batch(list(texts), add_special_tokens=False)]


def ends(text: str) -> tuple[str, str | None, str]:
    """Left end, the text between the first and last cut (None without one), right end."""
    first = _CUT.search(text)
    if first is None:
        return text, None, ""
    a = first.start()
    # the last cut: the start of the last run of white space that something else precedes
    b = max(m.start() for m in _CUT.finditer(text, a))
    return text[:a], text[a:b], text[b:]


def summaries(texts: Sequence[str], counter: Counter) -> list[Summary]:
    parts = [ends(t) for t in texts]
    counts = iter(counter.count([p[1] for p in parts if p[1]]))
    return [(left, None if middle is None else next(counts) if middle else 0, right) for left, middle, right in parts]


def merge(a: Summary, b: Summary, counter: Counter) -> Summary:
    """The summary of the text of ``a`` followed by that of ``b``."""
    if b[1] is None:
        return (a[0] + b[0], None, "") if a[1] is None else (a[0], a[1], a[2] + b[0])
    if a[1] is None:
        return a[0] + b[0], b[1], b[2]
    return a[0], a[1] + counter.count([a[2] + b[0]])[0] + b[1], b[2]


def seams(parts: Iterable[Summary]) -> tuple[int, list[str]]:
    """The tokens within the parts of a text, and the pieces around their seams
    that are still to be counted."""
    inner, open_, pieces = 0, [], []
    for left, n, right in parts:
        open_.append(left)
        if n is not None:
            pieces.append("".join(open_))
            inner += n
            open_ = [right]
    pieces.append("".join(open_))
    return inner, [p for p in pieces if p]


def totals(texts: Sequence[Iterable[Summary]], counter: Counter) -> list[int]:
    """The count of each text from its parts; equal pieces are counted once."""
    found = [seams(parts) for parts in texts]
    distinct = list({p for _, pieces in found for p in pieces})
    known = dict(zip(distinct, counter.count(distinct)))
    return [inner + sum(known[p] for p in pieces) for inner, pieces in found]
