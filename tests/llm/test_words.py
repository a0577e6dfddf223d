import re

import numpy as np
import pyarrow as pa

from skein.llm import words as W

TEXTS = ["", "one two  one", " \x0b lead and tail \n", "é😀 Naïve É a\x00b\xa0c \x7f d", "x" * 3_000_000 + " y", "word " * 500_000, "end", "", "Ends here", "next"]


def arrays(texts):
    raws = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])


def check(pattern, lower, **kw):
    raw, at = arrays(TEXTS)
    start, size, h, first = W.words(raw, at, **kw)
    known = {}
    for k, t in enumerate(TEXTS):
        want = re.findall(pattern, t)
        if lower:
            want = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in want]
        got = range(first[k], first[k + 1])
        assert len(got) == len(want)
        for i, w in zip(got, want):
            assert known.setdefault(w, h[i]) == h[i] and size[i] == len(w.encode())
    assert len(set(known.values())) == len(known)


def test_words_of_each_text():
    check(r"[^\x20\x09-\x0D]+", False)
    check(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", True, solid=W.TERM, value=W.FOLDED)


def test_groups_keep_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array([t.encode() for t in TEXTS])], ["i", "raw"])
    seen = []
    for part, raw, at in W.groups([batch.slice(0, 0), batch, batch.slice(3, 2)], "raw"):
        seen += [(i, raw[a:b].tobytes()) for i, a, b in zip(part.column("i").to_pylist(), at[:-1], at[1:])]
    assert seen == [(i, TEXTS[i].encode()) for i in [*range(len(TEXTS)), 3, 4]]
    assert W.counts(np.array([True, False, True, True]), np.array([0, 0, 1, 4])).tolist() == [0, 1, 2]
