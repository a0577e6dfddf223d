import random
import re
from collections import Counter

import numpy as np
import pytest

from skein.llm import repetition as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(ws, least):
    """Maximal repeated word strings by definition: string -> occurrences."""
    out = {}
    for n in range(least, len(ws)):
        places = {}
        for i in range(len(ws) - n + 1):
            places.setdefault(tuple(ws[i:i + n]), []).append(i)
        for s, at in places.items():
            if len(at) > 1:
                left = [ws[i - 1] if i else None for i in at]
                right = [ws[i + n] if i + n < len(ws) else None for i in at]
                if (len(set(left)) > 1 or None in left) and (len(set(right)) > 1 or None in right):
                    out[s] = at
    return out


def plain(text, least=R.MIN_REPEAT):
    text = text or ""
    ws = WORD.findall(text)
    windows = Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
    twice = {i + j for i in range(len(ws) - 4) if windows[tuple(ws[i:i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    found = repeats(ws, least)
    covered = {i + j for s, at in found.items() for i in at for j in range(len(s))}
    return [len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice),
            len(covered), max(map(len, found), default=0), len(found)]


def texts():
    rnd = random.Random(3)
    out = [None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "x " * 60, "\n".join(["same line here"] * 9 + ["", " ", "same line here "]),
           "É😀 # * $ % & | < > naïve\x00 \xa0 w", "a\x0bb\x0cc\r\nd", "A a " * 30]
    for k in range(60):
        size, letters = rnd.randint(5, 90), rnd.randint(1, 12)
        ws = [rnd.choice("abcdefghijkl"[:letters]) for _ in range(size)]
        i, n = rnd.randrange(size), rnd.randint(1, 40)
        ws[rnd.randrange(size):0] = ws[i:i + n] * rnd.randint(0, 3)
        out.append(rnd.choice([" ", "\n", "  "]).join(ws))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, kept string, n_words int, start int")


@pytest.mark.parametrize("least", [5, 8])
def test_measures_by_definition(spark, least):
    given = texts()
    got = {r[0]: r for r in R.repetition(frame(spark, list(enumerate(given))), least).collect()}
    assert len(got) == len(given)
    for i, t in enumerate(given):
        assert list(got[i])[1:9] == plain(t, least), t
        raw, ws = (t or "").encode(), WORD.findall(t or "")
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        inside = sum(any(s["start"] <= a and b <= s["end"] for s in got[i]["spans"]) for a, b in at)
        assert inside == got[i]["covered_words"] and len(at) == len(ws)


def test_suffixes_are_in_one_order():
    """Neighbours share what is stated, and no other suffix shares more."""
    rnd = random.Random(5)
    for _ in range(30):
        n = rnd.randint(6, 120)
        hashes = np.array([rnd.randrange(1, 4) for _ in range(n)], np.uint64)  # 0 stands for a text that ends
        first = np.array(sorted({0, rnd.randrange(n + 1), n}))
        order, common = R.suffix_order(hashes, first)

        def lcp(x, y):
            end, k = first[np.searchsorted(first, [x, y], "right")], 0
            while end[0] == end[1] and max(x, y) + k < end[0] and hashes[x + k] == hashes[y + k]:
                k += 1
            return k

        for k in range(1, len(order)):
            real = lcp(order[k - 1], order[k])
            assert common[k] == (real if real >= 5 else 0)
        for k, x in enumerate(order):
            best = max(lcp(x, y) for y in range(n) if y != x)
            assert best == max(common[k], common[k + 1] if k + 1 < len(order) else 0) and best >= 5


def test_long_texts_and_odd_rows(spark):
    rnd = random.Random(1)
    block = " ".join(str(rnd.random()) for _ in range(30000))
    filler = " ".join(str(i) for i in range(100000))
    rows = [(1, block + " | " + block), (None, "one two"), (1, filler), (2, "w " * 300000), (3, "no-blank" * 300000)]
    got = R.quality(frame(spark, rows)).collect()
    assert sorted((r["n_words"], r["longest_repeat"], r["covered_words"], r["kept"]) for r in got) == [
        (1, 0, 0, False), (2, 0, 0, False), (60001, 30000, 60000, False), (100000, 0, 0, True), (300000, 299999, 300000, False)]
    assert R.quality(frame(spark, [])).count() == 0


def test_verdict_limits(spark):
    def text(repeated, times, other):
        parts = [f"r{i}" for i in range(repeated)]
        ws = []
        for k in range(times):
            ws += parts + [f"sep{k}"]
        return " ".join(ws + [f"o{i}" for i in range(other)])

    rows = [(0, text(8, 2, 200)), (1, text(101, 2, 2000)), (2, text(100, 2, 2000)), (3, text(7, 12, 500)), (4, text(16, 2, 180)),
            (5, text(17, 2, 180)), (6, " ".join("abcdefghi")), (7, " ".join("abcdefghij"))]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in R.quality(frame(spark, rows)).collect()}
    assert got == {0: (False, True), 1: (False, False), 2: (False, True), 3: (False, True), 4: (False, True), 5: (False, False),
                   6: (True, False), 7: (False, True)}
