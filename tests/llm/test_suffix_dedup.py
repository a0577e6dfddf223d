import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from skein.llm import suffix_dedup as sd


def plain(rows, length):
    """By the definition: bytes under a string that starts more than once."""
    count = {}
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        for s in range(len(raw) - length + 1):
            count[raw[s:s + length]] = count.get(raw[s:s + length], 0) + 1
    out = []
    for (i, _), raw in zip(rows, raws):
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if count[raw[s:s + length]] > 1:
                gone[s:s + length] = b"\x01" * length
        runs = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i is None, i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(spark, rows, length=400, gram=64):
    df = spark.createDataFrame([(i, t, 0, "h") for i, t in rows], "doc_id long, text string, lo long, hash string")
    got = sd.remove_repeats(df, length, gram).collect()
    assert sorted((r["doc_id"] is None, *r[:5]) for r in got) == plain(rows, length)


def plain_passages(rows, least):
    """Words under ``least`` words that start more than once, and their runs."""
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(ws[i:i + least]) for ws in texts for i in range(len(ws) - least + 1))
    out = []
    for (i, _), ws in zip(rows, texts):
        hit = [False] * len(ws)
        for k in range(len(ws) - least + 1):
            if count[tuple(ws[k:k + least])] > 1:
                hit[k:k + least] = [True] * least
        out.append((i is None, i, sum(hit), sum(h and not (k and hit[k - 1]) for k, h in enumerate(hit))))
    return sorted(out)


@pytest.mark.parametrize("least,gram", [(51, 32), (20, 16)])
def test_passages_of_short_words(spark, least, gram):
    rnd = random.Random(4)

    def text(n):
        return [rnd.choice("abcdefgh") + rnd.choice("xyz") * rnd.randint(0, 4) + str(rnd.randint(0, 40)) for _ in range(n)]

    shared = [text(n) for n in (least - 1, least, least + 1, 90)]
    rows = [(i, " ".join(text(rnd.randint(0, 60)) + shared[i % 4] + text(rnd.randint(0, 60)))) for i in range(40)]
    rows += [(100, "\n".join(shared[3])), (101, " \x0b".join(text(30) + shared[1] + text(5) + shared[1])), (102, "w " * 300), (103, None), (104, ""),
             (None, " ".join(shared[2])), (105, " ".join(shared[3] + shared[2])), (105, " ".join(shared[3] + shared[2])), (106, " ".join(text(4000)))]
    df = spark.createDataFrame([(i, t, 0, "h") for i, t in rows], "doc_id long, text string, lo long, passages string")
    got = sd.remove_repeats(df, passage=least, passage_gram=gram).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_passage_words"], r["n_passages"]) for r in got) == plain_passages(rows, least)


def test_multikey_sort():
    rnd = np.random.default_rng(1)
    rows = rnd.integers(0, 3, (200, 24), dtype=np.uint8)
    rows[50:80, :20] = rows[0, :20]
    rows[90] = rows[91]
    order, common = sd.multikey_sort(rows)
    strings = [rows[i].tobytes() for i in order]
    assert strings == sorted(r.tobytes() for r in rows)
    for k in range(1, len(strings)):
        a, b = strings[k - 1], strings[k]
        assert common[k] == next((i for i in range(24) if a[i] != b[i]), 24)


def test_anchors_own_each_window_once(monkeypatch):
    monkeypatch.setattr(sd, "_SEGMENT", 70)
    raw = np.random.default_rng(2).integers(97, 100, 600, dtype=np.uint8)
    raw[200:330] = 97
    h, pos, lo, hi = sd.anchors(raw, 40, 8)
    owned = [p for a, b in zip(lo, hi) for p in range(a, b + 1)]
    assert owned == list(range(600 - 40 + 1))
    grams = sd.gram_hashes(raw, 8)
    assert all(p >= b and p + 8 <= a + 40 and grams[p] == x.view(np.uint64) for x, p, a, b in zip(h, pos, lo, hi))


@pytest.fixture(scope="module")
def corpus(words):
    rnd = random.Random(21)
    passage = [" ".join(rnd.choices(words, k=k)) for k in (90, 60, 200)]
    rows = []
    for i in range(120):
        parts = [" ".join(rnd.choices(words, k=rnd.choice([1, 20, 150]))) for _ in range(rnd.randint(1, 3))]
        if i % 3 == 0:
            parts.insert(rnd.randrange(len(parts) + 1), rnd.choice(passage))
        rows.append((i, rnd.choice([" ", "é "]).join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(0, 30, 3)]                      # copies
    rows += [(300 + i, rows[5][1][: 40 + 30 * i] + "X" + rows[5][1][40 + 30 * i:]) for i in range(12)]  # near copies
    return rows


def test_removal(spark, corpus):
    check(spark, corpus)


def test_many_buckets_and_short_strings(spark, corpus, monkeypatch):
    check(spark, corpus[:60], 48, 8)
    monkeypatch.setattr(sd, "HEAVY", 3)  # salted strings: compared across buckets
    check(spark, corpus, 48, 8)
    hot = [(i, f"{i} " * 30 + "the very same long line of text " * 2 + f" {i * 7}" * 20) for i in range(150)]
    check(spark, hot, 48, 8)


def test_odd_rows(spark, corpus):
    text = corpus[0][1] + corpus[1][1]
    check(spark, [(1, None), (2, ""), (None, text), (4, text), (4, text), (4, "short"), (5, "For " * 800), (6, "For " * 100),
                  (7, "a" * 399), (8, "b" * 400), (9, "c" * 401), (10, "0" * 300), (11, "é" * 700 + "x"), (12, "\x00" * 900 + "y")])
    check(spark, [])
