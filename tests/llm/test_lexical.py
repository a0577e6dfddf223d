import math
import random
import re
from collections import Counter

import numpy as np

from skein.llm import lexical
from skein.llm.words import FOLDED, TERM, words

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    """item -> [(doc_id, score)] by scoring every document (ids None last)."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = {}
    for item, text in items.items():
        found = []
        for i, b in bags:
            if b:
                m = 25 + 75 * sum(b.values()) * n_docs // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 8 * m))
                        for t in terms(text) if t in b)
                if s > 0:
                    found.append((i, s))
        found.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        if found:
            out[item] = found[:k]
    return out


def run(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, "x", 1, b"") for i, t in docs], "doc_id long, text string, item string, score int, raw binary")
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    out = {}
    for r in lexical.search(d, q, k).collect():
        out.setdefault(r["item_id"], {})[r["rank"]] = (r["doc_id"], r["score"])
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in out.values())
    return {i: [x[n] for n in sorted(x)] for i, x in out.items()}


def corpus(seed, n, vocabulary=300):
    rnd = random.Random(seed)
    voc = ["".join(rnd.choice("abcdeé日😀") for _ in range(rnd.randint(1, 6))) for _ in range(vocabulary)]
    def text(size):
        return " ".join(rnd.choice(voc[:max(2, int(len(voc) * rnd.random() ** 2))]) for _ in range(size))
    return rnd, voc, [(i, text(rnd.choice([1, 5, 40, 200]))) for i in range(n)]


def test_equals_scoring_every_document(spark):
    rnd, voc, docs = corpus(1, 400)
    docs += [(1000 + i, docs[7][1]) for i in range(60)]  # many copies: ties go to the smaller id
    docs += [(500, None), (501, ""), (502, " .,- "), (503, "ABC abc Abc,abc" * 50), (None, docs[9][1]), (504, docs[9][1]), (505, voc[3] + " " + "x " * 200000)]
    items = {i: " ".join(rnd.choice(voc) for _ in range(rnd.choice([1, 3, 30]))) for i in range(80)}
    items |= {100: docs[7][1], 101: docs[9][1], 102: "ABC! ABC x", 103: "", 104: None, 105: "unseenterm", 106: "x " * 5000, 107: docs[40][1] * 30}
    assert run(spark, docs, list(items.items())) == plain(docs, items)


def test_repeated_rows_and_items(spark):
    _, voc, docs = corpus(2, 30, 40)
    docs += [docs[3], docs[3], (3, "other text " + voc[0])]
    items = [(1, voc[0] + " " + voc[5]), (1, "zz"), (1, voc[0] + " " + voc[5]), (None, voc[1])]
    want = plain(docs, {1: min(voc[0] + " " + voc[5], "zz"), None: voc[1]}, 50)
    assert run(spark, docs, items, 50) == want


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == {}
    assert run(spark, [(1, "a b"), (2, "c")], []) == {}
    assert run(spark, [(1, None), (2, "")], [(1, "a")]) == {}


def test_several_query_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 5)
    monkeypatch.setattr(lexical, "GROUP_BLOCKS", 2)
    rnd, voc, docs = corpus(3, 120, 60)
    items = {i: " ".join(rnd.choice(voc) for _ in range(4)) for i in range(23)}
    assert run(spark, docs, list(items.items()), 3) == plain(docs, items, 3)


def test_bounds_are_never_below_the_score():
    _, voc, docs = corpus(4, 200)
    blocks, bags = lexical._Blocks(), {}
    packed = []
    for i, t in docs:
        raw = np.frombuffer(t.encode(), np.uint8)
        h = words(raw, np.array([0, len(raw)]), TERM, FOLDED)[2]
        bags[i] = dict(zip(*np.unique(h, return_counts=True)))
        packed += blocks.add(i, 0, len(h), *np.unique(h, return_counts=True))
    packed += blocks.rest()
    every = np.unique(np.concatenate([list(b) for b in bags.values()]))
    gains = np.arange(1, len(every) + 1)
    query = lexical._Query(np.array([0]), None, None, None, np.array([len(every)]), every.view(np.int64), gains)
    seen, slack = 0, []
    for log_bits, ids, ths, ns, slices in packed:
        ids, ns = np.frombuffer(ids, "<i8"), np.frombuffer(ns, "<i8")
        m = lexical._length(ns, 200, 10000)
        bound = lexical.bounds(query, np.frombuffer(slices, np.uint8).reshape(1 << log_bits, -1), log_bits, m)[0]
        for i, mm, b in zip(ids.tolist(), m.tolist(), bound.tolist()):
            score = sum(int(g) * (1000000000 * int(bags[i][t]) // (1000 * int(bags[i][t]) + 8 * mm)) for t, g in zip(every, gains) if t in bags[i])
            assert b >= score
            slack.append(b / score)
            seen += 1
    assert seen == 200 and np.median(slack) < 1.3
