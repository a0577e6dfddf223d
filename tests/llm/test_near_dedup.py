import random
import re

import numpy as np
import pytest

from skein.llm import near_dedup, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def plain_components(rows):
    sets = [(i, plain_set(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                parent[find(a)] = find(b)
    last = float("inf")
    best = {}
    for k, (i, _) in enumerate(sets):
        best[find(k)] = min(best.get(find(k), last), last if i is None else i)
    return {(i, len(s), None if best[find(k)] == last else best[find(k)]) for k, (i, s) in enumerate(sets)}


def test_shingle_sets(words):
    rnd = random.Random(1)
    blanks = [" ", "\n", "\t ", "\x0b", "\x0c\r", "  "]
    texts = ["", None, " \n", "One", "one", "a b c d", "A b c D e", "a b c d e f", "é É\xa0x", "x" * 9000 + " y"]
    texts += ["".join(rnd.choice(words).upper() + rnd.choice(blanks) for _ in range(rnd.randint(1, 400))) for _ in range(60)]
    texts.append(" ".join(rnd.choices(words, k=300_000)))
    got = list(shingles.sets(texts))
    want = [plain_set(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i in range(3, 60):
        for j in range(3, i):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 1, "u") for i, t in rows], "doc_id long, text string, n long, sid string")
    if kw:
        got = [(None if r["_id"] == near_dedup.LAST else r["_id"], r["n"], None if r["component"] == near_dedup.LAST else r["component"])
               for r in near_dedup.link(df, **kw).collect()]
    else:
        out = near_dedup.near_duplicates(df).collect()
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out if r["doc_id"] is not None)
        got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out]
    assert set(got) == plain_components(rows)
    assert len(got) == len({(i, plain_set(t)) for i, t in rows})


@pytest.fixture(scope="module")
def corpus(words):
    rnd = random.Random(11)
    rows, k = [], 0
    for group in range(25):
        base = rnd.choices(words, k=rnd.choice([3, 12, 80, 300, 700]))
        for copy in range(rnd.choice([1, 2, 3, 30])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, len(w) // 30])):
                at = rnd.randrange(len(w))
                w[at:at + rnd.randint(0, 1)] = [rnd.choice(words)]
            rows.append((k * 7 % 1009, rnd.choice([" ", "\n"]).join(w).replace("a", rnd.choice("aA"))))
            k += 1
    return rows + [(2000, None), (2001, ""), (2002, ""), (2003, "  \t")]


def test_components(spark, corpus):
    check(spark, corpus)


def test_branching_and_blocks(spark, corpus, monkeypatch):
    check(spark, corpus, leaf=4, depth=2)
    monkeypatch.setattr(near_dedup, "CLUSTER_SETS", 6)
    check(spark, corpus, leaf=8, depth=0)


def test_odd_rows(spark, corpus):
    text, other = corpus[40][1], corpus[3][1]
    check(spark, [(5, text), (5, text), (3, text), (None, text), (5, other), (8, other), (None, "alone here")])
    check(spark, [])


def test_keep_first(spark, corpus):
    df = spark.createDataFrame([(i, t, "z") for i, t in corpus], "doc_id long, text string, component string")
    kept = near_dedup.keep_first(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, c in plain_components(corpus) if i == c}


def test_keep_first_null_and_repeated_ids(spark, words):
    rnd = random.Random(23)
    a, b, c, d, e, f = (rnd.choices(words, k=200) for _ in range(6))
    near = lambda w: " ".join([*w[:-1], "changed"])
    a, b, c, d, e, f = (" ".join(w) for w in (a, b, c, d, e, f))
    rows = [(1, a), (None, near(a.split())), (None, b), (None, c),  # one null id is a copy, the others are not
            (7, d), (7, near(a.split()) + " more"), (7, e),  # versions of an id, one of them a copy
            (None, f), (None, near(f.split())), (None, f),  # copies that all have null ids
            (9, "again " + e[::-1]), (9, "again " + e[::-1]), (10, ""), (10, ""), (None, None)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, note string")
    got = sorted(((r["doc_id"], r["text"]) for r in near_dedup.keep_first(df, (80, 100)).collect()), key=str)
    one = {t for i, t in got if t in (f, near(f.split()))}
    assert len(one) == 1
    want = [(1, a), (None, b), (None, c), (7, d), (7, e), (None, *one), (9, "again " + e[::-1]), (10, ""), (10, ""), (None, None)]
    assert got == sorted(want, key=str)
