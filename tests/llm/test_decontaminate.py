import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.llm import decontaminate as dc


def bag(w):
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def best(doc, item):
    """The largest similarity of any window of the item's length."""
    d, b = doc.lower().split(), item.lower().split()
    want = bag(b)
    if not want or not bag(d):
        return 0.0
    if len(b) < 5 and len(d) >= 5:
        return 0.0
    out = 0.0
    for s in range(max(1, len(d) - len(b) + 1)):
        have = bag(d[s:s + len(b)])
        out = max(out, sum((have & want).values()) / sum((have | want).values()))
    return out


@pytest.fixture(scope="module")
def tables(words):
    rnd = random.Random(31)
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(12, 70)))) for i in range(30)]
    items += [(100, "alpha beta gamma"), (101, ""), (102, None), (103, "la la la la la la la la la la la la")]
    docs = []
    for i in range(160):
        text = rnd.choices(words, k=rnd.randint(0, 150))
        if i % 3 == 0:
            w = rnd.choice(items[:30])[1].split()
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                at = rnd.randrange(len(w))
                w[at:at + rnd.randint(0, 1)] = [rnd.choice(words)] * rnd.randint(0, 1)
            at = rnd.randrange(len(text) + 1)
            text[at:at] = w
        docs.append((i, rnd.choice([" ", "\n"]).join(text).replace("o", rnd.choice("oO"))))
    docs += [(500, "Alpha beta GAMMA"), (501, "alpha beta gamma delta epsilon zeta"), (502, None), (503, ""), (504, "la " * 300), (505, "x " * 30_000)]
    docs += [(600 + i, "intro " + items[0][1]) for i in range(60)]
    return docs, items


def test_leaks(spark, tables):
    docs, items = tables
    df = spark.createDataFrame([(i, t, 7, "v") for i, t in docs + docs[:40]], "doc_id long, text string, n_words int, hs string")
    bf = spark.createDataFrame([(i, t, 1) for i, t in items + items[:3]], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in dc.contaminated(df, bf).collect()}
    want = {(i, j): s for i, t in docs if i != 505 for j, u in items if (s := best(t or "", u or "")) >= 0.8}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    clean = dc.keep_clean(df, bf)
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_without_broadcasts(spark, tables, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    docs, items = tables
    df = spark.createDataFrame(docs[:90] + [(None, items[0][1])], "doc_id long, text string")
    bf = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(df, bf).collect()}
    assert got == {(i, j) for i, t in docs[:90] + [(None, items[0][1])] for j, u in items if best(t or "", u or "") >= 0.8}


def test_radius_is_guaranteed():
    masks = set(dc.MASKS)
    rnd = random.Random(1)
    for _ in range(3000):
        flips = rnd.sample(range(64), rnd.randint(0, dc.RADIUS))
        assert any(sum(1 << f % 8 for f in flips if f // 8 == b) in masks for b in range(8))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    bf = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert dc.contaminated(df, bf).count() == 0 and dc.contaminated(one, bf).count() == 0
    assert dc.keep_clean(one, bf).count() == 1


def test_simhash(spark):
    hs = [3, -5, 2 ** 62, 77, -1]
    got = spark.createDataFrame([(hs,)], "hs array<long>").select(dc.simhash("hs").alias("f")).first()["f"]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert got % 2 ** 64 == want


@pytest.mark.parametrize("size, ends, middle", [(100, 3, 6), (150, 3, 12), (200, 5, 15)])
def test_best_window_between_alignments(spark, size, ends, middle):
    item = [f"w{i}" for i in range(size)]
    copy = ["u"] * ends + item[ends:size // 2] + ["v"] * middle + item[size // 2:size - ends] + ["z"] * ends
    doc = " ".join(["pre"] * 7 + copy + ["post"] * 9)
    short = item[:size - 4]  # a text that is shorter than the item
    docs = [(1, doc), (2, " ".join(short)), (3, " ".join(item[:size // 2]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bf = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["similarity"] for r in dc.contaminated(df, bf).collect()}
    want = {i: s for i, t in docs if (s := best(t, " ".join(item))) >= 0.8}
    assert set(got) == set(want) == {1, 2} and all(abs(got[i] - want[i]) < 1e-9 for i in want)
