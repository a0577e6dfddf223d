"""Repeated ids, rings and the reasons why replies are detached."""

import datetime as dt
import random

from skein import schemas
from skein.operators import tree

T0 = dt.datetime(2024, 1, 1)


def replies_of(spark, rows):
    """(id, parent, minute) rows; input order is the row's place."""
    return spark.createDataFrame([(i, p, "u/b", 9, None if m is None else T0 + dt.timedelta(minutes=m), f"{i} {k}", None, k)
                                  for k, (i, p, m) in enumerate(rows)], schemas.REPLIES)


def posts_of(spark, ids):
    return spark.createDataFrame([(i, "u/a", "T", 9, T0, "b", None, None, k) for k, i in enumerate(ids)], schemas.POSTS)


def climb(rows, posts):
    """id -> (kind, where, depth) by following parents one by one, with the earliest row of each id."""
    order = {}
    for k, (i, p, m) in enumerate(rows):
        key = (m is None, m or 0, k)
        if i not in order or key < order[i][0]:
            order[i] = key, p
    up = {i: p for i, (_, p) in order.items()}
    out = {}
    for i in up:
        path, cur = [i], up[i]
        while cur in up and cur not in path and cur not in posts:
            path.append(cur)
            cur = up[cur]
        out[i] = ("post", cur, len(path)) if cur in posts else ("cycle", min(path[path.index(cur):]), 0) if cur in path else ("end", cur, 0)
    return out


def test_six_rows_of_four_ids(spark):
    rows = [("a", "p", 5), ("a", "p", 1), ("b", "a", 2), ("b", "a", 9), ("c", "b", 3), ("d", "c", 4)]
    got = {r.id: (r.depth, r.body) for r in tree.attach_all(posts_of(spark, ["p"]), replies_of(spark, rows)).collect()}
    assert tree.attach_all(posts_of(spark, ["p"]), replies_of(spark, rows)).count() == 4
    assert got == {"a": (1, "a 1"), "b": (2, "b 2"), "c": (3, "c 4"), "d": (4, "d 5")}
    looked = {r.id: (r.parent_reply_id, r.parent_ord, r.body) for r in tree.parent_lookup(replies_of(spark, rows)).collect()}
    assert looked == {"a": (None, None, "a 1"), "b": ("a", 1, "b 2"), "c": ("b", 2, "c 4"), "d": ("c", 4, "d 5")}
    assert tree.parent_lookup(replies_of(spark, rows)).count() == 4


def test_reasons(spark):
    rows = [("a", "p", 1), ("b", "gone", 1), ("c", "b", 1), ("d", None, 1), ("e", "mod", 1), ("f", "e", 1), ("s", "s", 1),
            ("x", "y", 1), ("y", "z", 1), ("z", "x", 1), ("m1", "m2", 1), ("m2", "y", 1), ("a", "gone", 2), ("q", "p", None), ("q", "gone", 3)]
    got = {(r.id, r.reason, r["at"]) for r in tree.detached(posts_of(spark, ["p"]), replies_of(spark, rows),
                                                         spark.createDataFrame([("mod",), ("mod",), ("p",)], "id string")).collect()}
    assert got == {("b", "no parent", "gone"), ("c", "no parent", "gone"), ("d", "no parent", None), ("e", "filtered ancestor", "mod"),
                   ("f", "filtered ancestor", "mod"), ("s", "cycle", "s"), ("x", "cycle", "x"), ("y", "cycle", "x"), ("z", "cycle", "x"),
                   ("m1", "cycle", "x"), ("m2", "cycle", "x"), ("q", "no parent", "gone")}
    assert tree.detached(posts_of(spark, ["p"]), replies_of(spark, rows)).where("reason = 'filtered ancestor'").count() == 0
    assert tree.detached(posts_of(spark, ["p"]), replies_of(spark, [])).count() == 0


def test_random_pointers(spark):
    """Chains, rings and what leads into them, of any length; labels are the rings' smallest ids."""
    rnd = random.Random(11)
    ids = [f"n{i:03d}" for i in range(260)]
    rows = [(i, rnd.choice([rnd.choice(ids), rnd.choice(ids), "p", "lost", None]) if rnd.random() < 0.8 else rnd.choice(ids[:9]), rnd.randint(0, 9)) for i in ids]
    rows += [(i, rnd.choice(ids), rnd.randint(0, 9)) for i in rnd.sample(ids, 60)]
    ring = [f"r{i:02d}" for i in range(37)]
    rows += [(a, b, 0) for a, b in zip(ring, ring[1:] + ring[:1])] + [("aaa", "aab", 0), ("aab", "aac", 0), ("aac", "r20", 0)]
    rnd.shuffle(rows)
    want = climb(rows, {"p"})
    posts, replies = posts_of(spark, ["p"]), replies_of(spark, rows)
    assert {(r.id, r.post_id, r.depth) for r in tree.attach_all(posts, replies).collect()} == {(i, w, d) for i, (k, w, d) in want.items() if k == "post"}
    names = {"end": "no parent", "cycle": "cycle"}
    assert {(r.id, r.reason, r["at"]) for r in tree.detached(posts, replies).collect()} == {
        (i, names[k], w) for i, (k, w, _) in want.items() if k != "post"}
    assert {w for k, w, _ in want.values() if k == "cycle"} >= {"r00"}
