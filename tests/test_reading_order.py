"""Dense places of thread rows, against a plain walk; written output is in that order."""

import datetime as dt
import glob
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from skein import schemas
from skein.operators import ordering, reading_order, threads
from skein.plans import build_threads as bt
from skein.sources import files

T0 = dt.datetime(2024, 1, 1)


def forest(spark, seed=1, n=400):
    """A hot post, chains and ties; replies may come before their parents."""
    rnd = random.Random(seed)
    posts = [(f"t3_{i}", "u", "T", 9, T0, "b", None, None, (i * 7) % 20) for i in range(20)]
    ids = [p[0] for p in posts]
    replies = []
    for k in range(n):
        parent = "t3_3" if k % 3 == 0 else rnd.choice(ids)
        replies.append((f"t1_{k}", parent, "u", rnd.randint(5, 8), T0 + dt.timedelta(minutes=rnd.randint(0, 3)), f"Body {k}.", None, k))
        ids.append(f"t1_{k}")
    rnd.shuffle(replies)
    return spark.createDataFrame(posts, schemas.POSTS), spark.createDataFrame(replies, schemas.REPLIES), posts, replies


def walk(posts, replies, max_depth):
    children, depth = {}, {}
    for r in replies:
        children.setdefault(r[1], []).append(r)
    def kept(i, d):
        depth[i] = d
        for r in children.get(i, []):
            if d <= max_depth:
                kept(r[0], d + 1)
    for p in posts:
        kept(p[0], 0)
    n = {i: sum(r[0] in depth for r in rs) for i, rs in children.items()}
    out = []
    def read(i, d):
        if d > max_depth or not n.get(i):
            return
        out.append(i)
        for r in sorted(children[i], key=lambda r: (-r[3], -n.get(r[0], 0), r[4], r[7])):
            if r[0] in depth:
                read(r[0], d + 1)
    for p in sorted(posts, key=lambda p: p[8]):
        read(p[0], 0)
    return out


def test_places_equal_a_walk(spark):
    for seed, depth in ((1, 3), (2, 1), (3, 0)):
        p, r, posts, replies = forest(spark, seed)
        got = reading_order.positions(threads.forest_nodes(p, r, depth), depth).collect()
        want = walk(posts, replies, depth)
        assert sorted((x.position, x.id) for x in got) == list(enumerate(want)) and len(want) >= 15


def test_written_threads_are_in_reading_order(spark, tmp_path):
    p, r, posts, replies = forest(spark, 4)
    files.write_threads(bt.threads_in_order(p, r), f"{tmp_path}/threads", "position")
    got = [i for f in sorted(glob.glob(f"{tmp_path}/threads/part-*.parquet")) for i in pq.read_table(f).column("id").to_pylist()]
    assert got == walk(posts, replies, 3)
    assert pq.read_schema(glob.glob(f"{tmp_path}/threads/part-*.parquet")[0]).names == schemas.THREADS.fieldNames()
    assert {x.id for x in bt.build_threads(p, r).collect()} == set(got)


def test_running_sums_of_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise((F.col("id") % 9).cast("string")).alias("g"),
                                  (F.col("id") * 7919 % 3001).alias("k"), (F.col("id") % 5).alias("v"))
    placed = ordering.running_sum_within_groups(df, ["g"], [F.col("k").asc()], "v", partitions=8)
    rows = sorted(map(tuple, placed.select("g", "k", "v", "before").collect()))
    run, last = 0, None
    for g, _, v, before in rows:
        run = run if g == last else 0
        assert before == run
        run, last = run + v, g
    assert len(rows) == 3000
