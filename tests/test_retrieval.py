"""Exact cosine top-k: against brute force, whatever the cells and blocks."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.operators import retrieve
from skein.operators.beside import beside


def cosine(a, b):
    n = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
    return round(sum(x * y for x, y in zip(a, b)) / n, 12) + 0.0 if n else 0.0


def usable(v):
    return v and all(x is not None and math.isfinite(x) for x in v)


def plain(rows, queries, k):
    return {(q, r, c) for q, a in queries if q is not None and usable(a) for r, (_, c) in enumerate(
        sorted((-cosine(a, b), c) for c, b in rows if c is not None and usable(b) and len(b) == len(a))[:k], 1)}


def run(spark, rows, queries, k, id_type="long"):
    corpus = spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id {id_type}, embedding array<double>, id string")
    asked = spark.createDataFrame([(i, v, 1.0) for i, v in queries], "qid string, qvec array<double>, score double")
    best, report = retrieve.search(corpus, asked, k)
    got = [(r.qid, r["rank"], r.vec_id) for r in best.collect()]
    assert len(got) == len(set(got))
    return set(got), {r.qid: r.n_scored for r in report.collect()}


def clusters(seed, n, dim=6, spread=0.05):
    rnd = random.Random(seed)
    means = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    return [(i, [x + rnd.gauss(0, spread) for x in means[i % 12]]) for i in range(n)]


@pytest.mark.parametrize("case", ["clusters", "coarse", "equal", "zeros", "odd", "few", "strings"])
def test_equals_brute_force(spark, monkeypatch, case):
    monkeypatch.setattr(retrieve, "BLOCK_ROWS", 16)
    rnd = random.Random(7)
    rows = {"clusters": lambda: clusters(1, 600),
            "coarse": lambda: [(i, [rnd.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]) for i in range(200)],
            "equal": lambda: [(i, [0.3, -0.2]) for i in range(300)],
            "zeros": lambda: [(i, [0.0, 0.0] if i % 2 else [rnd.random(), rnd.random() - 0.5]) for i in range(120)],
            "odd": lambda: [(0, None), (1, []), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]),
                            (5, [1.0, 2.0]), (6, [2.0, 4.0]), (7, [1.0, 2.0, 3.0]), (8, [5.0]), (9, [1e300, 1.0])],
            "few": lambda: [(3, [1.0, 0.0]), (1, [0.0, 1.0])],
            "strings": lambda: [(f"a{i}", v) for i, v in clusters(2, 100)]}[case]()
    queries = [(f"q{i}", v) for i, v in rows[::3]] + [("z", [0.0] * len(rows[-1][1] or [0])), (None, [1.0])]
    got, _ = run(spark, rows, queries, 4, "string" if case == "strings" else "long")
    assert got == plain(rows, queries, 4)


def test_cells_are_skipped_and_counted(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "BLOCK_ROWS", 32)
    rows = clusters(3, 1200, 8, 0.02)
    queries = [(str(i), v) for i, v in rows[::40]]
    got, scored = run(spark, rows, queries, 5)
    assert got == plain(rows, queries, 5)
    assert set(scored) == {q for q, _ in queries}
    assert sum(scored.values()) < 0.5 * len(rows) * len(queries)


def test_groups_of_queries_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "GROUP_QUERIES", 9)
    monkeypatch.setattr(retrieve, "BLOCK_ROWS", 4)
    rows = clusters(4, 60, 3)
    queries = [(str(i), v) for i, v in rows[:30]]
    assert run(spark, rows, queries, 3)[0] == plain(rows, queries, 3)
    assert run(spark, [], queries, 3)[0] == set() and run(spark, rows, [], 3)[0] == set()
    repeated = queries[:2] + [("0", [9.0, 9.0, 9.0])]
    assert run(spark, rows, repeated, 3)[0] == plain(rows, [("0", min(rows[0][1], [9.0, 9.0, 9.0])), repeated[1]], 3)


def test_nothing_passes_through_the_driver(spark, monkeypatch):
    """Only the centres are collected."""
    from pyspark.sql.classic.dataframe import DataFrame

    sizes = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: sizes.append(len(out := collect(self))) or out)
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda self, *a, **k: pytest.fail("an iterator over the driver"))
    rows = clusters(5, 400)
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    hits = retrieve.top_k(corpus, corpus.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), 3)
    assert max(sizes, default=0) <= retrieve.CENTRES and hits.count() == 1200


def test_one_job_for_all_queries_and_k_hits_of_a_task(spark, monkeypatch):
    """neither a job for each group of queries nor hits of each block."""
    monkeypatch.setattr(retrieve, "BLOCK_ROWS", 16)
    monkeypatch.setattr(retrieve, "GROUP_QUERIES", 40)
    stages = {}
    materialize = retrieve.materialize
    monkeypatch.setattr(retrieve, "materialize", lambda df, name: stages.setdefault(name, []).append(materialize(df, name)) or stages[name][-1])
    rows = [(i, [0.3, -0.2]) for i in range(300)]
    queries = [(f"q{i}", v) for i, v in rows[::3]]
    assert run(spark, rows, queries, 4)[0] == plain(rows, queries, 4)
    assert len(stages["hits"]) == 1
    assert stages["hits"][0].where("score is not null").count() == 4 * len(queries)


def test_many_stripes_and_parts(spark, monkeypatch):
    """a task holds one stripe of the queries and one part of the corpus."""
    for name, value in (("BLOCK_ROWS", 4), ("GROUP_QUERIES", 30), ("GROUP_BYTES", 1024), ("TASK_PAIRS", 64), ("SEED_ROWS", 2)):
        monkeypatch.setattr(retrieve, name, value)
    rows = clusters(6, 150, 3) + [(200 + i, [1.0, float(i % 2)]) for i in range(40)] + [(300 + i, [0.0] * 3) for i in range(5)]
    queries = [(str(i), v) for i, v in rows[::2]]
    got, scored = run(spark, rows, queries, 5)
    assert got == plain(rows, queries, 5) and set(scored) == {q for q, _ in queries}
    stripes, parts = retrieve._grid(1000, 1000 * 24, 500, 500 * 24, 8)
    assert stripes >= 1000 / 30 and parts >= 500 * 24 / 1024


def test_scores_that_single_precision_cannot_tell_apart(spark):
    rows = [(i, [math.cos(a), math.sin(a), 0.5]) for i in range(400) for a in [1e-5 * ((i * 37) % 400) + 0.3]]
    queries = [(str(i), v) for i, v in rows[::7]]
    assert run(spark, rows, queries, 6)[0] == plain(rows, queries, 6)


def test_each_query_meets_each_row_once(spark):
    queries = spark.range(30).select((F.col("id") % 3).cast("int").alias("stripe"), F.col("id").alias("q"))
    rows = spark.range(50).select(F.col("id").alias("r"))

    def pairs(held, rest):
        own = [q for b in held for q in b.column("q").to_pylist()]
        for b in rest:
            both = [(q, r) for r in b.column("r").to_pylist() for q in own]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in both], pa.int64()), pa.array([x[1] for x in both], pa.int64())], ["q", "r"])

    met = beside(queries, rows, "r", 2, pairs, "q long, r long", 3)
    assert met.rdd.getNumPartitions() == 6
    assert sorted(map(tuple, met.collect())) == [(q, r) for q in range(30) for r in range(50)]


@pytest.mark.parametrize("levels", [2, 1000])
def test_best_and_leading_hits(levels):
    rnd = np.random.default_rng(8)
    scores = np.round(rnd.integers(0, levels, (20, 64)) / levels, 12)
    ids = rnd.permutation(64)
    expected = [(q, int(ids[c]), scores[q, c]) for q in range(20) for c in sorted(range(64), key=lambda c: (-scores[q, c], ids[c]))[:3]]
    best = retrieve._Best(np.full(20, -2.0), 3)
    for c in range(64):
        best.add(np.arange(20), np.full(20, ids[c]), scores[:, c])
    assert [(int(q), int(i), s) for q, i, s in zip(*best.best())] == expected
    for k in (3, 20, 64, 70):
        led = [divmod(x, 64) for x in retrieve._leading(scores, k).tolist()]
        assert led == [(q, c) for q in range(20) for c in sorted(sorted(range(64), key=lambda c: (-scores[q, c], c))[:k])]
