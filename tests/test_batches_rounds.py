"""Sinks that survive a stop, and rounds of attempts on paths."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein import schemas
from skein.operators import dataset
from skein.plans import rounds
from skein.sources import batches, files

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_a_stop_loses_and_doubles_nothing(spark, tmp_path, fmt):
    path = f"{tmp_path}/table"

    def read():
        return sorted(map(tuple, batches.read_batches(spark, path, SCHEMA, fmt).collect()))

    assert read() == [] and batches.committed(spark, path) == {}
    batches.write_batch(rows(spark, (1, "a"), (2, "b")), path, "one", fmt)
    batches.write_data(rows(spark, (3, "c")), path, "two", fmt)          # stopped here: written, not committed
    assert read() == [(1, "a"), (2, "b")]
    batches.write_batch(rows(spark, (3, "c")), path, "two", fmt)         # run again
    assert read() == [(1, "a"), (2, "b"), (3, "c")]
    batches.write_batch(rows(spark, (1, "A")), path, "one", fmt)         # a repeated batch replaces itself only
    batches.write_data(rows(spark, (9, "z")), path, "one", fmt)          # and a stopped repeat changes nothing
    assert read() == [(1, "A"), (3, "c")]
    batches.write_batch(rows(spark), path, "empty", fmt)
    assert read() == [(1, "A"), (3, "c")] and set(batches.committed(spark, path)) == {"one", "two", "empty"}
    assert [tuple(r) for r in batches.read_batches(spark, path, SCHEMA, fmt, ["two"]).collect()] == [(3, "c")]


def test_failing_write_leaves_the_table(spark, tmp_path):
    path = f"{tmp_path}/table"
    batches.write_batch(rows(spark, (1, "a")), path, "one")
    bad = rows(spark, (2, "x")).withColumn("v", F.expr("cast(raise_error('stop') as string)"))
    with pytest.raises(Exception, match="stop"):
        batches.write_batch(bad, path, "one")
    assert [tuple(r) for r in batches.read_batches(spark, path, SCHEMA).collect()] == [(1, "a")]


GOOD_Q, GOOD_A = "<question>Why {}?</question>", "<analysis>r</analysis><answer>a</answer>"


def answer(i, j, stage, attempt):
    """What the model says; thread t0 is easy, t1 slow, t2 hopeless, t3 blank, t4 has no answer."""
    if i == "t0":
        return GOOD_Q.format(j) if stage == "question" else GOOD_A
    if i == "t1":
        return "?" if attempt < 2 else GOOD_Q.format(j) if stage == "question" else GOOD_A
    if i == "t2":
        return "no"
    if i == "t3":
        return "<question> </question>" if j == 1 else GOOD_Q.format(j) if stage == "question" else GOOD_A
    return GOOD_Q.format(j) if stage == "question" else "nothing"


def expected_requests(ids, n):
    """Every request that asking in turn would make, and those a skip saves."""
    out = set()
    for i in ids:
        for j in range(n):
            ok = False
            for stage in ("question", "answer"):
                text = ""
                for a in range(5):
                    out.add((i, j, stage, a))
                    text = answer(i, j, stage, a)
                    if "<question>" in text or "<analysis>" in text:
                        break
                ok = "<question>" in text or "<analysis>" in text
                if not ok or "> <" in text:
                    break
            if "> <" in text:
                break
    return out


def test_rounds_until_nothing_is_open(spark, tmp_path):
    ids = [f"t{i}" for i in range(5)]
    sampled, said, ledger = f"{tmp_path}/sampled", f"{tmp_path}/said", f"{tmp_path}/ledger"
    spark.createDataFrame([(i, f"{{{i}}}", None if i != "t1" else "ctx") for i in ids],
                          "id string, subthread string, subthread_context string").write.parquet(sampled)
    n, asked, k = 3, set(), 0
    while (number := rounds.write_round(spark, sampled, said, ledger, n)) is not None:
        k += 1
        assert number == k
        # nothing was answered since: a replay writes nothing
        assert rounds.write_round(spark, sampled, said, ledger, n) is None
        own = rounds.read_round(spark, ledger, number).collect()
        keys = {tuple(r[c] for c in rounds.KEY) for r in own}
        assert len(keys) == len(own) and not keys & asked
        assert {tuple(r[c] for c in rounds.KEY) for r in rounds.pending(spark, said, ledger).collect()} == keys
        assert all((f"Why {r.j}?" in r.request) == (r.stage == "answer") and ("ctx" in r.request) == (r.thread_id == "t1") and r.system for r in own)
        asked |= keys
        texts = [(*x, answer(*x)) for x in sorted(keys)]
        spark.createDataFrame(texts + texts[:2], schemas.RESPONSES).write.mode("append").json(said)  # some answers come twice
        assert k < 12
    want = expected_requests(ids, n)
    skipped = {x for x in asked - want}
    # question numbers are asked side by side, so some of t3's were out before its blank question came
    assert want <= asked and {x[0] for x in skipped} <= {"t3"} and {x[1] for x in skipped} <= {2}
    resp = files.read_json(spark, said, schemas.RESPONSES).distinct()
    every = spark.createDataFrame([(i, j) for i in ids for j in range(n)], "thread_id string, j int")
    emb = every.withColumn("embeddings", F.array(F.lit(1.0)))
    status = {(r.thread_id, r.j): r.status for r in dataset.outcomes(every, resp, emb).collect()}
    assert status == {("t0", j): "ok" for j in range(3)} | {("t1", j): "ok" for j in range(3)} | {("t2", j): "failed" for j in range(3)} | {
        ("t3", 0): "ok", ("t3", 1): "skipped"} | {("t4", j): "failed" for j in range(3)}


def test_gaps_and_late_attempts(spark):
    every = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("d", 0)], "thread_id string, j int")
    said = [("a", 0, "question", 1, "x"), ("a", 0, "question", 0, None), ("b", 0, "question", 2, "x"), ("c", 0, "question", 7, GOOD_Q),
            *[("d", 0, "question", k, "x") for k in range(5)], ("zz", 0, "question", 0, GOOD_Q)]
    got = {tuple(r) for r in rounds.open_requests(every, spark.createDataFrame(said, schemas.RESPONSES)).collect()}
    assert got == {("a", 0, "question", 2, None), ("b", 0, "question", 0, None), ("c", 0, "question", 0, None)}
