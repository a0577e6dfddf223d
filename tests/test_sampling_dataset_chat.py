"""Sampling properties, response parsing shapes, outcomes, chat rendering."""

import math

import pytest
from pyspark.sql import functions as F

from skein.functions import prompts as PR
from skein.operators import chat, dataset, retrieve, sampling


def _ids(spark, n):
    return spark.createDataFrame([(f"t{i}",) for i in range(n)], "id string")


def test_dense_index_is_permutation(spark):
    idx = sampling.dense_index(_ids(spark, 257), "id", 42, bucket_digits=2)
    got = sorted(x.idx for x in idx.collect())
    assert got == list(range(257))


def test_oracle_flags_count(spark):
    idx = sampling.dense_index(_ids(spark, 101), "id", 42)
    for p in (0.0, 0.33, 1.0):
        n = sampling.oracle_flags(idx, p).where("include_oracle").count()
        assert n == math.floor(101 * p)
    with pytest.raises(ValueError):
        sampling.oracle_flags(idx, 1.5)


def test_distractors_distinct_not_self(spark):
    idx = sampling.dense_index(_ids(spark, 5), "id", 42)
    reqs = _ids(spark, 5).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    d = sampling.distractors(idx, reqs, 4).collect()
    by = {}
    for x in d:
        assert x.distractor_id != x.id
        by.setdefault((x.id, x.j), []).append(x.distractor_id)
    assert len(by) == 10 and all(len(v) == 4 and len(set(v)) == 4 for v in by.values())
    with pytest.raises(ValueError):
        sampling.check_distractors(5, 5)


def test_split_complete_and_disjoint(spark):
    idx = sampling.dense_index(_ids(spark, 50), "id", 42)
    s = {x.split: x.n for x in sampling.split_labels(idx, 0.1).groupBy("split")
         .agg(F.count("*").alias("n")).collect()}
    assert s == {"test": 5, "train": 45}


@pytest.mark.parametrize("text,matched,question", [
    ("<question>\nWhy?\n</question>", True, "Why?"),
    ("no tag", False, ""),
    ("```xml\n<question>\n</question>\n```", True, ""),
    ("<question>\nopen ended", True, "open ended"),
    ("```xml\n<question>\nfenced\n```", True, "fenced"),
    ("<question>trail</question>\n", True, "trail"),
])
def test_parse_question_shapes(spark, text, matched, question):
    df = spark.createDataFrame([(text,)], "text string")
    m, q = dataset.parse_question(F.col("text"))
    row = df.select(m.alias("m"), q.alias("q")).first()
    assert (row.m, row.q) == (matched, question)


def test_parse_answer(spark):
    df = spark.createDataFrame([("<analysis>\nr\n</analysis>\n<answer>\na\n</answer>",),
                                ("<analysis>x</analysis> tail",), ("nothing",)], "text string")
    m, r, a = dataset.parse_answer(F.col("text"))
    rows = df.select(m.alias("m"), r.alias("r"), a.alias("a")).collect()
    assert [(x.m, x.r, x.a) for x in rows] == [(True, "r", "a"), (True, "x", "tail"), (False, "", "")]


def test_skip_drops_later_questions(spark):
    reqs = spark.createDataFrame([("t", 0), ("t", 1), ("t", 2)], "thread_id string, j int")
    resp = spark.createDataFrame([
        ("t", 0, "question", 0, "nope"),                          # failed
        ("t", 1, "question", 0, "<question></question>"),         # blank -> skipped
        ("t", 2, "question", 0, "<question>q</question>"),        # dropped after skip
    ], "thread_id string, j int, stage string, attempt int, text string")
    emb = spark.createDataFrame([], "thread_id string, j int, embeddings array<double>")
    out = {x.j: x.status for x in dataset.outcomes(reqs, resp, emb).collect()}
    assert out == {0: "failed", 1: "skipped"}


def test_render_chat(spark):
    msgs = spark.createDataFrame([
        (1, 0, "system", "S"), (1, 1, "user", "U"), (1, 2, "assistant", "A"), (1, 3, "system", "X"),
        (2, 0, "user", "u"), (2, 1, "tool", "t"), (2, 2, "assistant", "a"),
    ], "conv_id long, turn long, role string, text string")
    out = {x.conv_id: x.text for x in chat.render_chat(msgs, eos="</s>").collect()}
    assert out[1] == "S</s>UA</s>"
    assert out[2] == PR.SYSTEM_PROMPT + "</s>ua</s>"


def test_cosine_topk(spark):
    corpus = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])],
                                   "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "qid long, qvec array<double>")
    hits = retrieve.top_k(corpus, q, 10).orderBy("rank").collect()
    assert [x.vec_id for x in hits] == [0, 2, 1, 3] and hits[-1].score == 0.0
