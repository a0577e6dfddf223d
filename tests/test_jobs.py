"""Jobs on real paths, deep trees, hot posts, repeated ids, defects of dump lines."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from skein import schemas
from skein.operators import retrieve, sampling, tree
from skein.plans import build_threads as bt
from skein.plans import generate as gen
from skein.functions.text import count_tokens, string_tokens
from skein.sources import dumps, files

T0 = dt.datetime(2024, 1, 1)


def posts_of(spark, rows):
    return spark.createDataFrame([(i, "u/a", "T", 9, T0, b, None, None, k) for k, (i, b) in enumerate(rows)], schemas.POSTS)


def replies_of(spark, rows):
    return spark.createDataFrame([(i, p, "u/b", 9, T0 + dt.timedelta(minutes=k), b, None, k) for k, (i, p, b) in enumerate(rows)], schemas.REPLIES)


def test_deep_chain_and_cycles(spark):
    chain = [("t1_0", "t3_p", "b")] + [(f"t1_{i}", f"t1_{i - 1}", "b") for i in range(1, 300)]
    rows = chain + [("t1_x", "t1_y", "b"), ("t1_y", "t1_x", "b"), ("t1_lost", "t1_gone", "b"), ("t1_self", "t1_self", "b")]
    random.Random(1).shuffle(rows)
    got = {r.id: (r.post_id, r.depth) for r in tree.attach_all(posts_of(spark, [("t3_p", "x")]), replies_of(spark, rows)).collect()}
    assert got == {f"t1_{i}": ("t3_p", i + 1) for i in range(300)}


def test_hot_post(spark):
    rows = [(f"t1_{i}", "t3_p" if i % 3 else "t3_q", "b.") for i in range(900)]
    out = {r.id: json.loads(r.full_thread) for r in bt.build_threads(posts_of(spark, [("t3_p", "x."), ("t3_q", "y.")]), replies_of(spark, rows)).collect()}
    assert len(out) == 2 and all(len(t["post"]["comments"]) == 3 for t in out.values())


def test_repeated_ids_count_once(spark):
    posts = posts_of(spark, [("t3_p", "first."), ("t3_p", "second.")])
    replies = replies_of(spark, [("t1_a", "t3_p", "early."), ("t1_c", "t1_a", "leaf."), ("t1_a", "t3_p", "late.")])
    assert tree.duplicate_count(replies, "replies").first().n_dropped == 1
    out = {r.id: json.loads(r.full_thread)["post"] for r in bt.build_threads(posts, replies).collect()}
    assert set(out) == {"t3_p", "t1_a"}
    assert out["t3_p"]["body"] == "first." and [c["body"] for c in out["t3_p"]["comments"]] == ["early."]
    assert [c["id"] for c in out["t1_a"]["comments"][0]["comments"]] == ["t1_c"]


def test_tokens_are_those_of_the_json_text(spark):
    texts = ['say "hi"', "two\nlines\tand\\slash", "", "plain", "\x01\x1f", "é ü", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    whole = df.where("t is not null").agg(F.to_json(F.array_sort(F.collect_list("t"))).alias("j"), F.sum(string_tokens(F.col("t"))).alias("s"),
                                          F.count("t").alias("n")).select(count_tokens(F.col("j")).alias("all"), "s", "n").first()
    assert whole["all"] == whole["s"] + whole["n"] + 1  # brackets and commas
    assert df.where("t is null").select(string_tokens(F.col("t")).alias("x")).first().x == 1


def test_dump_defects(spark, tmp_path):
    good = {"author": "a", "title": "t", "score": 1, "created_utc": 1700000000, "id": "x1", "link_flair_text": None,
            "subreddit": "s", "permalink": "/p/", "selftext": None, "distinguished": None}
    lines = [json.dumps(good), json.dumps(good | {"created_utc": "1700000000"}), json.dumps(good | {"created_utc": "abc"}),
             json.dumps(good | {"created_utc": None}), json.dumps(good | {"created_utc": 1e300}), json.dumps(good) + " tail",
             json.dumps(good) + json.dumps(good), "", "{", "[1]", json.dumps(good | {"title": "bad \ud800 half"}),
             json.dumps({k: v for k, v in good.items() if k != "author"})]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, line_no long")
    got = [r.status for r in dumps.parse_lines(df, "posts").orderBy("line_no").collect()]
    assert got == ["ok", "ok", "bad_value", "bad_value", "bad_value", "bad_json", "bad_json", "bad_json", "bad_json", "bad_json", "ok", "missing_key"]
    first = dumps.parse_lines(df, "posts").where("line_no = 0").first()
    assert (first.text, first.distinguished, first.link_flair_text) == ("None", "None", "None")


def test_paths_end_to_end(spark, tmp_path):
    def line(d):
        return json.dumps(d | {"score": 9, "created_utc": 1700000000 + d.pop("t"), "subreddit": "s", "permalink": "/p/", "author": "a"})
    posts = [line({"t": i, "id": f"p{i}", "title": f"Title, {i}", "selftext": f'Body "{i}".\nMore.', "link_flair_text": ""}) for i in range(12)]
    replies = [line({"t": i, "id": f"c{i}", "name": f"t1_c{i}", "parent_id": f"t3_p{i % 12}", "body": f"Reply {i}."}) for i in range(40)]
    for kind, rows in (("posts", posts), ("replies", replies)):
        spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.option("compression", "gzip").text(f"{tmp_path}/dump_{kind}")
        dumps.export(spark, f"{tmp_path}/dump_{kind}", kind, f"{tmp_path}/{kind}", partitions=3)
    bt.write_threads(spark, f"{tmp_path}/posts/records", f"{tmp_path}/replies/records", f"{tmp_path}/threads")
    threads = files.read_threads(spark, f"{tmp_path}/threads")
    assert threads.count() == 12 and threads.columns == schemas.THREADS.fieldNames()
    assert json.loads(threads.where("id = 't3_p3'").first().full_thread)["post"]["body"] == 'Body "3".\nMore.'
    g = gen.GenParams(num_distractors=2)
    gen.write_requests(spark, f"{tmp_path}/threads", f"{tmp_path}/job", g)
    asked = spark.read.json(f"{tmp_path}/job/requests")
    assert asked.count() == 12 and set(asked.columns) == {"thread_id", "j", "system", "request"}
    answers = asked.select("thread_id", F.col("j").cast("int"), F.explode(F.array(
        F.struct(F.lit("question").alias("stage"), F.lit("<question> Why? </question>").alias("text")),
        F.struct(F.lit("answer").alias("stage"), F.lit("<analysis>r</analysis><answer>a</answer>").alias("text")))).alias("x"))
    files.write_json(answers.select("thread_id", "j", "x.stage", F.lit(0).alias("attempt"), "x.text"), f"{tmp_path}/answers")
    asked.select("thread_id", F.col("j").cast("int"), F.array(F.lit(0.5), F.lit(1.0)).alias("embeddings")).write.parquet(f"{tmp_path}/emb")
    gen.write_dataset(spark, f"{tmp_path}/job/sampled", f"{tmp_path}/answers", f"{tmp_path}/emb", f"{tmp_path}/data", g, 0.25)
    test = files.read_json(spark, f"{tmp_path}/data/examples/split=test", schemas.EXAMPLES)
    train = files.read_json(spark, f"{tmp_path}/data/examples/split=train", schemas.EXAMPLES)
    assert (test.count(), train.count()) == (3, 9)
    corpus = files.read_json(spark, f"{tmp_path}/data/corpus", schemas.CORPUS)
    assert {r.query for r in corpus.collect()} == {"Why?"} and corpus.count() == 12
    queries = spark.createDataFrame([("q", [0.5, 1.0])], "qid string, qvec array<double>")
    assert [r["rank"] for r in retrieve.hits(corpus, queries, 3).orderBy("rank").collect()] == [1, 2, 3]


def test_exact_thirds(spark):
    ids = spark.range(300).select(F.col("id").cast("string").alias("id"))
    indexed = sampling.dense_index(ids, "id", 42)
    assert sampling.oracle_flags(indexed, 1 / 3).where("include_oracle").count() == int(300 * (1 / 3))
    assert sampling.split_labels(indexed, 1 / 3).where("split = 'test'").count() == 100


def test_retrieval_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "BLOCK_ROWS", 7)
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]) for i in range(60)] + [(60, None), (61, [1.0, 2.0])]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = corpus.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))

    def cosine(a, b):
        n = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / n, 12) if n else 0.0
    want = {(q, r, c) for q, a in rows if a for r, (_, c) in enumerate(
        sorted((-cosine(a, b), c) for c, b in rows if b and len(b) == len(a))[:4], 1)}
    assert {(r.qid, r["rank"], r.vec_id) for r in retrieve.top_k(corpus, queries, 4).collect()} == want


def test_jobs_on_paths_remove_their_stage_tables(spark, tmp_path):
    from skein import session

    stages = f"{session.shared_dir(spark).removeprefix('file:')}/stages"
    before = set(os.listdir(stages)) if os.path.isdir(stages) else set()
    lines = [json.dumps({"id": f"p{i}", "title": "T", "selftext": "Body.", "link_flair_text": "", "score": 9, "created_utc": 1700000000 + i,
                         "subreddit": "s", "permalink": "/p/", "author": "a"}) for i in range(4)]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{tmp_path}/dump")
    dumps.export(spark, f"{tmp_path}/dump", "posts", f"{tmp_path}/posts")
    reply = "u/b,9,2024-01-01 00:00:00,Reply.,t1_{0},t3_p{0},,s,l"
    (tmp_path / "replies.csv").write_text("\n".join([",".join(dumps.REPLY_FIELDS), *(reply.format(i) for i in range(4))]) + "\n")
    bt.write_threads(spark, f"{tmp_path}/posts/records", f"{tmp_path}/replies.csv", f"{tmp_path}/threads")
    gen.write_requests(spark, f"{tmp_path}/threads", f"{tmp_path}/job")
    assert set(os.listdir(stages)) == before
    assert files.read_threads(spark, f"{tmp_path}/threads").count() == 4
    with pytest.raises(ZeroDivisionError), session.stage_run(spark):
        session.materialize(spark.range(3), "left")
        1 / 0
    assert set(os.listdir(stages)) == before
    kept = session.materialize(spark.range(3), "kept")  # outside of a run a stage table stays
    assert kept.count() == 3 and len(os.listdir(stages)) == len(before) + 1


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from skein import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
