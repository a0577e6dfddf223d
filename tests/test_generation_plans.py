"""What the steps of the jobs read and carry."""

from datetime import datetime
from types import SimpleNamespace

from skein.plans import build_threads as bt
from skein.plans import generate as gen
from skein.plans import registry


def test_outcomes_are_computed_once(spark):
    ids = [f"t3_{i}" for i in range(4)]
    sampled = spark.createDataFrame([(x, f"thread {x}", i % 2 == 0, i, 4) for i, x in enumerate(ids)],
                                    "id string, full_thread string, include_oracle boolean, idx long, n_total long")
    texts = {"question": "<question>q</question>", "answer": "<analysis>\nr\n</analysis>\n<answer>\na\n</answer>"}
    resp = spark.createDataFrame([(x, 0, s, 0, t) for x in ids for s, t in texts.items()], "thread_id string, j int, stage string, attempt int, text string")
    emb = spark.createDataFrame([(x, 0, [1.0]) for x in ids], "thread_id string, j int, embeddings array<double>")
    out = gen.generate(sampled, resp, emb, gen.GenParams(p=1.0, num_distractors=1, num_questions=1))
    assert "regexp" not in out.examples._jdf.queryExecution().optimizedPlan().toString()
    prompts = {r.thread_id: r.prompt for r in out.prompts.collect()}
    assert sorted(prompts) == ids
    for i, x in enumerate(ids):
        assert prompts[x].count("<thread") == (2 if i % 2 == 0 else 1) and (f"thread {x}" in prompts[x]) == (i % 2 == 0)


def test_bodies_travel_once(spark, monkeypatch):
    at = datetime(2024, 1, 1)
    posts = spark.createDataFrame([("t3_1", "u", "T", 9, at, "word. " * 900, None, None, 0)], "id string, author string, title string, score long, "
                                  "created timestamp, body string, link_flair_text string, distinguished string, ord long")
    replies = spark.createDataFrame([("t1_2", "t3_1", "u", 9, at, "Short.", None, 2)], "id string, parent_id string, author string, score long, "
                                    "created timestamp, body string, distinguished string, ord long")
    real, seen = bt.threads.render_threads, []
    monkeypatch.setattr(bt.threads, "render_threads", lambda rows: seen.append(rows) or real(rows))
    out = bt.build_threads(posts, replies, bt.ThreadParams(ft_max_tok=1000, gen_max_tok=10000)).collect()
    rows = {r.kind: r for r in seen[0].collect()}
    assert rows["reply"].body == "Short." and rows["reply"].body_ft is None and rows["reply"].body_gen is None
    assert rows["focus"].body == "word. " * 900 and rows["focus"].body_gen is None and len(rows["focus"].body_ft) < 5400
    assert "Short." in out[0].full_thread and len(out[0].full_thread) < len(out[0].subthread) and "word. " * 900 in out[0].subthread


def test_corpus_of_hits_is_written_once(spark, sf_dir, monkeypatch):
    rows = spark.createDataFrame([("t3_1", 0, "q", "x", [1.0])], "thread_id string, j int, question string, full_thread string, embeddings array<double>")
    seen = []
    none = spark.createDataFrame([], "qid long, rank int, query string, thread string, score double")
    monkeypatch.setattr(registry, "_gen", lambda s, d: SimpleNamespace(rows=rows))
    monkeypatch.setattr(registry.retrieve, "hits", lambda corpus, queries, k: seen.append(corpus) or none)
    registry.q_corpus_hits(spark, sf_dir)
    assert seen[0].inputFiles() and all("/corpus-" in f for f in seen[0].inputFiles())
