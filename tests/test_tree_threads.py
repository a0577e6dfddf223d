"""Hand-worked trees: pruning, depth cut, ranking ties, thread rows and JSON."""

import datetime as dt
import json

from pyspark.sql import functions as F

from skein import schemas
from skein.operators import clean, threads, tree
from skein.plans import build_threads as bt

T0 = dt.datetime(2024, 1, 1)


def _posts(spark, rows):
    return spark.createDataFrame(rows, schemas.POSTS)


def _replies(spark, rows):
    return spark.createDataFrame(rows, schemas.REPLIES)


def p(id_, score=10, body="post body.", flair=None, dist=None, ord_=0):
    return (id_, "u/a", "Title", score, T0, body, flair, dist, ord_)


def r(id_, parent, score=9, body="reply.", minute=0, dist=None, ord_=0):
    return (id_, parent, "u/b", score, T0 + dt.timedelta(minutes=minute), body, dist, ord_)


def test_worked_example(spark):
    posts = _posts(spark, [p("t3_p")])
    replies = _replies(spark, [r("t1_a", "t3_p", 9, "A.", 1, ord_=1), r("t1_b", "t3_p", 7, "B.", 2, ord_=2),
                               r("t1_c", "t1_a", 8, "C.", 3, ord_=3)])
    out = {row.id: row for row in bt.build_threads(posts, replies).collect()}
    assert set(out) == {"t3_p", "t1_a"}
    full = json.loads(out["t3_p"].full_thread)
    assert [c["id"] for c in full["post"]["comments"]] == ["t1_a", "t1_b"]
    assert "comments" not in full["post"]["comments"][0]
    assert out["t3_p"].subthread_context is None
    a = json.loads(out["t1_a"].full_thread)
    assert [c["id"] for c in a["post"]["comments"]] == ["t1_a"]          # sibling t1_b absent
    assert [c["id"] for c in a["post"]["comments"][0]["comments"]] == ["t1_c"]
    sub = json.loads(out["t1_a"].subthread)
    assert sub["id"] == "t1_a" and [c["id"] for c in sub["comments"]] == ["t1_c"]
    ctx = json.loads(out["t1_a"].subthread_context)
    assert ctx["post"]["comments"] == [{"id": "t1_a", "parent_id": "t3_p", "author": "u/b", "body": "..."}]
    # key order and spacing follow the reference's JSON text
    assert out["t3_p"].full_thread.startswith('{"post": {"id": "t3_p", "author": "u/a", "title": "Title", "body": ')


def test_flair_only_when_present(spark):
    posts = _posts(spark, [p("t3_p", flair="news"), p("t3_q", flair=None, ord_=1)])
    replies = _replies(spark, [r("t1_a", "t3_p"), r("t1_b", "t3_q")])
    out = {row.id: json.loads(row.full_thread) for row in bt.build_threads(posts, replies).collect()}
    assert list(out["t3_p"]["post"])[:5] == ["id", "author", "title", "flair", "body"]
    assert "flair" not in out["t3_q"]["post"]


def test_filter_and_detached_pruning(spark):
    posts = _posts(spark, [p("t3_p"), p("t3_low", score=1, ord_=1)])
    replies = _replies(spark, [
        r("t1_mod", "t3_p", dist="moderator", ord_=1),   # filtered: moderator
        r("t1_kid", "t1_mod", ord_=2),                   # detached: parent filtered
        r("t1_adm", "t3_p", dist="admin", ord_=3),       # admin passes
        r("t1_orphan", "t3_low", ord_=4),                # parent post filtered
        r("t1_rm", "t3_p", body="[removed]", ord_=5),
        r("t1_none", "t3_p", body="None", ord_=6),       # null token -> null body
    ])
    replies = clean.normalize_nulls(replies, ["body"])
    kp, kr = clean.quality_filter(posts), clean.quality_filter(replies)
    ids = {x.id for x in tree.attach_all(kp, kr).collect()}
    assert ids == {"t1_adm"}


def test_depth_cut_and_order_independence(spark):
    chain = [r(f"t1_{i}", "t3_p" if i == 1 else f"t1_{i - 1}", minute=i, ord_=i) for i in range(1, 8)]
    posts = _posts(spark, [p("t3_p")])
    nodes = threads.forest_nodes(posts, _replies(spark, list(reversed(chain))), max_depth=3)
    depths = {x.id: x.depth for x in nodes.collect()}
    assert depths == {"t3_p": 0, "t1_1": 1, "t1_2": 2, "t1_3": 3, "t1_4": 4}
    # focus rows only down to max_depth; the depth-4 leaf is a reply of t1_3
    rows = threads.thread_rows(nodes, 3, 3).where("kind = 'reply'").select("focus_id", "msg_id").collect()
    assert ("t1_3", "t1_4") in {(x.focus_id, x.msg_id) for x in rows}
    assert all(x.focus_id != "t1_4" for x in rows)


def test_rank_ties(spark):
    posts = _posts(spark, [p("t3_p")])
    replies = _replies(spark, [
        r("t1_x", "t3_p", 5, minute=2, ord_=1), r("t1_y", "t3_p", 5, minute=1, ord_=2),
        r("t1_z", "t3_p", 5, minute=1, ord_=3), r("t1_w", "t3_p", 6, minute=9, ord_=4),
        r("t1_k", "t1_x", 5, minute=5, ord_=5),
    ])
    nodes = threads.forest_nodes(posts, replies, 3)
    ranked = tree.rank_replies(nodes.where("depth >= 1")).where("parent_id = 't3_p'")
    order = [x.id for x in ranked.orderBy("rank").collect()]
    # score desc, more replies first, then chronological, then input order
    assert order == ["t1_w", "t1_x", "t1_y", "t1_z"]
    top = tree.top_replies(nodes.where("depth >= 1"), 2).where("parent_id = 't3_p'")
    assert {x.id for x in top.collect()} == {"t1_w", "t1_x"}


def test_no_python_udf_and_group_limit(spark):
    posts = _posts(spark, [p("t3_p")])
    replies = _replies(spark, [r("t1_a", "t3_p")])
    nodes = threads.forest_nodes(posts, replies, 3)
    plan = tree.top_replies(nodes.where("depth >= 1"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    full = bt.build_threads(posts, replies)._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in full and "ArrowEvalPython" not in full and "BatchEvalPython" not in full


def test_limits_checked():
    import pytest

    with pytest.raises(ValueError):
        bt.ThreadParams(ft_max_tok=999).validate()


def test_spread_rank_equals_window_rank_on_hot_parent(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for i in range(600):   # one hot parent with most replies, a few small ones
        parent = "t3_hot" if i % 5 else f"t3_p{i % 7}"
        rows.append((f"t1_{i}", parent, "u", rnd.randint(0, 4), T0 + dt.timedelta(minutes=rnd.randint(0, 9)),
                     "b", None, i))
    df = spark.createDataFrame(rows, schemas.REPLIES).withColumn("num_replies", (F.col("ord") % 3).cast("long"))
    a = {x.id: x.rank for x in tree.rank_replies(df).collect()}
    b = {x.id: x.rank for x in tree.rank_replies_spread(df, partitions=6).collect()}
    assert a == b
