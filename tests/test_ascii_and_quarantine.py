"""ASCII-escaped JSON lines, bad rows of a CSV scan, metrics of an export in one pass."""

import glob
import json
import random

from skein import schemas
from skein.functions.text import ascii_json_string
from skein.plans import generate as gen
from skein.sources import dumps, files
from skein.streaming.ingest import read_metrics, start_ingest


def texts():
    rnd = random.Random(9)
    chars = [*map(chr, range(0, 128)), "é", "ß", "日", " ", "﻿", "😀", "𝒳", "\U0010ffff", "\\u0041", "\\", '"', "/", "\x7f", "\x85"]
    return ["", "plain", "😀", *("".join(rnd.choice(chars) for _ in range(rnd.randint(0, 60))) for _ in range(300)), "x" * 100_000 + "é" * 1000]


def test_bytes_of_the_standard_encoder(spark, tmp_path):
    given = texts() + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    got = {r.i: r.j for r in df.select("i", ascii_json_string(df.t).alias("j")).collect()}
    assert [got[i] for i in range(len(given))] == [json.dumps(t) for t in given]
    rows = [(a, b, None if k % 5 == 0 else a) for k, (a, b) in enumerate(zip(texts()[:100], reversed(texts()[:100])))]
    table = spark.createDataFrame(rows, schemas.EXAMPLES)
    files.write_ascii_json(table.coalesce(1), f"{tmp_path}/lines")
    lines = [x for f in glob.glob(f"{tmp_path}/lines/part-*") for x in open(f, encoding="ascii", newline="\n").read().splitlines()]
    assert sorted(lines) == sorted(json.dumps(dict(zip(("question", "reasoning", "answer"), r))) for r in rows)
    back = files.read_json(spark, f"{tmp_path}/lines", schemas.EXAMPLES)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert gen.GenParams().p == 1.0


def test_bad_csv_rows_go_to_the_quarantine(spark, tmp_path):
    head = ",".join(dumps.POST_FIELDS)
    good = 'u/a,"A, title",7,2024-01-01 00:00:00,"Body ""x""\nline",t3_{},,None,s,l'
    rows = [good.format(1), "u/a,T,seven,2024-01-01 00:00:00,B,t3_2,,,s,l", "u/a,T,7,yesterday,B,t3_3,,,s,l", "u/a,T,7", good.format(4),
            "u/a,T,7,2024-01-01 00:00:00,B,t3_5,,,s,l,more", "u/a,T,None,2024-01-01 00:00:00,B,t3_6,,,s,l", "u/a,T,99999999999999999999,2024-01-01 00:00:00,B,t3_7,,,s,l"]
    (tmp_path / "posts.csv").write_text("\n".join([head, *rows]) + "\n")
    path = str(tmp_path / "posts.csv")
    posts = {r.id: r for r in dumps.read_posts_csv(spark, path).collect()}
    assert set(posts) == {"t3_1", "t3_4", "t3_6"} and posts["t3_1"].body == 'Body "x"\nline' and posts["t3_6"].score is None
    assert posts["t3_1"].created is not None and posts["t3_1"].ord < posts["t3_4"].ord
    assert posts["t3_1"].distinguished is None and set(posts["t3_1"].asDict()) == set(schemas.POSTS.fieldNames())
    bad = {(r.id or r.title, r.reason) for r in dumps.bad_csv_rows(spark, path, "posts").collect()}
    assert bad == {("t3_2", "score is no number"), ("t3_3", "created is no timestamp"), ("T", "wrong number of fields"),
                   ("t3_5", "wrong number of fields"), ("t3_7", "score is no number")}


def line(kind, i, **more):
    row = {"author": "a", "score": i, "created_utc": 1700000000 + i, "subreddit": "s", "permalink": "/p/", "id": f"x{i}"}
    row |= {"title": "T", "link_flair_text": None, "selftext": "b"} if kind == "posts" else {"body": "b", "parent_id": "t3_x"}
    return json.dumps(row | more)


def test_export_reads_once_and_counts(spark, tmp_path):
    rows = [line("posts", i) for i in range(20)] + ["{broken", "[]", line("posts", 30, created_utc="soon"), json.dumps({"id": "y"})]
    spark.createDataFrame([(r,) for r in rows], "value string").repartition(3).write.text(f"{tmp_path}/dump")
    got = dumps.export(spark, f"{tmp_path}/dump", "posts", f"{tmp_path}/out")
    lines = dumps.parse_lines(dumps.read_lines(spark, f"{tmp_path}/dump"), "posts")
    assert got == lines.agg(*dumps.metrics_columns()).first().asDict()
    assert (got["n_lines"], got["n_bad"], got["n_missing"], got["n_bad_value"], got["last_created"]) == (24, 2, 1, 1, "2023-11-14 22:13:39")
    assert dumps.read_posts_csv(spark, f"{tmp_path}/out/records").count() == 20
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.txt").write_text("")
    assert dumps.export(spark, f"{tmp_path}/none", "replies", f"{tmp_path}/out2")["n_lines"] == 0


def test_metrics_of_each_micro_batch(spark, tmp_path):
    for k in range(2):
        rows = [line("replies", i) for i in range(5 + k)] + ["{"] * k
        spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(f"{tmp_path}/src{k}")
    (tmp_path / "src").mkdir()
    for k in range(2):
        for f in glob.glob(f"{tmp_path}/src{k}/part-*"):
            (tmp_path / "src" / f"{k}.txt").write_bytes(open(f, "rb").read())
    start_ingest(spark, f"{tmp_path}/src", f"{tmp_path}/out", "replies", f"{tmp_path}/ckpt", 1).awaitTermination(120)
    got = [tuple(r)[:3] for r in read_metrics(spark, f"{tmp_path}/out", "replies").orderBy("batch").collect()]
    assert len(got) == 2 and sorted(r[1:] for r in got) == [(5, 0), (7, 1)]
