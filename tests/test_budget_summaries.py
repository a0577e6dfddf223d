"""Water-filling against the level it must reach; summaries."""

import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from skein.operators import batches, budget, summarize


def level_by_bisection(toks, budget):
    """The level L at which the texts, each cut to L, fill the budget."""
    low, high = -float(sum(toks) + budget), float(max(toks))
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(t, mid) for t in toks) < budget else (low, mid)
    return high


def test_caps_are_the_water_level(spark):
    rnd = random.Random(7)
    rows, groups = [], {}
    for g in range(300):
        toks = [rnd.randint(1, 60) for _ in range(rnd.randint(1, 8))]
        groups[g] = toks, rnd.randint(1, max(1, sum(toks) - 1))
        rows += [(g, f"m{k}", t, groups[g][1]) for k, t in enumerate(toks)]
    df = spark.createDataFrame(rows, "g int, msg_id string, tok long, budget long")
    got = {}
    for x in budget.waterfill_caps(df, ["g"]).collect():
        got.setdefault(x.g, {})[x.msg_id] = x.cap
    for g, (toks, b) in groups.items():
        level = level_by_bisection(toks, b)
        caps = [got[g][f"m{k}"] for k in range(len(toks))]
        assert all(1 <= c <= t for c, t in zip(caps, toks))
        assert all(abs(c - max(1, math.floor(min(t, level) + 1e-6))) == 0 for c, t in zip(caps, toks))
        assert sum(c for c in caps if c > 1) <= b


def test_caps_never_exceed_tokens(spark):
    df = spark.createDataFrame([(1, "a", 100, 30), (1, "b", 5, 30), (1, "c", 20, 30)],
                               "g int, msg_id string, tok long, budget long")
    out = {x.msg_id: x.cap for x in budget.waterfill_caps(df, ["g"]).collect()}
    assert out["b"] == 5 and out["a"] <= 100 and sum(out.values()) <= 30


def test_summary_order_and_stop(spark):
    text = "Cats like fish. Dogs like bones and dogs like walks. Zzz. Fish fish fish."
    msgs = spark.createDataFrame([("m", text)], "msg_id string, body string")
    ranked = summarize.ranked_sentences(msgs)
    rows = {x.i: x for x in ranked.collect()}
    # "Zzz." has a weight (capital-free letters) but sentence words are lower-cased;
    # unscored sentences are picked first
    assert [x.sent for x in sorted(rows.values(), key=lambda x: x.srank)][0] in {"Zzz.", "Cats like fish."}
    capped = msgs.withColumn("caps", F.array(F.lit(1), F.lit(10_000)).cast("array<long>"))
    out = {x.cap: x.summary for x in summarize.summaries(capped).collect()}
    assert out[1] == ""                     # first pick does not fit
    assert out[10_000] == text              # everything fits, original order


def test_no_shuffle_in_summaries(spark):
    msgs = spark.createDataFrame([("m", "One. Two two.")], "msg_id string, body string")
    capped = msgs.withColumn("caps", F.array(F.lit(5)).cast("array<long>"))
    for df in (summarize.summaries(capped), summarize.ranked_sentences(msgs), summarize.word_weights(msgs)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_message_without_words(spark):
    msgs = spark.createDataFrame([("m", "123. 456!")], "msg_id string, body string")
    ranked = summarize.ranked_sentences(msgs).orderBy("srank").collect()
    assert [x.sent for x in ranked] == ["123.", "456!"] and all(x.score is None for x in ranked)


def test_unscored_first_or_last():
    sents = ["Zz.", "fish fish.", "123."]
    text = " ".join(sents)
    assert [r[0] for r in summarize.rank_sentences(text, sents, [1, 1, 1])] == [0, 2, 1]
    assert [r[0] for r in summarize.rank_sentences(text, sents, [1, 1, 1], "last")] == [1, 0, 2]


def test_python_holds_about_a_megabyte_of_text_at_a_time(spark, monkeypatch):
    """However many rows a batch has, and whatever its texts are long."""
    batch = pa.RecordBatch.from_pydict({"msg_id": [str(i) for i in range(50)], "body": ["ab c. " * 20_000, None, "", "x" * 7, "é" * 900_000] * 10})
    cut = list(batches.pieces(batch, "body"))
    assert pa.Table.from_batches(cut).to_pylist() == batch.to_pylist() and len(cut) > 10
    assert all(c.num_rows == 1 or sum(len((t or "").encode()) for t in c.column("body").to_pylist()) <= batches.PIECE_BYTES for c in cut)
    assert list(batches.pieces(batch.slice(0, 0), "body")) == []

    sizes = []
    monkeypatch.setattr(summarize, "_batch", lambda rows, schema: sizes.append(len(rows)))
    msgs = spark.createDataFrame([("a", "One two. Three.")], "msg_id string, body string")
    monkeypatch.setattr(type(msgs), "mapInArrow", lambda self, run, schema: list(run(iter([batch]))))
    summarize.word_weights(msgs)
    assert len(sizes) > 1
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(batches.ROWS)
