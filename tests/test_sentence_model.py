"""Learned abbreviations and sentence starters, and the splitting that uses them."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.operators import sentence_model as sm
from skein.operators import summarize
from skein.operators.sentence_model import SentenceModel, split_sentences
from skein.plans import registry

MODEL = SentenceModel(frozenset({"dr", "e.g", "etc", "approx"}), frozenset({"the", "he", "it"}))


@pytest.mark.parametrize("text,want", [
    ("Dr. X went home. He slept.", ["Dr. X went home.", "He slept."]),
    ("Use e.g. y or z. Fine", ["Use e.g. y or z.", "Fine"]),
    ("Pi is 3.14 here. Next!  Really?! Yes", ["Pi is 3.14 here.", "Next!", "Really?!", "Yes"]),
    ("Cats etc. The end.", ["Cats etc.", "The end."]),           # a capitalised starter ends the sentence all the same
    ("Cats etc. the end.", ["Cats etc. the end."]),
    ("J. R. Smith came. It rained.", ["J. R. Smith came.", "It rained."]),
    ('He said "no." Then left.', ['He said "no."', "Then left."]),
    ("Wait... what. ok", ["Wait...", "what.", "ok"]), ("approx.! The", ["approx.!", "The"]),
    ("(approx.) five", ["(approx.) five"]), ("", []), (" \n ", []), ("...", []), ("... a.", ["a."]), ("no end", ["no end"]),
    ("a.\nb.\tc", ["a.", "b.", "c"]), ("É. Zola. Dr", ["É. Zola.", "Dr"])])
def test_split(text, want):
    assert split_sentences(text, MODEL) == want


def corpus(seed=4):
    rnd = random.Random(seed)
    nouns = ["".join(rnd.choice("abdefgiklmnoprstu") for _ in range(rnd.randint(4, 9))) for _ in range(300)]
    starts = ["The", "However", "They", "It"]

    def sentence():
        ws = [rnd.choice(nouns) for _ in range(rnd.randint(4, 12))]
        for abbr in ("Dr.", "approx.", "e.g.", "vs."):
            if rnd.random() < 0.1:
                ws.insert(rnd.randrange(len(ws)), abbr)
        return f"{rnd.choice(starts)} {' '.join(ws)}."
    return [" ".join(sentence() for _ in range(rnd.randint(1, 8))) for _ in range(400)]


def test_planted_abbreviations_are_found(spark):
    texts = corpus()
    msgs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("n", None), ("e", "")], "msg_id string, body string")
    model = sm.learn(msgs)
    assert {"dr", "approx", "e.g", "vs"} <= model.abbreviations
    assert {"the", "however", "they", "it"} <= model.starters
    assert len(model.abbreviations) < 12 and not model.abbreviations & model.starters
    cut = [s for t in texts for s in split_sentences(t, model)]
    assert sum(s.split()[0] in ("The", "However", "They", "It") for s in cut) > 0.99 * len(cut)
    with_model = {r.msg_id: r.sents for r in sm.with_sentences(msgs, model).collect()}
    assert with_model["3"] == split_sentences(texts[3], model) and with_model["n"] == [] and with_model["e"] == []


def test_texts_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text
    texts = corpus(6)[:50] + [None, "", "One. ... two.. B.\u2028 three.\n\nFour (ab.) 'Five'. six"]
    rows = spark.createDataFrame([(t,) for t in texts], "body string")
    model = sm.learn(rows.select(F.udf(read, "string").asNondeterministic()("body").alias("body")))
    assert model == sm.learn(rows)
    assert seen.value == len(texts)


def test_stop_counts(spark):
    rows = spark.createDataFrame([("One. ... two.. (b.) Four",), ("one. Two one",), ("one.",), (None,), ("",), (" . ",)], "body string")
    assert {(r.w, r.stop, r.next): r.n for r in sm.stop_counts(rows).collect()} == {
        ("one", True, "two"): 2, ("one", True, None): 1, ("one", False, None): 1, ("two", False, None): 2,
        ("b", True, "four"): 1, ("four", False, None): 1}


def test_empty_corpus_and_limits(spark, monkeypatch):
    none = spark.createDataFrame([], "body string")
    assert sm.learn(none) == SentenceModel(frozenset(), frozenset())
    monkeypatch.setattr(sm, "MAX_WORDS", 2)
    few = sm.learn(spark.createDataFrame([(t,) for t in corpus(5)], "body string"))
    assert len(few.abbreviations) <= 2 and len(few.starters) <= 2


def test_starters_know_every_abbreviation(spark, tmp_path):
    """More abbreviations of one score than a model holds: a word behind any of them starts no sentence."""
    signs = [chr(0x4E00 + i) for i in range(110)]
    short = [a + b for a in signs for b in signs]
    assert len(short) > sm.MAX_WORDS
    texts = [" ".join(f"{w}. then some more words" for w in short[i:i + 100]) for i in range(0, len(short), 100)]
    texts += [f"such a {w}. However it went on" for w in ("conversation", "circumstance", "neighbourhood")] * 20 + [None, "", "However then"]
    docs = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.w, r.n_after, r.n, round(r.score, 3)) for r in registry.QUERIES["sentence_starters"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in docs], "text": pa.array(texts, pa.string())}))
    want = {(w, a, n, round(s, 3)) for w, a, n, s in con.execute(registry.ORACLE["sentence_starters"]).fetchall()}
    assert got == want and {r[:3] for r in got} == {("however", 60, 61)}


def test_summaries_take_the_model(spark):
    body = "Dr. Brown likes maps. Maps help Dr. Brown walk. Nothing else."
    msgs = spark.createDataFrame([("a", body, [7, 10, 100])], "msg_id string, body string, caps array<bigint>")
    fixed = {r.cap: r.summary for r in summarize.summaries(msgs).collect()}
    learned = {r.cap: r.summary for r in summarize.summaries(msgs, model=MODEL).collect()}
    assert learned[100] == body and fixed[100] == body
    ranked = summarize.ranked_sentences(msgs.drop("caps"), model=MODEL).orderBy("i").collect()
    assert [r.sent for r in ranked] == ["Dr. Brown likes maps.", "Maps help Dr. Brown walk.", "Nothing else."]
    assert learned[10] != fixed[10] and "Dr." not in learned[7].split()
