import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import toxicity


def plain_segments(s):
    """By the definition: the best segment, then the same on both sides of it."""
    best = None
    for a in range(len(s)):
        for b in range(a + 1, len(s) + 1):
            x = sum(s[a:b])
            if x > 0 and (best is None or x > best[2]):
                best = (a, b, x)
    if best is None:
        return []
    a, b, x = best
    return plain_segments(s[:a]) + [best] + [(i + b, j + b, y) for i, j, y in plain_segments(s[b:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-50, 50), max_size=14))
def test_segments_by_definition(s):
    s = [x + 0.001 * (i + 2) ** 0.5 for i, x in enumerate(s)]  # no ties
    assert [(a, b, round(x, 6)) for a, b, x in toxicity.maximal_segments(s)] == [(a, b, round(x, 6)) for a, b, x in plain_segments(s)]


@pytest.fixture(scope="module")
def corpus(words):
    rnd = random.Random(9)
    bad = ["vilefoo", "vilebar", "grubby", "snarl"]
    docs, labels = [], []
    for i in range(900):
        text = rnd.choices(words, k=rnd.randint(5, 120))
        toxic = i % 9 == 0
        if toxic:
            at = rnd.randrange(len(text) + 1)
            text[at:at] = rnd.choices(bad, k=rnd.randint(3, 6))
        docs.append((i, " ".join(text), "x", 0.5))
        labels.append((i, 1, int(toxic)))
    return docs, labels


DOCS, LABELS = "doc_id long, text string, lang string, score double", "doc_id long, quality int, toxic int"


def test_held_out_accuracy_and_passages(spark, corpus):
    docs, labels = corpus
    df = spark.createDataFrame(docs + [(2000, None, None, None), (2001, "", None, None), (None, "words", None, None), (2002, "x " * 50000, "", 0.0)], DOCS)
    lf = spark.createDataFrame(labels + [(5, 0, None), (None, 1, 1), (1, 1, 0)], LABELS)
    got = toxicity.score_documents(df, lf).collect()
    assert len(got) == len(docs) + 4 and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: t for i, _, t in labels}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == int(r["score"] >= 0.7)
    test = [r for r in got if r["doc_id"] in truth and r["held_out"]]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in test)
    assert right / len(test) > 0.97
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] in (None, 2000, 2001, 2002))
    model = toxicity.fit(df, lf)
    text = "plain start " + docs[1][1] + " vilebar grubby vilenew snarl " + docs[2][1]
    one = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, passages=True).first()
    spans = [text[p["start"]:p["end"]] for p in one["passages"]]
    assert any("vilebar grubby vilenew snarl" in s for s in spans) and max(map(len, spans)) < 80


def test_held_out_labels_are_never_read(spark, corpus):
    docs, labels = corpus
    df = spark.createDataFrame(docs, DOCS)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a, b = (sorted((r["doc_id"], r["score"]) for r in toxicity.score_documents(df, spark.createDataFrame(x, LABELS)).collect()) for x in (labels, flipped))
    assert a == b


def test_without_labels_or_documents(spark, corpus):
    docs, labels = corpus
    df = spark.createDataFrame(docs[:20], DOCS)
    for x in ([], [(1, 1, 0), (2, 1, 0)], [(0, 1, 1)]):
        got = toxicity.score_documents(df, spark.createDataFrame(x, LABELS)).collect()
        assert len(got) == 20 and {r["score"] for r in got} == {0.0}
    assert toxicity.score_documents(df.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0
    kept = toxicity.keep_clean(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert kept.columns == ["doc_id", "text", "lang", "score"]


def test_combining_marks_split_alike_in_fit_and_score(spark):
    """Words with combining marks are learned and met again as the same words."""
    word = "\u0928\u0940\u091a\u0924\u093e"  # letters with vowel signs
    accent = "cafe\u0301s"
    assert toxicity.split_words(f"{word} {accent}, x_1") == [word, accent, "x_1"]
    assert [m.group() for m in toxicity._matches(f"{word} {accent}")] == [word, accent]
    docs = [(i, f"{word if i % 4 == 0 else accent} " + " ".join(f"w{(i * 7 + k) % 97}" for k in range(12))) for i in range(900)]
    labels = [(i, int(i % 4 == 0)) for i in range(900)]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.share[word] > 0.9 and word not in ("",) and all(len(w.strip()) for w in model.share)
    scores = toxicity._Scores(model)
    assert scores[word] > 0 > scores["w3"]
    assert toxicity.text_segments(docs[0][1], scores)[1] and not toxicity.text_segments(docs[1][1], scores)[1]
