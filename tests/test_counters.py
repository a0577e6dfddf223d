"""Counts from parts: any split of a text, threads of messages, two counters."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from skein.functions import counters
from skein.functions.counters import PatternCounter, VocabularyCounter, ends, merge, seams, summaries, totals
from skein.plans import build_threads as bt

public_tokenizers = pytest.importorskip("public_tokenizers")
COUNTERS = [PatternCounter(), PatternCounter(counters.RUN_PATTERN), *(VocabularyCounter(public_tokenizers.path(f)) for f in (
    "byte_bpe_50k.json", "word_bpe_49k.json"))]
PIECES = ["don't", " ", "  ", "\n", "\t ", "\xa0", "　", "Hello", "world.", '"', ", ", '": ', "[]}", "😀", "日本語", "é", "é", "123", "4", "'s", "'", "<|endoftext|>",
          "...", "x" * 40, "\\u0001", "_", "\r\n", "Ünïcode", "?!"]


def texts(n, seed):
    rnd = random.Random(seed)
    return [rnd, ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40))) for _ in range(n)] + ["", " ", "a", "  a", "a  ", " \n ", "no-cut" * 9]]


@pytest.mark.parametrize("counter", COUNTERS, ids=["pattern", "runs", "bytes", "words"])
def test_any_split_gives_the_count_of_the_text(counter):
    rnd, given = texts(300, 3)
    whole = counter.count(given)
    assert totals([[s] for s in summaries(given, counter)], counter) == whole
    for t, n in zip(given, whole):
        cuts = sorted(rnd.randint(0, len(t)) for _ in range(rnd.randint(0, 6)))
        parts = summaries([t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)])], counter)
        assert totals([parts], counter) == [n]
        left = right = counters.EMPTY
        for p in parts:
            left = merge(left, p, counter)
        for p in reversed(parts):
            right = merge(p, right, counter)
        assert totals([[left], [right]], counter) == [n, n]


def test_ends_and_seams():
    assert ends("one two three") == ("one", " two", " three") and ends(" one") == (" one", None, "") and ends("") == ("", None, "")
    assert ends("one two") == ("one", "", " two") and ends("a  b ") == ("a", "  b", " ")
    parts = summaries(["x", "y z", "", " w v", "u"], PatternCounter())
    assert seams(parts)[1] == ["xy", " z w", " vu"]


@pytest.mark.parametrize("counter", COUNTERS[1:], ids=["runs", "bytes", "words"])
def test_thread_totals_are_those_of_the_rendered_text(spark, sf_dir, counter):
    posts, replies = bt.filtered_forest(spark, sf_dir)
    p = replace(bt.ThreadParams(ft_max_tok=10 ** 6, gen_max_tok=10 ** 6), ft_counter=COUNTERS[0], gen_counter=counter)
    got = {r.focus_id: r for r in bt.stages(posts, replies, p).totals.collect()}
    shown = bt.build_threads(posts, replies, p).collect()
    assert len(shown) == len(got) > 10
    for r in shown:
        assert got[r.id].ft_total == COUNTERS[0].count([r.full_thread])[0]
        assert got[r.id].gen_total == sum(counter.count([r.subthread, r.subthread_context or ""]))
    swapped = replace(p, ft_counter=counter, gen_counter=COUNTERS[0])
    for r in bt.stages(posts, replies, swapped).totals.collect():
        full = next(x for x in shown if x.id == r.focus_id)
        assert r.ft_total == counter.count([full.full_thread])[0]


def test_built_in_counter_by_parts_equals_the_native_path(spark, sf_dir):
    posts, replies = bt.filtered_forest(spark, sf_dir)
    small = bt.ThreadParams(ft_max_tok=1000, gen_max_tok=1200)
    native = bt.build_threads(posts, replies, small)
    by_parts = bt.build_threads(posts, replies, replace(small, ft_counter=COUNTERS[0]))
    assert sorted(map(tuple, native.collect()), key=str) == sorted(map(tuple, by_parts.collect()), key=str)
    uncut = bt.build_threads(posts, replies, bt.ThreadParams(ft_max_tok=10 ** 6, gen_max_tok=10 ** 6))
    assert native.join(uncut, ["id", "full_thread"]).count() < native.count()


def test_each_view_is_cut_by_its_own_counter(spark, sf_dir):
    """The fine-tune view goes by the vocabulary, the generation view by runs; a view is only cut when its counter says so."""
    posts, replies = bt.filtered_forest(spark, sf_dir)
    ft, gen = COUNTERS[2], COUNTERS[1]
    p = bt.ThreadParams(ft_max_tok=1500, gen_max_tok=1000, ft_counter=ft, gen_counter=gen)
    shown = {r.id: r for r in bt.build_threads(posts, replies, p).collect()}
    whole = {r.id: r for r in bt.build_threads(posts, replies, replace(p, ft_max_tok=10 ** 6, gen_max_tok=10 ** 6)).collect()}
    cut = [0, 0]
    for i, r in whole.items():
        n = ft.count([r.full_thread])[0], sum(gen.count([r.subthread, r.subthread_context or ""]))
        assert (shown[i].full_thread == r.full_thread) == (n[0] <= 1500)
        assert ((shown[i].subthread, shown[i].subthread_context) == (r.subthread, r.subthread_context)) == (n[1] <= 1000)
        if n[0] > 1500:
            cut[0] += 1
            assert ft.count([shown[i].full_thread])[0] < n[0]
        if n[1] > 1000:
            cut[1] += 1
            assert sum(gen.count([shown[i].subthread, shown[i].subthread_context or ""])) < n[1]
    assert min(cut) > 0


def test_vocabulary_summaries(spark):
    from skein.operators import summarize

    counter = COUNTERS[2]
    msgs = spark.createDataFrame([("a", "Good words here. Good words there! And nothing else?", [4, 9, 100])], "msg_id string, body string, caps array<bigint>")
    rows = {r.cap: r for r in summarize.summaries(msgs, counter).collect()}
    assert rows[100].summary == "Good words here. Good words there! And nothing else?" and rows[4].summary == ""
    ranked = summarize.ranked_sentences(msgs.drop("caps"), counter).orderBy("srank").collect()
    assert [r.tok for r in ranked] == counter.count([f'"{r.sent}"' for r in ranked])
    assert rows[9].k == sum(r.run <= 9 for r in ranked)
    assert msgs.select(F.size("caps")).first()[0] == 3
