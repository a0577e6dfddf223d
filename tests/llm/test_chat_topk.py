import hashlib
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import chat_format as chat
from skein.llm import topk

PARTS = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "</", "a", " ", "\n", "é"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[ROLE]", "\\</s>"]), PARTS), min_size=1, max_size=7))
def test_pieces_read_back(turns):
    state = chat.PrefixRenderer(chat.inst_template, block=3, overlap=2)
    pieces = [state.push(t) for t in turns]
    assert state.opening + "".join(p for p, _ in pieces) == chat.inst_template(turns)
    assert [chat.read_turn(p)[:2] for p, _ in pieces] == turns and not state.rewrites
    for _, text in turns:
        assert not any(c in chat.escape(text) for c in chat.CONTROL) and chat.unescape(chat.escape(text)) == text


def test_rewriting_template_is_found():
    def last_only(messages):  # shows only the last user message's text
        return "".join(f"({r}:{t if k == len(messages) - 1 else '...'})" for k, (r, t) in enumerate(messages))
    state = chat.PrefixRenderer(last_only)
    assert state.push(("user", "hello"))[1] == 0
    assert state.push(("user", "there"))[1] == len("hello)") and state.rewrites


def last_80(messages):
    return "".join(f"({r}:{t})" for r, t in messages[-80:])


def last_reasoning(messages):  # reasoning of answers before the last user turn is not shown
    last = max((k for k, (r, _) in enumerate(messages) if r == "user"), default=-1)
    return "".join(f"({r}:{t if k > last or r == 'user' else t.split('|')[-1]})" for k, (r, t) in enumerate(messages))


@pytest.mark.parametrize("template, turns", [
    (last_80, [("user", f"turn {k}") for k in range(120)]),
    (last_reasoning, [("user", "q")] + [("assistant", f"why {k}|so {k}") for k in range(70)] + [("user", "end")])])
def test_late_rewrites_of_black_boxes(template, turns):
    state = chat.PrefixRenderer(template)
    whole = ""
    for k, turn in enumerate(turns, 1):
        now = template(turns[:k])
        same = next((i for i, (x, y) in enumerate(zip(now, whole)) if x != y), min(len(now), len(whole)))
        assert state.push(turn) == (now[same:], len(whole) - same)
        whole = now
    assert state.rewrites


def digest(turns):
    text = "".join(f"{r}\n{t}\n" for r, t in turns)
    answers = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(answers), hashlib.sha256(answers.encode()).hexdigest(),
            len(chat.inst_template(turns)), 0)


def test_conversations(spark):
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None]), rnd.choice([None, "", "hi </s>", "é\n[INST]", "x" * 3000]), "y")
            for c in [*range(40), None] for t in range(rnd.randint(1, 9))]
    rows += [(500, t, "user" if t % 2 else "assistant", f"turn {t} [/INST]", "y") for t in range(700)]
    rows += [(501, 0, "user", "same", "y")] * 3 + [(502, None, "user", "a", "y"), (502, 1, "assistant", "b", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.digest(chat.format_turns(df)).collect()}
    convs = {}
    for c, t, r, x, _ in rows:
        convs.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert got == {c: digest([y[1:] for y in sorted(x)]) for c, x in convs.items()}
    assert chat.digest(chat.format_turns(df.limit(0))).count() == 0


def plain_top(rows, k):
    vecs = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * x) for x in v]
        vecs[i] = min(vecs.get(i, w), w)
    out = set()
    for q, a in vecs.items():
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in vecs.items() if c != q and len(a) == len(b))[:k]
            out |= {(q, r, c, -s) for r, (s, c) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("case", ["random", "ties", "few", "odd", "empty"])
def test_top_k(spark, case):
    rnd = random.Random(5)
    rows = {"random": [(i, [rnd.gauss(0, 3) for _ in range(8)]) for i in range(700)],
            "ties": [(i, [0.5, 0.25] if i % 3 else [rnd.random(), -1.0]) for i in range(800)],
            "few": [(0, [1.0]), (1, [2.0]), (50, [-1.0])],
            "odd": [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [0.5, 2.0]), (50, None), (100, [float("nan"), 1.0]), (150, [None, 1.0]),
                    (200, [float("inf"), 1.0]), (None, [1.0, 1.0]), (250, [1.0, 2.0, 3.0]), (3, [0.0, 0.0]), (-50, [1e5, -1e5]), (300, []), (350, [])],
            "empty": []}[case]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score long")
    got = topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 50 == 0, 5).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == plain_top(rows, 5)
    assert len(got) == len(plain_top(rows, 5))


def test_queries_fill_blocks_whatever_the_splits(spark, monkeypatch):
    """40 queries in 13 input partitions are one block and one chain of jobs; small blocks and groups give the same rows."""
    rnd = random.Random(6)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(2000)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score long").repartition(13)
    chains = []
    whole = topk._one_group
    monkeypatch.setattr(topk, "_one_group", lambda blocks, queries, *rest: chains.append(
        queries.select("block").distinct().count()) or whole(blocks, queries, *rest))

    def run():
        got = topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 50 == 0, 5).collect()
        return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got}

    assert run() == plain_top(rows, 5) and chains == [1]
    monkeypatch.setattr(topk, "QUERY_BLOCK", 6)
    monkeypatch.setattr(topk, "GROUP_BLOCKS", 4)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 100)
    chains.clear()
    assert run() == plain_top(rows, 5) and chains == [4, 3]
