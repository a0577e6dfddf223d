import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skein.llm import packing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "ab", "it's", "é", "ß1", "12", " ", " ", "\x1c", "中文", "😀", "<|endoftext|>", "...", "'ll"]),
                         max_size=14).map("".join), min_size=1, max_size=5))
def test_encoder_is_the_vocabulary(encoder, texts):
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [ids(t) for t in texts]


def test_cache_is_emptied(encoder, monkeypatch, words):
    monkeypatch.setattr(packing, "_CACHE_WORDS", 50)
    texts = [" ".join(words[i:i + 90]) for i in range(0, 300, 30)]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [ids(t) for t in texts]


def exact(histogram, planned, capacity):
    held = {}
    for config, copies in planned:
        assert sum(n * k for n, k in config) <= capacity and copies > 0
        for n, k in config:
            held[n] = held.get(n, 0) + k * copies
    return held == histogram


def test_plans_are_exact_and_tight():
    rnd = random.Random(1)
    for size in (1, 5, 300, 20_000):
        histogram = {}
        for _ in range(size):
            n = min(100, int(rnd.expovariate(1 / 25)) + 1)
            histogram[n] = histogram.get(n, 0) + 1
        planned = packing.plan(histogram, 100)
        assert exact(histogram, planned, 100)
        total = sum(n * k for n, k in histogram.items())
        assert sum(c for _, c in planned) <= -(-total // 100) * 1.02 + 1
    assert packing.plan({}, 100) == []
    # where best fit wastes room, the program does not: 51+27+22 fill a sequence
    hard = {51: 600, 27: 600, 26: 600, 23: 600, 25: 600, 48: 600}
    assert sum(c for _, c in packing.plan(hard, 100)) <= sum(packing.best_fit(hard, 100).values())


def test_program_covers_every_length():
    rnd = random.Random(5)
    histogram = {n: rnd.randint(1, 400) for n in range(1, 100)}
    chosen, bound = packing.solve_program(histogram, 100)
    for n, k in histogram.items():
        assert sum(x * dict(config).get(n, 0) for config, x in chosen.items()) >= k * (1 - 1e-6)
    assert all(sum(n * k for n, k in config) <= 100 for config in chosen)
    planned = packing.plan(histogram, 100)
    assert exact(histogram, planned, 100)
    assert bound <= sum(c for _, c in planned) and bound <= sum(chosen.values())
    # what whole configurations of the program hold, before best fit takes the rest
    whole = sum(c * sum(k for _, k in config) for config, c in planned if config in chosen)
    assert whole > 0.5 * sum(histogram.values())
    assert packing.solve_program({}, 100) == ({}, 0.0)


def test_knapsack_is_exact():
    rnd = np.random.default_rng(2)
    lengths, prices = np.array([3, 4, 7, 9]), rnd.random(4)
    best = max(sum(p * k for p, k in zip(prices, ks)) for ks in np.ndindex(8, 6, 4, 3) if np.dot(lengths, ks) <= 23)
    value, config = packing.knapsack(lengths, prices, 23)
    assert abs(value - best) < 1e-9 and sum(n * k for n, k in config) <= 23


def test_pack(spark, words):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices(words, k=rnd.choice([1, 5, 60, 900, 2500]))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, ""), (903, "x" * 9000), (None, "null id"), (0, texts[0])]
    rows += [(1000 + i, "same words here") for i in range(100)]
    df = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id long, text string, length long, rank long")
    got = packing.pack(df).collect()
    want = []
    for i, t in rows:
        x = ids(t) + [0]
        first = len(x) % 2048 or 2048
        cuts = [0, *range(first, len(x) + 1, 2048)] if len(x) > 2048 else [0, len(x)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((i is None, i, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())))
    assert sorted((r["doc_id"] is None, r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(df.limit(0)).count() == 0
