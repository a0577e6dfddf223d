"""Extractive summaries, one pass per message.

Word weights: word counts of the letters-only text (stop words removed,
case kept) divided by the message's largest count. Sentence score: sum of
the weights of its lower-cased words, summed over every occurrence of the
same sentence text. Picking order: unscored sentences first, then score
descending, then position; sentences are taken while the running token total
stays within the cap (token counts are positive, so "stop at the first that
does not fit" is the same as a search in the running totals). The summary is
the picked sentences in original order joined by one space.

A message is one row and everything here depends on that row alone, so
nothing is shuffled: sentences and their token counts come from native
expressions, counting and ranking is a small function over Arrow batches, of
which it takes about a megabyte of text at a time.
"""

from __future__ import annotations

import collections
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.counters import Counter
from skein.functions.text import LETTER_RUN, SENTENCE_WORD, STOP_WORDS, json_string, sentences, string_tokens
from skein.operators.batches import frugal, pieces, small_batches
from skein.operators.sentence_model import SentenceModel, with_sentences

_LETTERS = re.compile(LETTER_RUN)
_WORDS = re.compile(SENTENCE_WORD)
_STOP = frozenset(STOP_WORDS)


def word_counts(text: str) -> collections.Counter:
    return collections.Counter(w for w in _LETTERS.findall(text) if w not in _STOP)


def rank_sentences(text: str, sents: list[str], toks: list[int], unscored: str = "first") -> list[tuple[int, int | None, int, int]]:
    """(position, score numerator, largest word count, running total), best first;
    sentences without a score go first or last.

    All weights of a message share the denominator, so the order by the sum of
    counts is the order by the score without rounding noise."""
    counts = word_counts(text)
    top = max(counts.values(), default=0)
    total: dict[str, int | None] = {}
    for s, times in collections.Counter(sents).items():
        hits = [counts[w] for w in _WORDS.findall(s.lower()) if w in counts]
        total[s] = times * sum(hits) if hits else None
    late = unscored == "last"
    order = sorted(range(len(sents)), key=lambda i: ((total[sents[i]] is None) == late, -(total[sents[i]] or 0), i))
    out, run = [], 0
    for i in order:
        run += toks[i]
        out.append((i, total[sents[i]], top, run))
    return out


def _with_sentences(msgs: DataFrame, counter: Callable[[Column], Column] | Counter, model: SentenceModel | None, *more: str) -> DataFrame:
    """The sentences of each message (by the fixed pattern, or by a ``model``) and
    their token counts, or the JSON literals that a ``Counter`` is yet to count
    (``_tokens``)."""
    listed = small_batches(msgs).select("msg_id", F.coalesce("body", F.lit("")).alias("body"), *more)
    listed = with_sentences(listed, model) if model else listed.withColumn("sents", sentences(F.col("body")))
    return listed.withColumn("toks", F.transform("sents", json_string if isinstance(counter, Counter) else counter))


def _tokens(counter: Callable[[Column], Column] | Counter, toks: list[list]) -> list[list[int]]:
    if not isinstance(counter, Counter):
        return toks
    counts = iter(counter.count([t for own in toks for t in own]))
    return [[next(counts) for _ in own] for own in toks]


def _rows(batch: pa.RecordBatch, *names: str):
    return zip(*(batch.column(n).to_pylist() for n in names))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema.names)


def word_weights(msgs: DataFrame) -> DataFrame:
    """msg_id, word, n, max_n, weight = n / max_n (max_n: largest count of the message)."""
    schema = pa.schema([("msg_id", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("max_n", pa.int64()), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b, "body")):
            rows = []
            for m, body in _rows(batch, "msg_id", "body"):
                counts = word_counts(body or "")
                top = max(counts.values(), default=0)
                rows += [(m, w, n, top, n / top) for w, n in counts.items()]
            if rows:
                yield _batch(rows, schema)

    return small_batches(msgs).select("msg_id", "body").mapInArrow(frugal(run), "msg_id string, word string, n long, max_n long, weight double")


def ranked_sentences(msgs: DataFrame, counter: Callable[[Column], Column] | Counter = string_tokens, unscored: str = "first",
                     model: SentenceModel | None = None) -> DataFrame:
    """msg_id, i (position from 0), sent, tok, score_n, score, srank (picking
    order from 1), run (running token total) of the messages (msg_id, body)."""
    schema = pa.schema([("msg_id", pa.string()), ("i", pa.int32()), ("sent", pa.string()), ("tok", pa.int64()),
                        ("score_n", pa.int64()), ("score", pa.float64()), ("srank", pa.int32()), ("run", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b, "body")):
            rows = []
            counts = _tokens(counter, batch.column("toks").to_pylist())
            for (m, body, sents), toks in zip(_rows(batch, "msg_id", "body", "sents"), counts):
                for k, (i, n, top, total) in enumerate(rank_sentences(body, sents, toks, unscored), 1):
                    rows.append((m, i, sents[i], toks[i], n, None if n is None else n / top, k, total))
            if rows:
                yield _batch(rows, schema)

    return _with_sentences(msgs, counter, model).mapInArrow(
        frugal(run), "msg_id string, i int, sent string, tok long, score_n long, score double, srank int, run long")


def summaries(capped: DataFrame, counter: Callable[[Column], Column] | Counter = string_tokens, unscored: str = "first",
              model: SentenceModel | None = None) -> DataFrame:
    """msg_id, cap, k (sentences that fit), summary for each cap of the messages (msg_id, body, caps)."""
    schema = pa.schema([("msg_id", pa.string()), ("cap", pa.int64()), ("k", pa.int64()), ("summary", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b, "body")):
            rows = []
            counts = _tokens(counter, batch.column("toks").to_pylist())
            for (m, body, caps, sents), toks in zip(_rows(batch, "msg_id", "body", "caps", "sents"), counts):
                ranked = rank_sentences(body, sents, toks, unscored)
                runs = [r[3] for r in ranked]
                for cap in sorted(set(caps)):
                    k = bisect_right(runs, cap)
                    rows.append((m, cap, k, " ".join(sents[i] for i in sorted(r[0] for r in ranked[:k]))))
            if rows:
                yield _batch(rows, schema)

    return _with_sentences(capped, counter, model, "caps").mapInArrow(frugal(run), "msg_id string, cap long, k long, summary string")
