"""Sentence splitting that knows the corpus's abbreviations.

The model is learned without labels from one count over the messages (``stop_counts``)
(Kiss and Strunk, Unsupervised Multilingual Sentence Boundary Detection, 2006):

* a word is an abbreviation when it and a following full stop are a
  collocation: the log-likelihood ratio of P(stop | word) = P(stop) against
  0.99, weighted by its shortness, its inner stops and its uses without a stop;
* a word is a frequent sentence starter when it and a sentence end before it
  are one.

A full stop then ends a sentence unless it belongs to an abbreviation or an
initial (one capital) that no capitalised sentence starter follows. Stops inside a
word (``3.14``, ``e.g.``) never do. The model is a small table: at most
``MAX_WORDS`` abbreviations and starters each, those of the highest scores.

A word is a run of anything but white space, without what stands before its
first and behind its last letter or digit, lower-cased.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import WS
from skein.operators.batches import frugal, pieces, small_batches
from skein.session import materialize

ABBREVIATION_SCORE = 0.3
STARTER_SCORE = 30.0
MAX_WORDS = 10_000
#: what a stop would follow a true abbreviation with
_P_STOP = 0.99
WORD_PARTS = r"^(?s:[^\p{L}\p{N}]*(.*[\p{L}\p{N}])([^\p{L}\p{N}]*))$"
_PARTS = regex.compile(WORD_PARTS)
_END = re.compile(rf"[.!?]+[\"'”’)\]]*(?=[{WS}]|$)")
_SPACE = re.compile(rf"[{WS}]+")


@dataclass(frozen=True)
class SentenceModel:
    abbreviations: frozenset[str]
    starters: frozenset[str]


def stop_counts(msgs: DataFrame) -> DataFrame:
    """w, stop, next, n: how often each word comes with (or without) one full stop right
    behind it; with one, by the word after it (null: none), else ``next`` is null.

    The texts are read once: tokens are counted as they stand (one that may end in
    a stop next to its successor), and only different ones are taken apart."""
    tokens = F.filter(F.split("body", f"[{WS}]+"), lambda t: t.rlike(r"[\p{L}\p{N}]"))
    listed = msgs.where(F.col("body").isNotNull()).select(tokens.alias("ts"))
    pairs = F.transform("ts", lambda t, i: F.struct(t.alias("t"), F.when(t.contains("."), F.get("ts", i + 1)).alias("after")))
    # outer: from a plain explode the planner infers a filter that splits every text once more
    raw = listed.select(F.explode_outer(pairs).alias("x")).select("x.*").where("t is not null").groupBy("t", "after").agg(F.count(F.lit(1)).alias("n"))

    def word(t: str) -> Column:
        return F.lower(F.regexp_extract(t, WORD_PARTS, 1))

    apart = raw.select(word("t").alias("w"), F.regexp_extract("t", WORD_PARTS, 2).rlike(r"^\.([^.]|$)").alias("stop"), word("after").alias("next"), "n")
    return apart.groupBy("w", "stop", F.when(F.col("stop"), F.col("next")).alias("next")).agg(F.sum("n").alias("n"))


def _ln(x: Column) -> Column:
    """x ln(x), for counts and shares that may be zero, comes as n * _ln(p): 0 where n is."""
    return F.when(x > 0, F.log(x)).otherwise(F.lit(0.0))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """w, n_stop (times with a full stop), n (times), score of every word with a letter that has a stop somewhere.
    ``counts``: the table of ``stop_counts``."""
    per_word = counts.groupBy("w").agg(F.sum(F.when(F.col("stop"), F.col("n")).otherwise(F.lit(0))).alias("n_stop"), F.sum("n").alias("n"))
    total = per_word.agg(F.sum("n").alias("_all"), F.sum("n_stop").alias("_stops"))  # one row
    words = per_word.where((F.col("n_stop") > 0) & F.col("w").rlike(r"\p{L}")).withColumn("_one", F.lit(1))
    x = words.join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one")
    p, bare = F.col("_stops") / F.col("_all"), F.col("n") - F.col("n_stop")
    inner = F.length("w") - F.length(F.translate("w", ".", ""))
    letters = F.length("w") - inner
    apart = F.col("n_stop") * _ln(p) + bare * _ln(1 - p)
    bound = F.col("n_stop") * F.log(F.lit(_P_STOP)) + bare * F.log(F.lit(1 - _P_STOP))
    score = -2 * (apart - bound) * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -bare.cast("double"))
    return x.select("w", "n_stop", "n", score.alias("score"))


def abbreviations(counts: DataFrame) -> DataFrame:
    """w of every abbreviation, however many there are. ``counts``: the table of ``stop_counts``."""
    return abbreviation_scores(counts).where(F.col("score") >= ABBREVIATION_SCORE).select("w")


def starter_scores(counts: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """w, n_after (times after a sentence end), n, score of every word that is
    more frequent after a sentence end than elsewhere. ``counts``: the table of
    ``stop_counts``; ``abbreviations``: w, any number of rows."""
    # no broadcast by hint: they grow with the vocabulary, so their measured size decides
    ends = counts.where(F.col("stop") & (F.length("w") > 1)).join(abbreviations.select("w"), "w", "left_anti")
    after = ends.where("next is not null").groupBy(F.col("next").alias("w")).agg(F.sum("n").alias("n_after"))
    every = counts.groupBy("w").agg(F.sum("n").alias("n"))
    totals = every.agg(F.sum("n").alias("_all")).withColumn("_one", F.lit(1))
    breaks = after.agg(F.sum("n_after").alias("_breaks")).withColumn("_one", F.lit(1))
    x = (after.where(F.col("w").rlike(r"\p{L}")).join(every, "w").withColumn("_one", F.lit(1))
         .join(F.broadcast(totals), "_one").join(F.broadcast(breaks), "_one"))
    a, b, ab, n = F.col("_breaks"), F.col("n"), F.col("n_after"), F.col("_all")
    p, p1, p2 = b / n, ab / a, F.when(n > a, (b - ab) / (n - a)).otherwise(F.lit(0.0))
    rest = n - a - b + ab

    def likely(times: Column, others: Column, share: Column) -> Column:
        return times * _ln(share) + others * _ln(1 - share)

    score = -2 * (likely(ab, a - ab, p) + likely(b - ab, rest, p) - likely(ab, a - ab, p1) - likely(b - ab, rest, p2))
    return x.where(ab * n > a * b).select("w", "n_after", "n", score.alias("score"))


def _best(scores: DataFrame, least: float) -> DataFrame:
    return scores.where(F.col("score") >= least).orderBy(F.col("score").desc(), "w").limit(MAX_WORDS)


def learn(msgs: DataFrame) -> SentenceModel:
    """The model of the messages (body); nulls and empty texts say nothing."""
    spark = msgs.sparkSession
    counts = materialize(stop_counts(msgs), "stop_counts")
    found = [r["w"] for r in _best(abbreviation_scores(counts), ABBREVIATION_SCORE).select("w").collect()]
    known = spark.createDataFrame([(w,) for w in found], "w string")
    starters = [r["w"] for r in _best(starter_scores(counts, known), STARTER_SCORE).select("w").collect()]
    return SentenceModel(frozenset(found), frozenset(starters))


def _word(token: str) -> tuple[str, str]:
    """The word of a token, and what stands behind it."""
    m = _PARTS.match(token)
    return (m[1], m[2]) if m else ("", token)


def _goes_on(text: str, start: int, end: int, model: SentenceModel) -> bool:
    """Whether the full stop that closes the token text[start:end] is part of it."""
    word, behind = _word(text[start:end])
    if not word or behind[:1] != "." or behind[1:2] in (".", "!", "?"):
        return False
    if word.lower() not in model.abbreviations and not (len(word) == 1 and word.isupper()):
        return False
    m = _SPACE.match(text, end)
    after = text[m.end():] if m else ""
    token = _SPACE.split(after, maxsplit=1)[0] if after else ""
    follows = _word(token)[0].lower()
    first = next((c for c in token if c.isalnum()), "")
    return not (first.isupper() and follows in model.starters)


def split_sentences(text: str, model: SentenceModel) -> list[str]:
    """The sentences of a text in order, trimmed; pieces without anything but
    end marks and white space are none."""
    out, start = [], 0
    for m in _END.finditer(text):
        begin = max((s.end() for s in _SPACE.finditer(text, start, m.start())), default=start)
        if _goes_on(text, begin, m.end(), model):
            continue
        out.append(text[start:m.end()])
        start = m.end()
    out.append(text[start:])
    trimmed = (re.sub(rf"^[{WS}.!?]+|[{WS}]+$", "", s) for s in out)
    return [s for s in trimmed if s]


def with_sentences(msgs: DataFrame, model: SentenceModel, text: str = "body") -> DataFrame:
    """``msgs`` with ``sents``: the sentences of the column ``text`` (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b, text)):
            sents = [split_sentences(t or "", model) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sents, pa.list_(pa.string()))], [*batch.schema.names, "sents"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in msgs.schema.fields)
    return small_batches(msgs).mapInArrow(frugal(run), schema + ", sents array<string>")
