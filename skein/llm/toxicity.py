"""Toxic passages as maximum-scoring segments.

Every word has a log-odds score: how much likelier it is in toxic documents.
Counts are smoothed by a chain of Dirichlet priors: a word's prior is what is
known of its first five letters, theirs is that of the first four, theirs the
base rate, so a rare or unseen form of a known stem still counts. A constant
drift makes ordinary text score below zero, and the segments of a text whose
sum no extension or split can better (Ruzzo and Tompa's maximal scoring
subsequences, one linear scan) are its candidate passages. A best segment of
score m among n words of ordinary text follows an extreme-value law, so its
expected number by chance is E = K n exp(-lambda m); lambda and K are fitted
on documents that the counts have not seen. The score of a document is a
logistic function of the evidence of its segments on that scale.

Fitting reads at most ``max_labelled`` labelled rows (by hash order; a
documented bound, so that labels can be broadcast and the word table stays
bounded); rows held out by ``held_out`` are never read. Scoring reads every
whole text, in one pass without a shuffle.

Edge cases: a null or empty text has no words and scores as one without
evidence; null labels or ids are no training rows; an id with several labels
is toxic if one of them is; repeated rows are scored each; without toxic (or
without clean) training rows every score is 0; an empty table gives an empty
result; further input columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.batches import small_batches
from skein.llm.common import materialize

MAX_LABELLED = 60_000
REJECT = 0.7
_WORD = re.compile(r"\w+")
_MARK = regex.compile(r"\p{M}")
_MARKED_WORD = regex.compile(r"[\w\p{M}]+")
_PRIOR = 3.0        # pseudo-documents of a word's prior
_DRIFT = 1.5
_TOP = 6.0
_NO_EVIDENCE = -8.0  # log expected number of a text without a positive word
_CACHE_WORDS = 100_000


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    base: float = 0.0                                     # toxic share of (document, word) pairs
    share: dict[str, float] = field(default_factory=dict)  # of words and, with a leading blank, of stems
    lam: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, float, float] = (-20.0, 0.0, 0.0)
    fitted: bool = False

    def word_score(self, word: str) -> float:
        share = self.share.get(word)
        if share is None:
            share = self.share.get(" " + word[:5], None)
            if share is None:
                share = self.share.get(" " + word[:4], self.base)
        odds = math.log(share / (1 - share)) - math.log(self.base / (1 - self.base))
        return max(-2.0, min(odds, _TOP)) - _DRIFT

    def log_expected(self, score: float, n: int) -> float:
        return self.log_k + math.log(max(n, 1)) - self.lam * score

    def probability(self, best: float, total: float) -> float:
        a, b, c = self.weights
        x = a + b * best + c * total
        return 1 / (1 + math.exp(-x)) if x > -500 else 0.0


def _matches(text: str):
    """The words of a lower-cased text, for fitting and scoring alike: runs of
    letters, digits, underscores and combining marks."""
    marked = not text.isascii() and _MARK.search(text)
    return (_MARKED_WORD if marked else _WORD).finditer(text)


def split_words(text: str) -> list[str]:
    if text.isascii() or not _MARK.search(text):
        return _WORD.findall(text)
    return _MARKED_WORD.findall(text)


class _Scores(dict):
    """Word scores of a model, with a bounded cache."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        s = self[word] = self.model.word_score(word)
        return s


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences (start, end, sum) of a sequence, in linear time."""
    found: list[list[float]] = []  # start, end, total before, total after
    lower: list[int] = []          # of each, the nearest earlier one that begins at a lower total
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = lower[j]
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                lower.append(j)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:], lower[j:]
    return [(int(a), int(b), y - x) for a, b, x, y in found]


def text_segments(text: str, scores: _Scores) -> tuple[int, list[tuple[int, int, float]], np.ndarray]:
    """Number of words, maximal segments (word positions), word scores."""
    words = split_words(text.lower())
    s = np.fromiter(map(scores.__getitem__, words), float, len(words))
    if not len(s) or s.max() <= 0:
        return len(s), [], s
    # runs of one sign act as one item
    sign = s > 0
    starts = np.concatenate([[0], np.nonzero(sign[1:] != sign[:-1])[0] + 1])
    sums = np.add.reduceat(s, starts)
    ends = np.append(starts[1:], len(s))
    return len(s), [(int(starts[a]), int(ends[b - 1]), x) for a, b, x in maximal_segments(sums.tolist())], s


def evidence(model: Model, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, float]:
    """-log expected number of the best segment, and the sum over all that chance would not show (E < 1)."""
    if not segments:
        return _NO_EVIDENCE, 0.0
    each = [-model.log_expected(x, n) for _, _, x in segments]
    return max(_NO_EVIDENCE, min(max(each), 60.0)), min(sum(e for e in each if e > 0), 200.0)


def _shares(counts: dict[str, tuple[int, int]], parent) -> dict[str, float]:
    return {w: (t + _PRIOR * parent(w)) / (t + c + _PRIOR) for w, (t, c) in counts.items()}


def _count(sample: DataFrame) -> tuple[float, dict[str, float]]:
    """Base share and shares of words and stems, from document counts."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                own = sorted(set(split_words(text.lower())))
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(own), pa.int32()), pa.array(own, pa.string())], ["toxic", "w"])

    words = sample.select("toxic", "text").mapInArrow(distinct, "toxic int, w string")
    t, c = F.sum("toxic").cast("long").alias("t"), F.sum(1 - F.col("toxic")).cast("long").alias("c")
    words = materialize(words.groupBy("w").agg(t, c), "tox_words")
    t, c = F.sum("t").cast("long").alias("t"), F.sum("c").cast("long").alias("c")
    total = words.agg(t, c).first()
    if not total["t"] or not total["c"]:
        return 0.0, {}
    base = total["t"] / (total["t"] + total["c"])
    share: dict[str, float] = {}
    long = words.where(F.length("w") >= 4)
    # stems that toxic documents have at least twice as often as chance, and all that hangs on them;
    # the sample is bounded, and so are these tables
    stems4 = long.groupBy(F.substring("w", 1, 4).alias("s")).agg(t, c).where(F.col("t") > 2 * base * (F.col("t") + F.col("c")))
    stems4 = stems4.where("t >= 3")
    four = {r["s"]: (r["t"], r["c"]) for r in stems4.collect()}
    share |= {" " + w: x for w, x in _shares(four, lambda w: base).items()}
    hot = stems4.select(F.col("s").alias("_s"))
    under = long.join(F.broadcast(hot), F.substring("w", 1, 4) == F.col("_s"), "left_semi")
    five = {r["s"]: (r["t"], r["c"]) for r in under.where(F.length("w") >= 5).groupBy(F.substring("w", 1, 5).alias("s")).agg(t, c).collect()}
    share |= {" " + w: x for w, x in _shares(five, lambda w: share.get(" " + w[:4], base)).items()}
    near = lambda w: share.get(" " + w[:5], share.get(" " + w[:4], base))
    own = {r["w"]: (r["t"], r["c"]) for r in under.collect()}
    own |= {r["w"]: (r["t"], r["c"]) for r in words.where((F.col("t") >= 2) | (F.length("w") < 4) & (F.col("t") + F.col("c") >= 5)).collect()}
    own_shares = _shares(own, near)
    return base, share | own_shares


def _fit_law(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1 (scores with a negative mean)."""
    p = counts / counts.sum()
    if scores.max() <= 0 or (p * scores).sum() >= 0:
        return 1.0
    low, high = 0.0, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * scores)).sum() < 1 else (low, mid)
    return max(high, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; slopes are kept from falling below zero."""
    z = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(z.shape[1]), np.array([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        w = w + np.clip(np.linalg.solve(h, z.T @ (y - p) - ridge * w), -5, 5)
    return float(w[0]), max(float(w[1]), 0.0), max(float(w[2]), 0.0)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from at most ``max_labelled`` labelled rows that are not held out."""
    usable = (labels.select(F.col("doc_id").cast("long").alias("_label_id"), F.col("toxic").cast("int").alias("toxic"))
              .where(F.col("_label_id").isNotNull() & F.col("toxic").isin(0, 1)).where(~held_out("_label_id"))
              .groupBy("_label_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("_label_id"), "_label_id").limit(max_labelled))
    chosen = materialize(usable, "tox_labels")  # at most max_labelled rows: 16 bytes each, broadcast
    sample = materialize(
        docs.select(F.col("doc_id").cast("long").alias("_label_id"), F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "_label_id")
        .select("toxic", "text", F.xxhash64("text").alias("_th"), (F.abs(F.xxhash64("_label_id", F.lit(1))) % 3).alias("_fold")),
        "tox_sample")
    small_batches(sample)
    # copies of one text would make all its words look toxic: one stays for the counts
    counted = sample.where("_fold > 0").dropDuplicates(["_th"])
    base, share = _count(counted)
    model = Model(base=base, share=share)
    if not share:
        return model

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(model)
        histogram: dict[float, int] = {}
        for batch in batches:
            out = []
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                n, segments, s = text_segments(text, scores)
                out.append((toxic, n, [x for _, _, x in segments]))
                if not toxic:
                    for v, k in zip(*np.unique(np.round(s, 1), return_counts=True)):
                        histogram[float(v)] = histogram.get(float(v), 0) + int(k)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.list_(pa.float64())))],
                                                 ["toxic", "n", "xs"])
        if histogram:
            yield pa.RecordBatch.from_arrays([pa.array([-1] * len(histogram), pa.int32()), pa.array(list(histogram.values()), pa.int64()),
                                              pa.array([[v] for v in histogram], pa.list_(pa.float64()))], ["toxic", "n", "xs"])

    rows = sample.where("_fold = 0").select("toxic", "text").mapInArrow(measure, "toxic int, n long, xs array<double>").collect()
    tally: dict[float, int] = {}
    for r in rows:
        if r["toxic"] < 0:
            tally[r["xs"][0]] = tally.get(r["xs"][0], 0) + r["n"]
    seen = [(r["toxic"], r["n"], r["xs"]) for r in rows if r["toxic"] >= 0]
    if not tally or not any(t for t, _, _ in seen):
        return Model()
    model.lam = _fit_law(np.array(list(tally)), np.array(list(tally.values()), float))
    chance = [model.lam * max(xs) - math.log(n) for t, n, xs in seen if not t and xs]
    model.log_k = (float(np.mean(chance)) - 0.5772) if len(chance) >= 20 else math.log(0.1)
    x = np.array([evidence(model, n, [(0, 0, v) for v in xs]) for _, n, xs in seen])
    model.weights = _logistic(np.column_stack([x[:, 0], np.log1p(x[:, 1])]), np.array([t for t, _, _ in seen], float))
    model.fitted = True
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, passages: bool = False, prefix: str = "") -> DataFrame:
    """doc_id (or the columns ``keep``), score, n_passages (segments with E < 0.05)
    and, if asked for, passages: their character spans with sum and log E. The
    new columns' names begin with ``prefix``."""
    keep = keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(model)
        for batch in batches:
            ps, ns, spans = [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                if not model.fitted:
                    ps.append(0.0), ns.append(0), spans.append([])
                    continue
                n, segments, _ = text_segments(text, scores)
                best, total = evidence(model, n, segments)
                ps.append(model.probability(best, math.log1p(total)))
                sure = [(a, b, x, model.log_expected(x, n)) for a, b, x in segments if model.log_expected(x, n) < math.log(0.05)]
                ns.append(len(sure))
                if passages and sure:
                    at = [m.span() for m in _matches(text.lower())]
                    spans.append([{"start": at[a][0], "end": at[b - 1][1], "sum": x, "log_e": e} for a, b, x, e in sure])
                else:
                    spans.append([])
            arrays = [batch.column(c) for c in keep] + [pa.array(ps, pa.float64()), pa.array(ns, pa.int64())]
            names = [*keep, f"{prefix}score", f"{prefix}n_passages"]
            if passages:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("sum", pa.float64()), ("log_e", pa.float64())]))
                arrays, names = [*arrays, pa.array(spans, kind)], [*names, f"{prefix}passages"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    cols = list(dict.fromkeys([*keep, "text"]))
    given = small_batches(docs).select(*cols)
    schema = ", ".join([*(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in keep), f"`{prefix}score` double", f"`{prefix}n_passages` long"])
    if passages:
        schema += f", `{prefix}passages` array<struct<start: long, end: long, sum: double, log_e: double>>"
    return given.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages for every document."""
    model = fit(docs, labels, max_labelled)
    return (score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
            .select("doc_id", held_out().alias("held_out"), "score",
                    F.when(F.col("score") >= REJECT, 1).otherwise(0).cast("int").alias("predicted"), "n_passages"))


def keep_clean(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``docs`` without the documents whose score reaches ``REJECT``; all columns."""
    model = fit(docs, labels, max_labelled)
    scored = score(docs, model, list(docs.columns), prefix="_tox_")
    return scored.where(F.col("_tox_score") < REJECT).select(*docs.columns)
