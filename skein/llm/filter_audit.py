"""How filters interact: what each removes in every order, and its fair share.

Every document gets the set of filters that it fails, as a bit mask. Only the
number of documents of each mask (at most 32 for each part of the corpus)
matters from there on. In the removal game a coalition S of filters is worth
v(S), the number of documents that fail at least one of them:

* a step of an order that applies filter f after the filters S removes
  v(S + f) - v(S);
* the potential of Hart and Mas-Colell is P(empty) = 0 and
  P(S) = (v(S) + sum of P(S - i) over i in S) / |S|, computed coalition by
  coalition; the Shapley value of f is P(all) - P(all - f). Here it is carried
  times 120 (the number of orders), which keeps it an integer throughout.

The five filters (words are runs of anything but blanks, case-sensitive):
A fewer than 200 words; B fewer than half of the words distinct; C over 2 % of
the code points in A-Z; D any of ``#$%&*|``; E the text of a smaller id.

Words are told apart by 64-bit hashes, texts by SHA-256. Only ids, parts, masks and digests are shuffled;
a text that a third of all rows share is counted within each task first, and
the rows that carry its smallest id are found by an equi-join on digest and id.

Edge cases: a null text is empty (fails A); a null part is the empty string; a
null id is no smaller id of anything and fails E never; rows of one id are
counted each, and equal texts of one id do not make each other fail E; a
document without a label, or with a null in it, is neither good nor toxic, and
labels of one id count together (any 1); an empty table gives an empty result;
further input columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.batches import small_batches
from skein.llm.common import materialize
from skein.llm.words import BEGINS, byte_class, counts, groups, words

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITALS_PERCENT = 2
_CAPITAL = byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SIGN = byte_class("#$%&*|")
_DUPLICATE = 1 << FILTERS.index("E")
_ALL = (1 << len(FILTERS)) - 1
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def own_failures(rows: DataFrame) -> DataFrame:
    """``rows`` (_id, part, digest, raw) with the mask of the filters A to D,
    which look at one text only, in place of the bytes ``raw``."""

    def run(batches):
        for batch, raw, at in groups(batches, "raw"):
            _, _, hashes, first = words(raw, at)
            n = np.diff(first)
            distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist())])
            fails = [n < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * n,
                     100 * counts(_CAPITAL[raw], at) > CAPITALS_PERCENT * counts(BEGINS[raw], at), counts(_SIGN[raw], at) > 0]
            mask = sum(f.astype(np.int32) << i for i, f in enumerate(fails))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "part", "digest")), pa.array(mask, pa.int32())],
                                             ["_id", "part", "digest", "mask"])

    return small_batches(rows).mapInArrow(run, "_id long, part string, digest binary, mask int")


def failures(docs: DataFrame, labels: DataFrame, part: str = "source", id_col: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic: the number of documents of each failure mask."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = own_failures(docs.select(
        F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), F.encode(text, "UTF-8").alias("raw")))
    known = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id"))
             .agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
                  F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")))
    zero = F.lit(0)
    # one row for each (id, text, part): spread by id, so copies of one text do not meet here
    seen = materialize(
        rows.join(known, "_id", "left").groupBy("_id", "digest", "part", "mask")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", zero)).alias("good"),
             F.sum(F.coalesce("toxic", zero)).alias("toxic")), "failures")
    first = seen.where("_id is not null").groupBy("digest").agg(F.min("_id").alias("_id"))
    kept = seen.join(first, ["digest", "_id"], "left_semi").unionByName(seen.where("_id is null").select("digest", "_id", *seen.columns[2:]))

    def summed(df: DataFrame, mask: Column, sign: int) -> DataFrame:
        sums = df.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
        return sums.select("part", mask.alias("mask"), *[(sign * F.col(c)).alias(c) for c in ("n", "good", "toxic")])

    # those that fail E: all, less those that carry the smallest id
    again = F.col("mask") + F.lit(_DUPLICATE)
    every = summed(seen, again, 1).unionByName(summed(kept, again, -1)).unionByName(summed(kept, F.col("mask"), 1))
    return every.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]).where("n > 0")


def _worth(column: str) -> str:
    """SQL: for each coalition, the documents that fail one of its filters."""
    return (f"transform(sequence(0, {_ALL}), s -> aggregate(masks, 0L, "
            f"(a, x) -> a + if((x.mask & s) != 0, x.{column}, 0L)))")


def audit(masks: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley of the mask counts of ``failures``."""
    bits = "array(" + ", ".join(str(1 << i) for i in range(len(FILTERS))) + ")"
    games = (masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most 32
             .select("part", F.expr("aggregate(masks, 0L, (a, x) -> a + x.n)").alias("total"),
                     *[F.expr(_worth(c)).alias(f"v_{c}") for c in ("n", "good", "toxic")]))
    potential = (f"aggregate(sequence(1, {_ALL}), array(0L), (p, s) -> concat(p, array("
                 f"({len(ORDERS)}L * v_n[s] + aggregate({bits}, 0L, (a, b) -> a + if((s & b) != 0, p[s ^ b], 0L))) div bit_count(s))))")
    steps = (games.withColumn("potential", F.expr(potential))
             .withColumn("filter_order", F.explode(F.lit(ORDERS)))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
             .withColumn("before", F.expr(f"aggregate(slice(split(filter_order, ''), 1, step - 1), 0, (a, x) -> a | shiftleft(1, instr('{FILTERS}', x) - 1))"))
             .withColumn("own", F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, step, 1)) - 1)"))
             .withColumn("after", F.expr("before | own")))
    return steps.select(
        "part", "filter_order", "step", F.expr("total - v_n[after]").alias("kept"),
        F.expr("v_n[after] - v_n[before]").alias("removed"), F.expr("v_n[own] - (v_n[after] - v_n[before])").alias("redundant"),
        F.expr(f"v_n[{_ALL}] - v_n[{_ALL} ^ own]").alias("unique_fails"),
        F.expr("v_good[after] - v_good[before]").alias("good_lost"), F.expr("v_toxic[after] - v_toxic[before]").alias("toxic_lost"),
        F.expr(f"potential[{_ALL}] - potential[{_ALL} ^ own]").alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The audit of the five filters over every part of ``docs``."""
    return audit(failures(docs, labels, part, id_col))
