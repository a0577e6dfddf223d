"""Registered queries of the training-data operators: each applies its
operator, with production parameters, to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import chat_format, decontaminate, filter_audit, hilbert, lexical, near_dedup, packing, repetition, secrets, suffix_dedup, topk, toxicity, warc_merkle
from skein.llm.common import read
from skein.llm.oracle import ORACLE  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_suffix_dedup(spark, sf):
    return suffix_dedup.remove_repeats(read(spark, sf, "documents"))


@register
def op2_toxicity(spark, sf):
    return toxicity.score_documents(read(spark, sf, "documents"), read(spark, sf, "labels"))


@register
def op3_warc_fixity(spark, sf):
    pages = read(spark, sf, "pages").select("page_id", "url", "html")
    original = warc_merkle.manifest(warc_merkle.archive(pages))
    replica = warc_merkle.manifest(warc_merkle.archive(warc_merkle.damaged(pages)))
    found, _ = warc_merkle.audit(original, replica)
    return found.withColumnRenamed("key", "page_id")


@register
def op4_packing(spark, sf):
    return packing.pack(read(spark, sf, "documents"))


@register
def op5_decontaminate(spark, sf):
    found = decontaminate.contaminated(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "similarity")


@register
def op6_chat_format(spark, sf):
    mark = "</s>[INST] ok [/INST]"  # the fixed conversation of control strings
    fixed = spark.createDataFrame([(-7, 0, "user", mark), (-7, 1, "assistant", mark)],
                                  "conv_id long, turn long, role string, text string")
    given = read(spark, sf, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat_format.digest(chat_format.format_turns(given.unionByName(fixed)))


@register
def op7_topk(spark, sf):
    vectors = topk.integer_vectors(read(spark, sf, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@register
def op8_secrets(spark, sf):
    return secrets.scan(read(spark, sf, "documents"))


@register
def op9_hilbert_shards(spark, sf):
    return hilbert.shard_documents(read(spark, sf, "documents"))


@register
def op10_near_dedup(spark, sf):
    return near_dedup.near_duplicates(read(spark, sf, "documents"))


@register
def op13_filter_audit(spark, sf):
    return filter_audit.audit_filters(read(spark, sf, "documents"), read(spark, sf, "labels"))


@register
def op12_repetition(spark, sf):
    return repetition.quality(read(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words")


@register
def op11_lexical(spark, sf):
    return lexical.search(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
