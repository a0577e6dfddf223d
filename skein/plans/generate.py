"""Job B: thread rows -> generation requests; responses -> training examples
and retrieval corpus.

B1: shuffle, sample, oracle flag, question requests.
B2 (after the model answered into tables): parse, first valid attempt,
outcome rules, answer requests, distractors, prompts, examples, corpus.

For the registered queries the model answers come from ``derived_responses``:
a deterministic responses table built from the thread ids and the
``documents`` text (one of six response shapes per attempt), and question
embeddings are looked up in the ``embeddings`` table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schemas
from skein.functions.text import SENTENCE_PATTERN
from skein.operators import dataset, sampling
from skein.plans import build_threads as bt
from skein.session import materialize, stage_run
from skein.sources import files
from skein.sources.tables import table


@dataclass(frozen=True)
class GenParams:
    p: float = 1.0
    num_distractors: int = 2
    num_questions: int = 1
    num_discussions: int | None = None
    seed: int = sampling.DEFAULT_SEED


def thread_table(spark: SparkSession, sf_dir: str, p: bt.ThreadParams = bt.ThreadParams()) -> DataFrame:
    """Job A output as a stage table (read by several steps of job B)."""
    posts, replies = bt.filtered_forest(spark, sf_dir, p.min_score)
    return materialize(bt.build_threads(posts, replies, p), "threads")


def sampled_threads(threads: DataFrame, g: GenParams) -> DataFrame:
    """Threads with ``idx`` (shuffle position), ``n_total`` and ``include_oracle``."""
    indexed = sampling.dense_index(threads, "id", g.seed)
    if g.num_discussions:
        indexed = sampling.dense_index(sampling.sample_n(indexed, g.num_discussions).drop("idx", "n_total"),
                                       "id", g.seed)
    return sampling.oracle_flags(indexed, g.p, seed2=g.seed)


def requests(sampled: DataFrame, g: GenParams) -> DataFrame:
    return sampled.select(F.col("id").alias("thread_id"),
                          F.explode(F.sequence(F.lit(0), F.lit(g.num_questions - 1))).alias("j"))


def _doc_of(thread_id: Column) -> Column:
    return F.substr(thread_id, F.lit(4)).cast("long")


def derived_responses(spark: SparkSession, sf_dir: str, reqs: DataFrame) -> DataFrame:
    """A responses table (thread_id, j, stage, attempt, text) derived from the
    request keys and the document text of the thread's focus message."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id"),
        F.regexp_extract_all("text", F.lit(SENTENCE_PATTERN), 0).alias("ss"),
        F.col("text").alias("head"))
    # the question is the j-th sentence (around the end), the reasoning the whole text
    docs = docs.withColumn("n_s", F.size("ss"))
    r = reqs.withColumn("doc_id", _doc_of(F.col("thread_id"))).join(docs, "doc_id")
    r = r.withColumn("s1", F.when(F.col("n_s") > 0, F.get("ss", (F.col("j") % F.col("n_s")).cast("int"))).otherwise(F.lit(""))).drop("ss")
    d, j = F.col("doc_id"), F.col("j").cast("long")
    q_att = r.select("thread_id", "j", "s1", "head", d.alias("d"), j.alias("jj"),
                     F.explode(F.sequence(F.lit(0).cast("long"), (d + j) % 3)).alias("a"))
    v = (F.col("d") + 2 * F.col("jj") + F.col("a")) % 6
    q_text = (F.when(v == 0, F.concat(F.lit("<question>\n"), F.col("s1"), F.lit("\n</question>")))
              .when(v == 1, F.lit("Sorry, I can't help with that."))
              .when(v == 2, F.lit("```xml\n<question>\n</question>\n```"))
              .when(v == 3, F.concat(F.lit("<question>\n"), F.col("s1")))
              .when(v == 4, F.concat(F.lit("```xml\n<question>\n"), F.col("s1"), F.lit("\n```")))
              .otherwise(F.concat(F.lit("<question>"), F.col("s1"), F.lit("</question>\n"))))
    qs = q_att.select("thread_id", "j", F.lit("question").alias("stage"), F.col("a").cast("int").alias("attempt"),
                      q_text.alias("text"))
    a_att = r.select("thread_id", "j", "s1", "head", d.alias("d"), j.alias("jj"),
                     F.explode(F.sequence(F.lit(0).cast("long"), (d + j + 1) % 3)).alias("a"))
    u = (F.col("d") + F.col("jj") + F.col("a")) % 4
    a_text = (F.when(u == 0, F.concat(F.lit("<analysis>\n"), F.col("head"), F.lit("\n</analysis>\n<answer>\n"),
                                      F.col("s1"), F.lit("\n</answer>")))
              .when(u == 1, F.lit("no analysis here"))
              .when(u == 2, F.concat(F.lit("<analysis>\n"), F.col("head"), F.lit("\n</analysis>\n"), F.col("s1")))
              .otherwise(F.concat(F.lit("<analysis>\n\n</analysis>\n<answer>\n"), F.col("s1"),
                                  F.lit("\n</answer>"))))
    ans = a_att.select("thread_id", "j", F.lit("answer").alias("stage"), F.col("a").cast("int").alias("attempt"),
                       a_text.alias("text"))
    return qs.unionByName(ans)


def derived_embeddings(spark: SparkSession, sf_dir: str, reqs: DataFrame) -> DataFrame:
    """Question embeddings: row vec_id = doc + j of the ``embeddings`` table
    (absent rows play the part of a failed embedding call)."""
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embeddings"))
    k = reqs.withColumn("vec_id", _doc_of(F.col("thread_id")) + F.col("j"))
    return k.join(e, "vec_id").select("thread_id", "j", "embeddings")


@dataclass
class GenOutputs:
    sampled: DataFrame
    status: DataFrame      # per (thread_id, j): status + parsed fields + embeddings
    rows: DataFrame        # ok rows with everything that is known of them
    prompts: DataFrame     # ok rows with prompt
    examples: DataFrame
    corpus: DataFrame


def generate_derived(spark: SparkSession, sf_dir: str, threads: DataFrame, g: GenParams = GenParams()) -> GenOutputs:
    """Job B with the responses and embeddings that are derived from the given tables."""
    sampled = materialize(sampled_threads(threads, g), "sampled")
    reqs = requests(sampled, g)
    return generate(sampled, derived_responses(spark, sf_dir, reqs), derived_embeddings(spark, sf_dir, reqs), g)


def generate(sampled: DataFrame, resp: DataFrame, emb: DataFrame, g: GenParams = GenParams()) -> GenOutputs:
    """Job B2. ``sampled``: the table of ``sampled_threads`` (the one that the
    requests were made from); ``resp``: thread_id, j, stage, attempt, text;
    ``emb``: thread_id, j, embeddings of the questions."""
    n_rows = sampled.count()
    sampling.check_distractors(g.num_distractors, n_rows)
    reqs = requests(sampled, g)
    # read by several steps below, most of them for its keys alone
    status = materialize(dataset.outcomes(reqs, resp, emb), "outcomes")
    ok = (status.where(F.col("status") == "ok")
          .join(sampled.select(F.col("id").alias("thread_id"), "include_oracle", "full_thread"), "thread_id"))
    prompts = dataset.assemble_prompts(ok.select("thread_id", "j", "question", "include_oracle"),
                                       sampled.select("id", "full_thread", "idx", "n_total"),
                                       g.num_distractors, g.seed)
    full = prompts.join(ok.select("thread_id", "j", "reasoning", "answer", "embeddings", "full_thread"),
                        ["thread_id", "j"])
    examples = full.select(F.col("prompt").alias("question"), "reasoning", "answer")
    corpus = full.select(F.col("thread_id").alias("id"), F.col("question").alias("query"),
                         F.col("full_thread").alias("thread"), "embeddings")
    return GenOutputs(sampled, status, full, prompts, examples, corpus)


def write_requests(spark: SparkSession, threads_path: str, out_path: str, g: GenParams = GenParams(),
                   system: str | None = None) -> None:
    """Job B1 on paths: a thread table -> ``out_path``/sampled (Parquet) and ``out_path``/requests (JSON lines)."""
    with stage_run(spark):
        sampled_threads(files.read_threads(spark, threads_path), g).write.mode("overwrite").parquet(f"{out_path}/sampled")
    sampled = spark.read.parquet(f"{out_path}/sampled")
    asked = dataset.question_requests(sampled, g.num_questions)
    files.write_json(dataset.with_system(asked, system) if system else dataset.with_system(asked), f"{out_path}/requests")


def write_dataset(spark: SparkSession, sampled_path: str, responses_path: str, embeddings_path: str, out_path: str,
                  g: GenParams = GenParams(), test_fraction: float = 0.0) -> None:
    """Job B2 on paths: sampled threads, responses (JSON lines) and question
    embeddings (Parquet) -> ``out_path``/examples (shuffled, a folder for each
    split) and ``out_path``/corpus, as JSON lines."""
    with stage_run(spark):
        out = generate(spark.read.parquet(sampled_path), files.read_json(spark, responses_path, schemas.RESPONSES),
                       spark.read.parquet(embeddings_path), g)
        rows = materialize(out.rows, "dataset_rows")
        keyed = rows.withColumn("row_id", F.concat_ws(":", "thread_id", "j"))
        split = sampling.split_labels(sampling.dense_index(keyed, "row_id", g.seed), test_fraction)
        files.write_ascii_json(split.orderBy("idx").select("split", F.col("prompt").alias("question"), "reasoning", "answer"),
                               f"{out_path}/examples", by="split")
        files.write_json(rows.select(F.col("thread_id").alias("id"), F.col("question").alias("query"),
                                     F.col("full_thread").alias("thread"), "embeddings"), f"{out_path}/corpus")
