"""Data set assembly: generation requests, response parsing, outcome rules,
prompt assembly, examples and the retrieval corpus.

The model is outside the job: job B1 writes ``requests`` (one row per
thread, question number and stage); whatever answers them writes a
``responses`` table (thread_id, j, stage, attempt, text) and an embeddings
table; job B2 parses, selects, samples distractors and assembles. Every
per-key group is bounded (attempts <= 5 per (thread, j, stage), m + 1
threads per prompt).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import prompts as PR
from skein.operators import sampling

# all blanks of Unicode, as a class that Java and RE2 read alike
_BLANK = r"[\t-\r\x1C- \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WS_STRIP = rf"^{_BLANK}+|{_BLANK}+\z"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, WS_STRIP, "")


def user_prompt(thread: Column, context: Column) -> Column:
    """The thread framed for the model; a different frame when a context exists
    (a non-empty context; null/empty means the focus is a post)."""
    with_ctx = F.concat(F.lit(PR.CONTEXT_FRAME_HEAD), context, F.lit(PR.CONTEXT_FRAME_MID), thread,
                        F.lit(PR.FRAME_TAIL))
    plain = F.concat(F.lit(PR.PLAIN_FRAME_HEAD), thread, F.lit(PR.FRAME_TAIL))
    return F.when(context.isNotNull() & (context != ""), with_ctx).otherwise(plain)


def question_requests(threads: DataFrame, num_questions: int = 1,
                      instructions: list[str] | None = None) -> DataFrame:
    """thread_id, j, request (user message of the question stage)."""
    qp = PR.QUESTION_PROMPT + PR.extra_instructions(instructions or [])
    return threads.select(
        F.col("id").alias("thread_id"),
        F.explode(F.sequence(F.lit(0), F.lit(num_questions - 1))).alias("j"),
        F.concat(F.lit(qp + "\n\n"), user_prompt(F.col("subthread"), F.col("subthread_context"))).alias("request"))


def with_system(requests: DataFrame, system: str = PR.DEFAULT_GEN_SYSTEM) -> DataFrame:
    """Requests with the system message that goes before the user's."""
    return requests.withColumn("system", F.lit(system))


def answer_requests(threads: DataFrame, questions: DataFrame, instructions: list[str] | None = None) -> DataFrame:
    """thread_id, j, request (user message of the answer stage) for parsed,
    non-blank questions (``questions``: thread_id, j, question)."""
    ap = PR.ANSWER_PROMPT + PR.extra_instructions(instructions or [])
    q = questions.where(F.col("question") != "")
    t = threads.select(F.col("id").alias("thread_id"), "subthread", "subthread_context")
    return q.join(t, "thread_id").select(
        "thread_id", "j",
        F.concat(F.lit(ap + "\n\n"), user_prompt(F.col("subthread"), F.col("subthread_context")),
                 F.lit("\n\nHere is the question:\n```xml\n<question>\n"), F.col("question"),
                 F.lit("\n</question>\n```")).alias("request"))


def parse_question(text: Column) -> tuple[Column, Column]:
    """(matched, question stripped)."""
    matched = F.coalesce(text.contains("<question>"), F.lit(False))
    return matched, strip(F.regexp_extract(text, PR.QUESTION_RE, 1))


def parse_answer(text: Column) -> tuple[Column, Column, Column]:
    """(matched, reasoning stripped, answer stripped)."""
    matched = F.coalesce(text.rlike(PR.ANSWER_MATCH_RE), F.lit(False))
    return (matched, strip(F.regexp_extract(text, PR.ANSWER_RE, 1)),
            strip(F.regexp_extract(text, PR.ANSWER_RE, 2)))


def first_valid(responses: DataFrame, stage: str) -> DataFrame:
    """First well-formed response of at most MAX_ATTEMPTS per (thread_id, j)
    for one stage: thread_id, j, attempts, matched, and the parsed fields.
    ``min_by`` keeps the aggregation partial (no sort, bounded state)."""
    r = responses.where((F.col("stage") == stage) & (F.col("attempt") < PR.MAX_ATTEMPTS))
    if stage == "question":
        m, q = parse_question(F.col("text"))
        parsed = r.select("thread_id", "j", "attempt", m.alias("ok"), F.struct(q.alias("question")).alias("v"))
    else:
        m, rs, an = parse_answer(F.col("text"))
        parsed = r.select("thread_id", "j", "attempt", m.alias("ok"),
                          F.struct(rs.alias("reasoning"), an.alias("answer")).alias("v"))
    good = F.when(F.col("ok"), F.col("attempt"))
    g = parsed.groupBy("thread_id", "j").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.min(good).alias("first_ok"),
        F.min_by(F.col("v"), F.when(F.col("ok"), F.col("attempt"))).alias("v"))
    return g.select("thread_id", "j", F.col("first_ok").isNotNull().alias("matched"), "first_ok", "v.*")


def outcomes(requests: DataFrame, responses: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Status per (thread_id, j): ok | failed | skipped.

    Rules: no well-formed question or answer -> failed (go on with the next
    j); a blank question, reasoning or answer -> skipped, and every later j of
    the same thread is dropped; no embedding for the question -> failed.
    ``requests``: thread_id, j. ``embeddings``: thread_id, j, embeddings.
    """
    q = first_valid(responses, "question").select(
        "thread_id", "j", F.col("matched").alias("q_ok"), "question")
    a = first_valid(responses, "answer").select(
        "thread_id", "j", F.col("matched").alias("a_ok"), "reasoning", "answer")
    e = embeddings.select("thread_id", "j", F.lit(True).alias("has_emb"), "embeddings")
    x = (requests.select("thread_id", "j").join(q, ["thread_id", "j"], "left")
         .join(a, ["thread_id", "j"], "left").join(e, ["thread_id", "j"], "left"))
    q_ok = F.coalesce(F.col("q_ok"), F.lit(False))
    a_ok = F.coalesce(F.col("a_ok"), F.lit(False))
    blank_q = F.col("question") == ""
    status = (F.when(~q_ok, "failed")
              .when(blank_q, "skipped")
              .when(~a_ok, "failed")
              .when((F.col("reasoning") == "") | (F.col("answer") == ""), "skipped")
              .when(F.col("has_emb").isNull(), "failed")
              .otherwise("ok"))
    x = x.withColumn("status", status)
    # a skip ends the thread: drop later question numbers (bounded window per thread)
    w = Window.partitionBy("thread_id").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    earlier_skip = F.max(F.when(F.col("status") == "skipped", 1).otherwise(0)).over(w)
    return (x.withColumn("_dropped", F.coalesce(earlier_skip, F.lit(0)) == 1)
            .where(~F.col("_dropped")).drop("_dropped"))


def assemble_prompts(ok: DataFrame, threads_indexed: DataFrame, m: int,
                     seed: int | str = sampling.DEFAULT_SEED) -> DataFrame:
    """Prompt per ok (thread_id, j): distractor threads plus the oracle thread
    when ``include_oracle``, shuffled by a seeded key, numbered from 1.

    ``ok``: thread_id, j, question, include_oracle. ``threads_indexed``: id,
    full_thread, idx, n_total (dense index of the sampled threads).
    """
    req = ok.select(F.col("thread_id").alias("id"), "j")
    d = sampling.distractors(threads_indexed, req, m, seed)
    picks = d.select(F.col("id").alias("thread_id"), "j", F.col("distractor_id").alias("src")).unionByName(
        ok.where("include_oracle").select("thread_id", "j", F.col("thread_id").alias("src")))
    # one join for all texts
    texts = threads_indexed.select(F.col("id").alias("src"), F.col("full_thread").alias("t"))
    items = picks.join(texts, "src").withColumn(
        "key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("thread_id"), F.col("j").cast("string"),
                                 F.col("src"))))
    g = items.groupBy("thread_id", "j").agg(F.array_sort(F.collect_list(F.struct("key", "src", "t"))).alias("xs"))
    body = F.array_join(F.transform(
        "xs", lambda x, i: F.concat(F.lit("<thread"), (i + 1).cast("string"), F.lit(">\n"), x["t"],
                                    F.lit("\n</thread"), (i + 1).cast("string"), F.lit(">\n\n"))), "")
    prompts = g.select("thread_id", "j", body.alias("ctx"))
    return (ok.join(prompts, ["thread_id", "j"], "left")
            .withColumn("prompt", F.concat(F.coalesce("ctx", F.lit("")), F.lit("Question: "), F.col("question")))
            .drop("ctx"))

