"""Rounds of generation attempts on paths: what is still to be asked.

A model's answers arrive as files of responses, in any order, with repeats and
gaps. A *round* is the set of requests that the responses so far call for: for each
thread and question number the question stage until a well-formed question is
there, then the answer stage until a well-formed answer is, at most
``MAX_ATTEMPTS`` times each, with the request's text. A blank question,
reasoning or answer ends its thread: later question numbers are not asked.

Requests are kept in a ledger (``sources.batches``: one batch a round). A
request that is in the ledger is not written again, so running a round twice,
or after a stop, changes nothing; what was asked and not answered can be read
back with ``pending``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein import schemas
from skein.functions import prompts as PR
from skein.operators import dataset
from skein.sources import batches, files

KEY = ["thread_id", "j", "stage", "attempt"]
ROUNDS = T.StructType([T.StructField("round", T.IntegerType()), *schemas.RESPONSES.fields[:4],
                       T.StructField("system", T.StringType()), T.StructField("request", T.StringType())])


def _tried(responses: DataFrame, stage: str) -> DataFrame:
    """thread_id, j, next: the smallest attempt number without a response, null when all were used."""
    every = F.sequence(F.lit(0), F.lit(PR.MAX_ATTEMPTS - 1))
    return (responses.where((F.col("stage") == stage) & F.col("attempt").between(0, PR.MAX_ATTEMPTS - 1)).groupBy("thread_id", "j")
            .agg(F.collect_set("attempt").alias("_done"))  # at most MAX_ATTEMPTS
            .select("thread_id", "j", F.get(F.array_except(every, F.col("_done")), F.lit(0)).alias("next"), F.lit(True).alias("tried")))


def open_requests(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """thread_id, j, stage, attempt, question (null at the question stage) of
    everything that is to be asked, given the responses so far.

    ``requests``: thread_id, j. Of repeated responses to one attempt the
    smallest text counts."""
    r = responses.groupBy(*KEY).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    q = dataset.first_valid(r, "question").select("thread_id", "j", F.col("matched").alias("q_ok"), "question")
    a = dataset.first_valid(r, "answer").select("thread_id", "j", F.col("matched").alias("a_ok"), "reasoning", "answer")
    tried = {s: _tried(r, s).withColumnsRenamed({"next": f"{s}_next", "tried": f"{s}_tried"}) for s in ("question", "answer")}
    x = requests.select("thread_id", "j")
    for side in (q, a, *tried.values()):
        x = x.join(side, ["thread_id", "j"], "left")
    q_ok, a_ok = F.coalesce("q_ok", F.lit(False)), F.coalesce("a_ok", F.lit(False))
    blank = (q_ok & (F.col("question") == "")) | (q_ok & a_ok & ((F.col("reasoning") == "") | (F.col("answer") == "")))
    # a thread's question numbers are few; only the first blank one matters
    ends = x.where(blank).groupBy("thread_id").agg(F.min("j").alias("_end"))

    def following(stage: str):
        return F.when(F.col(f"{stage}_tried"), F.col(f"{stage}_next")).otherwise(F.lit(0))

    stage = F.when(~q_ok, F.lit("question")).when((F.col("question") != "") & ~a_ok, F.lit("answer"))
    attempt = F.when(F.col("stage") == "question", following("question")).otherwise(following("answer"))
    return (x.join(ends, "thread_id", "left").where(F.col("_end").isNull() | (F.col("j") <= F.col("_end")))
            .withColumn("stage", stage).withColumn("attempt", attempt.cast("int"))
            .where(F.col("stage").isNotNull() & F.col("attempt").isNotNull())
            .select(*KEY, F.when(F.col("stage") == "answer", F.col("question")).alias("question")))


def with_texts(asked: DataFrame, threads: DataFrame, num_questions: int, instructions: list[str] | None = None) -> DataFrame:
    """The open requests with the user message of each."""
    keys = [F.col(c) for c in KEY]
    q = (asked.where("stage = 'question'").select(*keys)
         .join(dataset.question_requests(threads, num_questions, instructions), ["thread_id", "j"]))
    own = asked.where("stage = 'answer'")
    a = own.select(*keys).join(dataset.answer_requests(threads, own.select("thread_id", "j", "question"), instructions), ["thread_id", "j"])
    return q.unionByName(a)


def _responses(spark: SparkSession, path: str) -> DataFrame:
    try:
        return files.read_json(spark, path, schemas.RESPONSES)
    except AnalysisException as e:  # nothing was answered yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.RESPONSES)


def write_round(spark: SparkSession, sampled_path: str, responses_path: str, ledger_path: str, num_questions: int = 1,
                system: str = PR.DEFAULT_GEN_SYSTEM) -> int | None:
    """Write the next round of requests and return its number (from 1), or None
    when the responses so far call for nothing that was not asked before.

    ``sampled_path``: the table of ``write_requests``; ``responses_path``: JSON
    lines, added to by whatever answers."""
    threads = spark.read.parquet(sampled_path)
    every = threads.select(F.col("id").alias("thread_id"), F.explode(F.sequence(F.lit(0), F.lit(num_questions - 1))).alias("j"))
    ledger = batches.read_batches(spark, ledger_path, ROUNDS, "json").select("round", *KEY)
    new = open_requests(every, _responses(spark, responses_path)).join(ledger, KEY, "left_anti")
    if not new.take(1):
        return None
    number = max((int(b) for b in batches.committed(spark, ledger_path)), default=0) + 1
    rows = dataset.with_system(with_texts(new, threads, num_questions), system).withColumn("round", F.lit(number))
    batches.write_batch(rows.select(*ROUNDS.fieldNames()), ledger_path, str(number), "json")
    return number


def read_round(spark: SparkSession, ledger_path: str, number: int) -> DataFrame:
    """The requests of one round: round, thread_id, j, stage, attempt, system, request."""
    return batches.read_batches(spark, ledger_path, ROUNDS, "json", [str(number)])


def pending(spark: SparkSession, responses_path: str, ledger_path: str) -> DataFrame:
    """Requests of all rounds that have no response yet."""
    asked = batches.read_batches(spark, ledger_path, ROUNDS, "json")
    return asked.join(_responses(spark, responses_path).select(*KEY), KEY, "left_anti")
