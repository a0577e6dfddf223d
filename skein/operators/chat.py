"""Chat rendering of conversations and training rows.

Template semantics: when the first message (lowest turn) is a system
message, its text + eos starts the rendering and it is skipped afterwards;
otherwise the default system prompt + eos starts it. Then user text as is,
assistant text + eos, every other role (also a later system message)
ignored; optionally a trailing reasoning tag. Each message's piece is
rendered by native expressions before grouping; the per-conversation step
only concatenates pieces in turn order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import prompts as PR


def render_chat(messages: DataFrame, eos: str = PR.EOS_TOKEN, system_prompt: str = PR.SYSTEM_PROMPT,
                add_generation_prompt: bool = False, conv: str = "conv_id", turn: str = "turn",
                role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, text (rendered conversation)."""
    # a system message renders to nothing wherever it stands; the first one is the head
    piece = (F.when(F.col(role) == "user", F.col(text))
             .when(F.col(role) == "assistant", F.concat(F.col(text), F.lit(eos)))
             .otherwise(F.lit("")))
    g = messages.select(conv, turn, role, text, piece.alias("_piece")).groupBy(conv).agg(
        F.array_sort(F.collect_list(F.struct(turn, role, text, "_piece"))).alias("_xs"))
    first = F.col("_xs")[0]
    head = F.when(first[role] == "system", F.concat(first[text], F.lit(eos))).otherwise(F.lit(system_prompt + eos))
    tail = F.lit(PR.REASONING_START if add_generation_prompt else "")
    return g.select(conv, F.concat(head, F.array_join(F.transform("_xs", lambda x: x["_piece"]), ""),
                                   tail).alias("text"))


def sft_messages(examples: DataFrame) -> DataFrame:
    """Training rows: system, user (the prompt), assistant (think block,
    newline, answer block) as three columns."""
    assistant = F.concat(F.lit(PR.REASONING_START), F.col("reasoning"), F.lit(PR.REASONING_END + "\n"),
                         F.lit(PR.SOLUTION_START), F.col("answer"), F.lit(PR.SOLUTION_END))
    return examples.select(F.lit(PR.SYSTEM_PROMPT).alias("system"), F.col("question").alias("user"),
                           assistant.alias("assistant"))


def render_sft(rows: DataFrame, eos: str = PR.EOS_TOKEN) -> Column:
    """The chat rendering of one (system, user, assistant) row."""
    return F.concat(F.col("system"), F.lit(eos), F.col("user"), F.col("assistant"), F.lit(eos))
