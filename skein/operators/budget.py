"""Token budgets of thread views.

Totals are computed from per-message token counts (no rendering needed): for
the built-in token counter the token count of a rendered JSON document is the
sum of its values' counts plus a fixed count per key, brace, bracket and comma.
For other counters, whose tokens may cross from a message to what is around
it, a message's record and body are kept as mergeable summaries
(``functions.counters``) and a thread's totals are merged from those: each
message is counted once, whatever the number of threads that hold it, and
each view may have a counter of its own.

Water-filling (the stepwise levelling of the longest messages) has a closed
form: with counts sorted descending t1 >= ... >= tn, budget B and prefix sums
P_k, the level is L = max_k (B - (S - P_k)) / k, and each message's cap is
max(1, floor(min(t_i, L))). Messages whose cap equals their count are left
alone; the others are summarised down to the cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import counters
from skein.functions.counters import SUMMARY_ARROW, SUMMARY_TYPE, Counter
from skein.functions.text import json_string

PLACEHOLDER_TOK = 5     # tokens of the JSON string "..."
COMMENTS_KEY_TOK = 7    # , "comments": [ ]
WRAPPER_TOK = 6         # {"post": ... }


def check_limits(*limits: int, minimum: int = 1000) -> None:
    for v in limits:
        if v < minimum:
            raise ValueError(f"token limits must be at least {minimum}, got {v}")


def thread_totals(long_tok: DataFrame) -> DataFrame:
    """Per focus: ft_total (full thread JSON), gen_total (generation view: whole
    document for a post, context + subthread for a reply) and text_total.

    ``long_tok``: focus_id, kind, head_tok, tok_body.
    """
    kind = F.col("kind")
    rec = F.col("head_tok") + F.col("tok_body")
    g = long_tok.groupBy("focus_id").agg(
        F.sum(F.when(kind == "ancestor", 1).otherwise(0)).alias("n_anc"),
        F.sum(F.when(kind == "reply", 1).otherwise(0)).alias("n_rep"),
        F.sum(F.when(kind == "ancestor", rec + COMMENTS_KEY_TOK).otherwise(0)).alias("anc_tok"),
        F.sum(F.when(kind == "reply", rec).otherwise(0)).alias("rep_tok"),
        F.max(F.when(kind == "focus", F.col("head_tok"))).alias("focus_head"),
        F.max(F.when(kind == "focus", F.col("tok_body"))).alias("focus_body"),
        F.sum("tok_body").alias("text_total"),
    )
    sub = (F.col("focus_head") + F.col("focus_body") + COMMENTS_KEY_TOK + F.col("rep_tok")
           + F.col("n_rep") - 1)
    ft = WRAPPER_TOK + F.col("anc_tok") + sub
    ctx = WRAPPER_TOK + F.col("anc_tok") + F.col("focus_head") + PLACEHOLDER_TOK
    gen = F.when(F.col("n_anc") == 0, ft).otherwise(ctx + sub)
    return g.select("focus_id", ft.cast("long").alias("ft_total"), gen.cast("long").alias("gen_total"),
                    F.col("text_total").cast("long"))


def waterfill_caps(msgs: DataFrame, group_cols: list[str]) -> DataFrame:
    """Caps per message of each over-budget group.

    ``msgs``: group_cols..., msg_id, tok, budget (the text budget B of the group).
    Returns msgs + ``level`` and ``cap``. Windows are per group (a bounded
    number of messages: ancestors + focus + top-k replies).
    """
    w_sorted = Window.partitionBy(*group_cols).orderBy(F.col("tok").desc(), F.col("msg_id"))
    w_all = Window.partitionBy(*group_cols)
    x = (msgs.withColumn("_k", F.row_number().over(w_sorted))
         .withColumn("_prefix", F.sum("tok").over(w_sorted.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("_S", F.sum("tok").over(w_all)))
    x = x.withColumn("_g", (F.col("budget") - (F.col("_S") - F.col("_prefix"))) / F.col("_k"))
    x = x.withColumn("level", F.max("_g").over(w_all))
    cap = F.greatest(F.lit(1).cast("long"), F.floor(F.least(F.col("tok").cast("double"), F.col("level"))).cast("long"))
    return x.withColumn("cap", cap).drop("_k", "_prefix", "_S", "_g")


VIEWS = ("ft", "gen")


def message_counts(records: DataFrame, ft: Counter, gen: Counter) -> DataFrame:
    """msg_id and for each view v: v_head, v_body (summaries of the record up to
    its body, and of the body's JSON literal) and v_tok (the literal's count).
    ``records``: msg_id, head, body."""
    schema = "msg_id string, " + ", ".join(f"{v}_head {SUMMARY_TYPE}, {v}_body {SUMMARY_TYPE}, {v}_tok long" for v in VIEWS)
    names = ["msg_id", *(f"{v}_{c}" for v in VIEWS for c in ("head", "body", "tok"))]

    def packed(found: list) -> pa.Array:
        return pa.array([dict(zip(("left", "inner", "right"), s)) for s in found], SUMMARY_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, bodies = (batch.column(c).to_pylist() for c in ("head", "literal"))
            columns, done = [batch.column("msg_id")], {}
            for counter in (ft, gen):
                if counter not in done:
                    head, body = counters.summaries(heads, counter), counters.summaries(bodies, counter)
                    done[counter] = [packed(head), packed(body), pa.array(counters.totals([[b] for b in body], counter), pa.int64())]
                columns += done[counter]
            yield pa.RecordBatch.from_arrays(columns, names)

    return records.select("msg_id", "head", json_string(F.col("body")).alias("literal")).mapInArrow(run, schema)


def _document(parts: list[dict], view: str, fixed: dict[str, counters.Summary], body_of_focus: bool = True, replies: bool = True) -> list:
    """The summaries of a whole document in order. ``parts``: a focus's messages by pos."""
    def summary(x: dict) -> counters.Summary:
        return x["left"], x["inner"], x["right"]

    out, n_anc = [fixed['{"post": ']], 0
    for p in parts:
        if p["kind"] == "ancestor":
            out += [summary(p[f"{view}_head"]), summary(p[f"{view}_body"]), fixed[', "comments": [']]
            n_anc += 1
        elif p["kind"] == "focus":
            out += [summary(p[f"{view}_head"]), *([summary(p[f"{view}_body"])] if body_of_focus else [fixed['"..."}']])]
    if replies:
        out += _replies(parts, view, fixed, summary)
    return out + [fixed["]}"]] * n_anc + [fixed["}"]]


def _replies(parts: list[dict], view: str, fixed: dict[str, counters.Summary], summary) -> list:
    out = [fixed[', "comments": [']]
    for k, p in enumerate(p for p in parts if p["kind"] == "reply"):
        out += [*([fixed[", "]] if k else []), summary(p[f"{view}_head"]), summary(p[f"{view}_body"]), fixed["}"]]
    return [*out, fixed["]}"]]


_FIXED = ['{"post": ', ', "comments": [', '"..."}', "]}", "}", ", "]


def totals_of_parts(long: DataFrame, ft: Counter, gen: Counter) -> DataFrame:
    """focus_id, ft_total, gen_total, ft_text, gen_text: as ``thread_totals``, each
    view by its own counter (``*_text``: the sum of its messages' counts).

    ``long``: focus_id, kind, pos and the columns of ``message_counts``."""
    columns = [f"{v}_{c}" for v in VIEWS for c in ("head", "body", "tok")]
    grouped = long.groupBy("focus_id").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", *columns))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = {c: dict(zip(_FIXED, counters.summaries(_FIXED, c))) for c in (ft, gen)}
        for batch in batches:
            groups = batch.column("parts").to_pylist()
            full = counters.totals([_document(g, "ft", fixed[ft]) for g in groups], ft)
            views = []  # a post's generation view is one document, a reply's are its context and itself
            for g in groups:
                focus = next(p for p in g if p["kind"] == "focus")
                if any(p["kind"] == "ancestor" for p in g):
                    own = [tuple(focus[f"gen_{c}"].values()) for c in ("head", "body")]
                    sub = [*own, *_replies(g, "gen", fixed[gen], lambda x: (x["left"], x["inner"], x["right"]))]
                    views += [_document(g, "gen", fixed[gen], False, False), sub]
                else:
                    views += [_document(g, "gen", fixed[gen]), []]
            gens = counters.totals(views, gen)
            yield pa.RecordBatch.from_arrays(
                [batch.column("focus_id"), pa.array(full, pa.int64()), pa.array([a + b for a, b in zip(gens[::2], gens[1::2])], pa.int64()),
                 *(pa.array([sum(p[f"{v}_tok"] for p in g) for g in groups], pa.int64()) for v in VIEWS)],
                ["focus_id", "ft_total", "gen_total", "ft_text", "gen_text"])

    return grouped.mapInArrow(run, "focus_id string, ft_total long, gen_total long, ft_text long, gen_text long")
