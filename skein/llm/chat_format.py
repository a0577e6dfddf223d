"""Chat formatting by incremental black-box rendering.

A template is only a function from a list of messages to a string. To learn
which characters belong to which turn, successive prefixes of a conversation
are rendered and consecutive outputs compared: what prefix k+1 adds to the
output of prefix k is the span of turn k. An output that does not begin with
the one before it shows a template that rewrites its history; the position
where they part is reported, and such conversations are marked.

Rows are shuffled once by conversation, sorted by turn inside the partition
and streamed: a conversation's state is a bounded history of messages plus two
running hashes, never its whole text, if its template is declared append-only
(``append_only = True``: a turn only adds text, which depends on nothing but the
turn itself). Once such a conversation is longer than ``block`` turns its
history is cut to the first and the last few messages, if the cut history
renders the newest turn to the same text. Of any other template whole prefixes
are rendered and compared, however long the conversation is, as one turn shows
nothing about later ones; state is then the conversation and its last output.

Edge cases: a null text or role is empty; a null conv_id is one conversation
of that id; rows with equal (conv_id, turn), repeated ones included, are all
kept, in the order of role, then text; gaps in turn numbers do not matter; an
empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import partitions

Message = tuple[str, str]
Template = Callable[[list[Message]], str]

# control strings of the template, and of other common ones, that texts must not hold
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/ROLE]",
           "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<<SYS>>", "<</SYS>>"]
_TAILS = "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))
_TO_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_TAILS})")
_TO_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_TAILS})")
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?)</s>"
                   r"|\[ROLE\] (?P<role>.*?) \[TEXT\] (?P<text>.*?) \[/ROLE\]", re.S)
BEGIN = "<s>"


def escape(text: str) -> str:
    """Puts one more backslash behind the first character of a control string,
    so no control string is left; ``unescape`` takes it out again."""
    return _TO_ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _TO_UNESCAPE.sub(r"\1\2", text)


def inst_template(messages: list[Message]) -> str:
    """The default template: instructions in [INST], answers up to </s>, any other role named."""
    out = [BEGIN]
    for role, text in messages:
        if role == "user":
            out.append(f"[INST] {escape(text)} [/INST]")
        elif role == "assistant":
            out.append(f" {escape(text)}</s>")
        else:
            out.append(f"[ROLE] {escape(role)} [TEXT] {escape(text)} [/ROLE]")
    return "".join(out)


inst_template.append_only = True


def read_turn(piece: str) -> tuple[str, str, int, int]:
    """role, text, and the span in ``piece`` of the (escaped) text, of one rendered turn."""
    m = _TURN.fullmatch(piece)
    if m is None:
        raise ValueError(f"not one rendered turn: {piece[:80]!r}")
    for role in ("user", "assistant"):
        if m.group(role) is not None:
            return role, unescape(m.group(role)), *m.span(role)
    return unescape(m.group("role")), unescape(m.group("text")), *m.span("text")


class PrefixRenderer:
    """Feeds turns one by one to a black-box template."""

    def __init__(self, template: Template, block: int = 64, overlap: int = 4):
        self.template, self.block, self.overlap = template, block, overlap
        self.append_only = getattr(template, "append_only", False)
        self.history: list[Message] = []
        self.out = template([])
        self.opening = self.out
        self.rewrites = False

    def push(self, message: Message) -> tuple[str, int]:
        """What the turn adds, and how many characters of the former output it takes back."""
        self.history.append(message)
        now = self.template(self.history)
        if now.startswith(self.out):
            kept = len(self.out)
        else:
            self.rewrites = True
            low, kept = 0, min(len(now), len(self.out))
            while low < kept:  # longest common prefix
                mid = (low + kept + 1) // 2
                low, kept = (mid, kept) if now[:mid] == self.out[:mid] else (low, mid - 1)
        piece, lost = now[kept:], len(self.out) - kept
        self.out = now
        if self.append_only and len(self.history) > self.block and not self.rewrites:
            short = self.history[:1] + self.history[-self.overlap:]
            before, after = self.template(short[:-1]), self.template(short)
            if after.startswith(before) and after[len(before):] == piece:
                self.history, self.out = short, after
        return piece, lost


def format_turns(conversations: DataFrame, template: Template = inst_template, block: int = 64) -> DataFrame:
    """One row per turn, in conversation order inside each partition: conv_id,
    position (from 0), piece (what the turn adds to the formatted text),
    start and end (its span there), lost (characters of the earlier output that
    the template rewrote), last. The pieces of a conversation, joined, are its
    formatted text when no turn has lost > 0; the opening of the template is
    part of the first piece."""
    n = partitions(conversations)
    rows = (conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                 F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
            .repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, at, k = None, None, 0, 0
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if state is None or conv != current:
                    state, current, at, k = PrefixRenderer(template, block), conv, 0, 0
                piece, lost = state.push((role, text))
                if k == 0:
                    piece = state.opening + piece
                    lost = 0 if state.out.startswith(state.opening) else lost
                at -= lost
                out.append((conv, k, piece, at, at + len(piece), lost))
                at, k = at + len(piece), k + 1
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                    ["conv_id", "position", "piece", "start", "end", "lost"])

    return rows.mapInArrow(render, "conv_id long, position long, piece string, start long, end long, lost long")


def digest(formatted: DataFrame) -> DataFrame:
    """Reads the formatted pieces back: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, rewritten_turns. The loss mask
    covers the assistants' texts. Takes the rows as ``format_turns`` leaves
    them (a narrow step behind it), with constant state per conversation."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten_turns"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        done: list[tuple] = []
        conv, n, loss, size, rewritten = None, 0, 0, 0, 0
        turns, answers = hashlib.sha256(), hashlib.sha256()

        def close():
            if n:
                done.append((conv, n, turns.hexdigest(), loss, answers.hexdigest(), size, rewritten))

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)
            done.clear()
            return batch

        for batch in batches:
            for c, k, piece, end, lost in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "position", "piece", "end", "lost"))):
                if k == 0:
                    close()
                    conv, n, loss, size, rewritten = c, 0, 0, 0, 0
                    turns, answers = hashlib.sha256(), hashlib.sha256()
                    piece = piece.removeprefix(BEGIN)
                role, text, _, _ = read_turn(piece)
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if role == "assistant":
                    loss += len(text)
                    answers.update(text.encode("utf-8", "surrogatepass"))
                n, size, rewritten = n + 1, end, rewritten + (lost > 0)
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                      "loss_sha256 string, formatted_chars long, rewritten_turns long")
