"""Chat formatting in budgeted windows.

Every turn is rendered as ``<s>role[INST]text[/INST]</s>`` and a line feed.
Control strings inside roles and texts are escaped reversibly: a backslash goes
in after their first character, and one more where backslashes already stand
there, so no escaped text holds a control string and every text comes back.

A conversation becomes windows of at most ``budget`` tokens. Prefix sums of the
turns' tokens choose turn-aligned spans of new turns. A window starts with the
conversation's system turn, then with up to ``history_turns`` earlier turns of
at most ``history_tokens`` tokens; both are repeats and masked. Its loss mask
covers the texts of its new assistant turns, so each assistant text is a
target exactly once. A turn is never cut: one that alone exceeds the budget
has a window of its own (with no history), longer than the budget.

Long conversations are split for the cluster: spans do not cross a multiple of
``TURNS_PER_BLOCK`` turn numbers, each such block is one small group, and the
turns that later blocks repeat are copied to them.

Turns are ordered by (turn, role, text), null turns first. A null role or text
is empty; repeated rows are turns of their own; rows with a null conv_id form
one conversation. The system turn is the first with role ``system``. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET = 2_048
HISTORY_TOKENS = 512
HISTORY_TURNS = 4
TURNS_PER_BLOCK = 256

_CONTROL = re.compile(r"(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\])")
_ESCAPED = re.compile(r"(<)\\(\\*/?s>)|(\[)\\(\\*/?INST\])")
_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: (m[1] or m[4]) + "\\" + (m[2] if m[1] else m[5]) + (m[3] or m[6]), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: (m[1] or m[3]) + (m[2] or m[4]), text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text is inside it."""
    head, body = f"<s>{escape(role)}[INST]", escape(text)
    return f"{head}{body}[/INST]</s>\n", len(head), len(head) + len(body)


def parse(window: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a window."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(window)]


class Turn:
    __slots__ = ("role", "text", "start", "end", "tokens")

    def __init__(self, role: str, text: str):
        self.role = role
        self.text, self.start, self.end = render(role, text)
        self.tokens = 0


def windows(system: Turn | None, history: list[Turn], turns: list[Turn], budget: int, history_tokens: int,
            history_turns: int) -> Iterator[tuple[list[Turn], list[Turn]]]:
    """(repeated turns, new turns) of each window of a block."""
    before = [*history, *turns]
    # Where the system turn stands; a copy of an earlier block's stands before all.
    place = next((n for n, t in enumerate(before) if t is system), -1)
    prefix = np.concatenate([[0], np.cumsum([t.tokens for t in before])])
    i = len(history)
    while i < len(before):
        lead = [system] if system is not None and place < i else []
        room = budget - sum(t.tokens for t in lead)
        # History: the last turns before i, within its own limits and what the first new turn leaves.
        spare = max(0, min(history_tokens, room - before[i].tokens))
        first = max(int(np.searchsorted(prefix, prefix[i] - spare, "left")), i - history_turns, 0)
        past = [t for t in before[first:i] if t is not system]
        room -= sum(t.tokens for t in past)
        end = max(i + 1, int(np.searchsorted(prefix, prefix[i] + room, "right")) - 1)
        yield lead + past, before[i:end]
        i = end


_WINDOW = ("conv_id long, block long, window int, text string, loss array<struct<start:int,end:int>>, "
           "n_context int, n_turns int, n_tokens long")


def _format(path: str, budget: int, history_tokens: int, history_turns: int):
    names = ["conv_id", "block", "window", "text", "loss", "n_context", "n_turns", "n_tokens"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(),
             pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int32(), pa.int32(), pa.int64()]

    def out(key: tuple, rows: list[tuple[int, Turn]]) -> list[tuple]:
        ahead = [t for kind, t in rows if kind == 0]
        own = [t for kind, t in rows if kind == 2]
        system = ahead[0] if ahead else next((t for t in own if t.role == "system"), None)
        made = []
        for n, (past, new) in enumerate(windows(system, [t for kind, t in rows if kind == 1], own, budget,
                                                history_tokens, history_turns)):
            text, loss, at = [], [], 0
            for i, t in enumerate([*past, *new]):
                if i >= len(past) and t.role == "assistant":
                    loss.append({"start": at + t.start, "end": at + t.end})
                text.append(t.text)
                at += len(t.text)
            made.append((*key, n, "".join(text), loss, len(past), len(new), sum(t.tokens for t in [*past, *new])))
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        key, held, made = None, [], []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            cols = batch.to_pydict()
            turns = [Turn(r or "", t or "") for r, t in zip(cols["role"], cols["text"])]
            for at in range(0, len(turns), 256):
                part = turns[at:at + 256]
                for t, e in zip(part, tokenizer.encode_batch_fast([t.text for t in part], add_special_tokens=False)):
                    t.tokens = len(e)
            for conv, block, kind, turn in zip(cols["conv_id"], cols["block"], cols["kind"], turns):
                if key != (conv, block):
                    if held:
                        made += out(key, held)
                    key, held = (conv, block), []
                    if len(made) >= 256:
                        yield batch_of(made)
                        made = []
                held.append((kind, turn))
        if held:
            made += out(key, held)
        if made:
            yield batch_of(made)

    return run


def format_conversations(conversations: DataFrame, vocabulary: str, budget: int = BUDGET,
                         history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """Windows of all conversations (conv_id, turn, role, text): conv_id,
    block, window, text, loss (code point spans), n_context (repeated turns),
    n_turns (new turns), n_tokens. ``vocabulary`` is a tokenizers file."""
    if history_turns >= TURNS_PER_BLOCK:
        raise ValueError(f"history_turns must be below {TURNS_PER_BLOCK}")
    spark = conversations.sparkSession
    block = F.floor(F.col("turn") / TURNS_PER_BLOCK)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    ).withColumn("block", F.coalesce(block, F.lit(-(1 << 62)).cast("long")))
    own = rows.withColumn("kind", F.lit(2))
    history = (rows.where(F.col("turn") >= (F.col("block") + 1) * TURNS_PER_BLOCK - history_turns)
               .withColumns({"block": F.col("block") + 1, "kind": F.lit(1)}))
    # Conversations of several blocks: later blocks get a copy of the first system turn.
    blocks = rows.select("conv_id", "block").distinct()
    several = blocks.groupBy("conv_id").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("hi > lo")
    system = (rows.where("role = 'system'").join(several, rows["conv_id"].eqNullSafe(several["conv_id"]), "left_semi")
              .groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text", "block")).alias("first"))
              .select(F.col("conv_id").alias("c"), "first"))
    later = (blocks.join(system, blocks["conv_id"].eqNullSafe(system["c"]) & (F.col("block") > F.col("first.block")))
             .select("conv_id", F.col("first.turn").alias("turn"), F.col("first.role").alias("role"),
                     F.col("first.text").alias("text"), "block", F.lit(0).alias("kind")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (own.unionByName(history).unionByName(later).repartition(parts, "conv_id", "block")
            .sortWithinPartitions("conv_id", "block", "kind", "turn", "role", "text")
            .mapInArrow(_format(vocabulary, budget, history_tokens, history_turns), _WINDOW))
