"""Operator 9: chat formatting by a declarative template.

A template names the roles, what stands before and after a turn of each, whether its text is learnt
from, and which role may follow which. Conversations are dealt by id and sorted by turn; each task
streams through its conversations, runs the automaton over the roles and emits the segments of each
turn with a loss flag, so that a conversation of any length takes bounded memory. Control strings
inside texts are escaped by one more backslash between ``<`` and ``|``, which can be undone.

Defined results: null text or role counts as empty; turns are ordered by turn (nulls first), then
role and text; repeated rows are turns of their own; a null conversation id is one conversation;
a conversation whose roles break the automaton is still formatted, and marked ``valid = false`` from
the first turn that breaks it on; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ``follows`` lists, for each role, the roles that may stand before it ("" is the beginning).
TEMPLATE = {
    "before": "<|im_start|>{role}\n",
    "after": "<|im_end|>\n",
    "learn": ["assistant"],
    "follows": {"system": [""], "user": ["", "system", "assistant", "tool"], "assistant": ["user", "tool"], "tool": ["assistant"]},
}
SEGMENTS = "conv_id long, position long, role string, valid boolean, segments array<struct<text:string,loss:boolean>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _safe_role(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_back(text: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(text))


def _segments(batches: Iterator[pa.RecordBatch], template: dict) -> Iterator[pa.RecordBatch]:
    current, position, state, valid = object(), 0, "", True
    for batch in batches:
        rows = []
        for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if conv != current:
                current, position, state, valid = conv, 0, "", True
            valid = valid and state in template["follows"].get(role, ())
            parts = [(template["before"].format(role=_safe_role(role)), False), (escape(text), role in template["learn"]), (template["after"], False)]
            rows.append((conv, position, role, valid, [{"text": t, "loss": x} for t, x in parts]))
            state, position = role, position + 1
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "position", "role", "valid", "segments"])


def format_chats(conversations: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """A row for each turn, in order within its partition: the text segments to write, each with
    its loss flag, and whether the roles so far are in order."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn").alias("turn")
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(lambda b: _segments(b, template), SEGMENTS)


class _Reader:
    """Reads one conversation back from its segments, turn by turn."""

    def __init__(self, conv: int | None, template: dict):
        self.conv, self.turns, self.loss_chars, self.chars, self.valid = conv, 0, 0, 0, True
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        head, tail = template["before"].split("{role}")
        self.pattern = re.compile(f"(?s){re.escape(head)}(.*?){re.escape(tail)}(.*){re.escape(template['after'])}")

    def read(self, segments: list[dict], valid: bool) -> None:
        written = "".join(s["text"] for s in segments)
        role, text = self.pattern.fullmatch(written).groups()
        learnt = "".join(unescape(s["text"]) for s in segments if s["loss"])
        self.all.update(f"{_role_back(role)}\n{unescape(text)}\n".encode())
        self.loss.update(learnt.encode())
        self.turns, self.chars, self.loss_chars = self.turns + 1, self.chars + len(written), self.loss_chars + len(learnt)
        self.valid = self.valid and valid

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid


def _digests(batches: Iterator[pa.RecordBatch], template: dict) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in DIGESTS.split(", ")]

    def out(rows):
        columns = list(zip(*rows)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    reader = None
    for batch in batches:
        rows = []
        for conv, position, valid, segments in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4))):
            if position == 0:
                if reader:
                    rows.append(reader.row())
                reader = _Reader(conv, template)
            reader.read(segments, valid)
        yield out(rows)
    if reader:
        yield out([reader.row()])


def read_back(turns: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Digests of each conversation as read back from what ``format_chats`` returned. The frame must be as it was
    returned, or written and read file by file: a conversation's turns in one partition, one after another in order."""
    return turns.mapInArrow(lambda b: _digests(b, template), DIGESTS)
