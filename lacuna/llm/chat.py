"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, only its text is trainable.
Turns after the last assistant turn form one example without a target, so nothing of a conversation is lost.

A turn is written as ``### role``, a line break, the text, ``</turn>`` and a line break. Control strings inside texts
and roles are escaped with a backslash, backslashes too, so they never look like marks and the text
comes back exactly. Rows of a conversation are read in order of turn from a sorted partition; the task holds one
growing prefix and no list of turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import batch_of

ASSISTANT = "assistant"
HEAD, TAIL = "### ", "</turn>"
_CONTROL = re.compile(r"\\|</turn>|### ")
_ESCAPED = re.compile(r"\\(\\|</turn>|### |n)")
_MARK = re.compile(r"\\.|</turn>\n", re.DOTALL)
#: Characters of examples in one batch, about.
BATCH_CHARS = 4 << 20

EXAMPLES = "conv_id long, example int, n_turns long, target long, text string, loss_start long, loss_end long"
_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("example", pa.int32()), ("n_turns", pa.int64()), ("target", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]
)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def _role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The written turn and the span of its text within."""
    head = f"{HEAD}{_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{TAIL}\n", len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn, unescaped."""
    out, at = [], 0
    while at < len(text):
        end = _turn_end(text, at)
        head, body = text[at + len(HEAD) : end].split("\n", 1)
        role = _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], head)
        out.append((role, unescape(body[: -len(TAIL) - 1])))
        at = end
    return out


def _turn_end(text: str, at: int) -> int:
    """Position behind the unescaped end mark of the turn that starts at ``at``."""
    for m in _MARK.finditer(text, at):
        if m[0][0] != "\\":
            return m.end()
    raise ValueError("a turn without an end mark")


def examples(
    convs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, example, n_turns, target, text, loss_start, loss_end), consecutive and in order within a partition.

    ``n_turns`` counts the turns in the example, ``target`` is the index of the trainable one (from 0; null in an
    example without), the loss span are code points of ``text``, end exclusive. Null texts and roles are empty;
    only the role ``assistant`` is trainable. Equal turn numbers are ordered by role and text, a null turn comes first,
    rows with a null conversation form one. Repeated rows are repeated turns.
    """
    rows = convs.select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").drop("turn")
    return ordered.mapInArrow(_expand, EXAMPLES)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    size = 0
    conv: object = ()
    prefix, turns, made, open_turns = "", 0, 0, False

    def tail() -> None:
        if open_turns:
            out.append((conv, made, turns, None, prefix, None, None))

    for b in batches:
        for c, role, text in zip(*(b.column(x).to_pylist() for x in ("conv", "role", "text")), strict=True):
            if c != conv or conv == ():
                tail()
                conv, prefix, turns, made, open_turns = c, "", 0, 0, False
            written, start, end = format_turn(role, text)
            at = len(prefix)
            prefix += written
            turns += 1
            open_turns = role != ASSISTANT
            if not open_turns:
                out.append((conv, made, turns, turns - 1, prefix, at + start, at + end))
                made += 1
                size += len(prefix)
            if size > BATCH_CHARS:
                yield batch_of(_SCHEMA, zip(*out, strict=True))
                out, size = [], 0
    tail()
    if out:
        yield batch_of(_SCHEMA, zip(*out, strict=True))


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
_READ = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in READ.split(", ")])


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted texts and masks alone.

    Turns come from the parsed texts (a later example adds the turns that earlier ones did not have), the loss
    from the text under every mask. ``formatted`` is as ``examples`` returns it: the examples of a
    conversation are consecutive and in order.
    """
    return formatted.select("conv_id", "text", "loss_start", "loss_end").mapInArrow(_read, READ)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    conv: object = ()
    state: dict = {}

    def close() -> None:
        if conv != ():
            out.append((conv, state["turns"], state["turn_hash"].hexdigest(), state["loss"], state["loss_hash"].hexdigest(), state["chars"], state["examples"]))

    for b in batches:
        for c, text, start, end in zip(*(b.column(x).to_pylist() for x in ("conv_id", "text", "loss_start", "loss_end")), strict=True):
            if c != conv or conv == ():
                close()
                conv = c
                state = dict(turns=0, turn_hash=hashlib.sha256(), loss=0, loss_hash=hashlib.sha256(), chars=0, examples=0, seen=0)
            for role, said in parse(text[state["seen"] :]):
                state["turn_hash"].update(f"{role}\n{said}\n".encode())
                state["turns"] += 1
            state["seen"] = len(text)
            state["chars"] += len(text)
            state["examples"] += 1
            if start is not None:
                masked = unescape(text[start:end])
                state["loss"] += len(masked)
                state["loss_hash"].update(masked.encode())
        if out:
            yield batch_of(_READ, zip(*out, strict=True))
            out = []
    close()
    if out:
        yield batch_of(_READ, zip(*out, strict=True))
