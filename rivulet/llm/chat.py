"""Chat formatting that is reparsed and escaped until it says what the source says."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rivulet.llm.common import in_small_batches

# The grammar: a conversation is a row of turns, and a turn is
#   <s> mark text </s>
# whose mark is [INST] (user), [/INST] (assistant), [SYS] (system) or
# [ROLE] name [/ROLE] for any other role.
OPEN, CLOSE = "<s>", "</s>"
MARKS = {"user": "[INST]", "assistant": "[/INST]", "system": "[SYS]"}
ROLE_OPEN, ROLE_CLOSE = "[ROLE]", "[/ROLE]"
LEARNED_ROLE = "assistant"

_BODIES = "|".join(re.escape(c[1:]) for c in (OPEN, CLOSE, *MARKS.values(), ROLE_OPEN, ROLE_CLOSE))
# A control string, or one that backslashes behind its first character disarm.
_ARMED = re.compile(rf"([<\[])({_BODIES})")
_ESCAPABLE = re.compile(rf"([<\[])(\\*)({_BODIES})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_BODIES})")
_ROLES = {mark: role for role, mark in MARKS.items()}
# Characters of finished conversations that are handed on together.
_FLUSH_CHARS = 4 << 20


class Turn(NamedTuple):
    role: str
    text: str


def escape(content: str) -> str:
    """One more backslash into everything that is, or unescapes to, a control string."""
    return _ESCAPABLE.sub(r"\1\\\2\3", content)


def unescape(content: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", content)


def render(turns: list[Turn], escaped: set[int]) -> tuple[str, list[tuple[int, int]]]:
    """The text of the turns, those in ``escaped`` disarmed, and the spans to learn."""
    out, spans, at = [], [], 0
    for i, turn in enumerate(turns):
        role, text = turn
        if i in escaped:
            role, text = escape(role), escape(text)
        head = OPEN + (MARKS.get(turn.role) or ROLE_OPEN + role + ROLE_CLOSE)
        if turn.role == LEARNED_ROLE:
            spans.append((at + len(head), at + len(head) + len(text)))
        out += (head, text, CLOSE)
        at += len(head) + len(text) + len(CLOSE)
    return "".join(out), spans


def parse(rendered: str) -> list[Turn] | None:
    """The turns of a rendered text by the grammar; None if it does not follow it."""
    pieces, controls, end = [], [], 0
    for match in _ARMED.finditer(rendered):
        pieces.append(rendered[end : match.start()])
        controls.append(match.group())
        end = match.end()
    pieces.append(rendered[end:])
    turns, i = [], 0
    while i < len(controls):
        if controls[i] != OPEN or pieces[i] or i + 1 >= len(controls) or pieces[i + 1]:
            return None
        mark = controls[i + 1]
        if mark == ROLE_OPEN:
            if i + 3 >= len(controls) or controls[i + 2] != ROLE_CLOSE or controls[i + 3] != CLOSE:
                return None
            turns.append(Turn(unescape(pieces[i + 2]), unescape(pieces[i + 3])))
            i += 4
        elif mark in _ROLES:
            if i + 2 >= len(controls) or controls[i + 2] != CLOSE:
                return None
            turns.append(Turn(_ROLES[mark], unescape(pieces[i + 2])))
            i += 3
        else:
            return None
    return None if pieces[-1] else turns


def format_turns(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """Render, reparse, and escape what does not come back: nothing at first, then
    the turns that fail by themselves, then all."""
    escaped: set[int] = set()
    rendered, spans = render(turns, escaped)
    if parse(rendered) != turns:
        escaped = {i for i, t in enumerate(turns) if parse(render([t], set())[0]) != [t]}
        rendered, spans = render(turns, escaped)
        if parse(rendered) != turns:
            rendered, spans = render(turns, set(range(len(turns))))
            if parse(rendered) != turns:
                raise ValueError("the grammar cannot express these turns")
    return rendered, spans


def format_conversations(df: DataFrame) -> DataFrame:
    """A row for each conv_id of (conv_id, turn, role, text): conv_id, n_turns,
    formatted, and the learned spans loss_starts and loss_ends in code points.

    Turns are ordered by turn (null first), then role, then text, so ties and repeated
    rows have a place; each repeated row is a turn. Null text is empty text, null role
    an empty role name, rows without conv_id are one conversation. An empty table
    gives no rows; other columns are ignored. Conversations are dealt by conv_id and
    stream through the tasks in order: a task holds one conversation, which is one row
    of the result anyway.
    """
    in_small_batches(df.sparkSession)
    turns = (
        df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type, rows, held = None, [], 0

        def streamed() -> Iterator[tuple[object, str, str]]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field(0).type
                yield from zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)))

        def flushed() -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["conv_id", "n_turns", "formatted", "loss_starts", "loss_ends"]
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for conv_id, group in groupby(streamed(), key=lambda r: r[0]):
            own = [Turn(role, text) for _, role, text in group]
            formatted, spans = format_turns(own)
            rows.append((conv_id, len(own), formatted, [a for a, _ in spans], [b for _, b in spans]))
            held += len(formatted)
            if held >= _FLUSH_CHARS:
                yield flushed()
                held = 0
        if rows:
            yield flushed()

    return turns.mapInArrow(
        run,
        f"conv_id {kind}, n_turns bigint, formatted string, loss_starts array<bigint>, loss_ends array<bigint>",
    )


def read_back(df: DataFrame) -> DataFrame:
    """What the formatted text itself says: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256 and formatted_chars, from the parser and the learned spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for formatted, starts, ends in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                turns, whole, learned, chars = parse(formatted), sha256(), sha256(), 0
                for turn in turns:
                    whole.update(f"{turn.role}\n{turn.text}\n".encode())
                for start, end in zip(starts, ends):
                    text = unescape(formatted[start:end])
                    learned.update(text.encode())
                    chars += len(text)
                rows.append((len(turns), whole.hexdigest(), chars, learned.hexdigest(), len(formatted)))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    kind = df.schema["conv_id"].dataType.simpleString()
    return df.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(
        run,
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint",
    )
