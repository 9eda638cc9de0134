"""Chat formatting: a finite-state machine over roles and a declarative template, with a loss flag for each text segment.

The template's control strings mark the turns. Where they occur in a text they are escaped, so the formatted text can be
read back exactly. Rows of a conversation stream through in order; no conversation is held as a whole, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESC = "\\"


@dataclass(frozen=True)
class Template:
    """turns: role -> (string before a text, string after it); other roles stand between other[0] and other[1], then the text, then other[2].

    learn: roles whose texts carry the loss. follows: the machine; state -> {role: next state}, from "start"; a role without
    a move leaves the conversation invalid, as does an end in a state that isn't in accept.
    """

    turns: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    learn: frozenset[str]
    follows: dict[str, dict[str, str]]
    accept: frozenset[str]
    before: str = "<s>"

    def __post_init__(self):
        heads = [self.turns[r][0] for r in self.turns] + [self.other[0]]
        if any(not x or ESC in x for x in self.controls) or any(a != b and a.startswith(b) for a in heads for b in heads):
            raise ValueError("control strings must have two characters or more, no backslash, and heads must differ from their beginnings on")

    @cached_property
    def controls(self) -> tuple[str, ...]:
        parts = {self.before, *self.other, *(x for pair in self.turns.values() for x in pair)}
        return tuple(sorted((p for p in parts if p), key=lambda p: (-len(p), p)))

    @cached_property
    def _escaping(self) -> re.Pattern:
        return re.compile(re.escape(ESC) + "|(?=" + "|".join(map(re.escape, self.controls)) + ").", re.S)

    @cached_property
    def _beginnings(self) -> tuple[str, ...]:
        return tuple({c[:k] for c in self.controls for k in range(1, len(c))})

    def escape(self, text: str) -> str:
        """text without control strings: a backslash follows the first character of each, and doubles each backslash."""
        out = self._escaping.sub(lambda m: m.group() + ESC, text)
        # what ends like a control string begins could become one with what comes after the text
        return out + ESC if out.endswith(self._beginnings) else out

    _undo = re.compile(r"\\(\\?)", re.S)

    @classmethod
    def unescape(cls, text: str) -> str:
        return cls._undo.sub(r"\1", text)


LLAMA_LIKE = Template(
    turns={"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("[ANS] ", "</s>")},
    other=("[ROLE] ", " [TEXT] ", " [/ROLE]"),
    learn=frozenset({"assistant"}),
    follows={
        "start": {"system": "asked", "user": "user"},
        "asked": {"user": "user"},
        "user": {"assistant": "assistant", "tool": "tool"},
        "assistant": {"user": "user", "tool": "tool"},
        "tool": {"assistant": "assistant", "tool": "tool"},
    },
    accept=frozenset({"user", "assistant"}),
)


def segments(template: Template, role: str, text: str, first: bool) -> list[tuple[str, bool]]:
    """The formatted (text, loss) segments of one turn."""
    body = template.escape(text)
    before = template.before if first else ""
    if role in template.turns:
        head, tail = template.turns[role]
        return [(before + head, False), (body, role in template.learn), (tail, False)]
    a, b, c = template.other
    return [(before + a + template.escape(role) + b, False), (body, role in template.learn), (c, False)]


@dataclass
class Reader:
    """Reads formatted segments of one conversation back; what it holds is no more than one turn."""

    template: Template
    held: str = ""
    mask: list[tuple[int, bool]] = field(default_factory=list)  # (length, loss) of the parts of held
    first: bool = True

    def feed(self, text: str, loss: bool) -> Iterator[tuple[str, str, str]]:
        """(role, text, text under the loss mask) of each turn that this segment ends."""
        self.held += text
        self.mask.append((len(text), loss))
        while turn := self._turn():
            yield turn

    def _turn(self) -> tuple[str, str, str] | None:
        t, at = self.template, 0
        if self.first and t.before:
            if not self.held.startswith(t.before):
                return None
            at = len(t.before)
        role = next((r for r in t.turns if self.held.startswith(t.turns[r][0], at)), None)
        if role is not None:
            start, tail = at + len(t.turns[role][0]), t.turns[role][1]
        elif self.held.startswith(t.other[0], at):
            middle = self.held.find(t.other[1], at + len(t.other[0]))
            if middle < 0:
                return None
            role = t.unescape(self.held[at + len(t.other[0]) : middle])
            start, tail = middle + len(t.other[1]), t.other[2]
        else:
            return None
        end = self.held.find(tail, start)
        if end < 0:
            return None
        learnt, place, rest = [], 0, []
        stop = end + len(tail)
        for n, loss in self.mask:
            if loss and place < stop:
                learnt.append(self.held[place : min(place + n, stop)])
            if place + n > stop:
                rest.append((place + n - max(place, stop), loss))
            place += n
        turn = role, t.unescape(self.held[start:end]), "".join(map(t.unescape, learnt))
        self.held, self.mask, self.first = self.held[stop:], rest, False
        return turn


def format_conversations(turns: DataFrame, template: Template = LLAMA_LIKE, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, segment, text, loss, state): the formatted segments of each conversation, in order within their partition.

    Turns go by order_col (nulls first), then role and text, so repeated rows and ties have one order. A null text or role
    is an empty one; null conversation ids are one conversation. state is the machine's after the turn, "invalid" from the first turn
    that may not follow. Other columns are left out.
    """

    def run(batches):
        conv, n, state, begun = None, 0, "start", False
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for c, role, text in zip(*(b.column(k).to_pylist() for k in (0, 2, 3))):
                if not begun or c != conv:
                    conv, n, state, begun = c, 0, "start", True
                role, text = role or "", text or ""
                state = template.follows.get(state, {}).get(role, "invalid")
                for part, loss in segments(template, role, text, n == 0):
                    for column, value in zip(out, (c, n, part, loss, state)):
                        column.append(value)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.bool_()), pa.array(out[4], pa.string())], [conv_col, "segment", "text", "loss", "state"])

    rows = turns.select(conv_col, order_col, role_col, text_col)
    rows = rows.repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), conv_col).sortWithinPartitions(conv_col, order_col, role_col, text_col)
    return rows.mapInArrow(run, rows.select(conv_col, F.lit(0).cast("long").alias("segment"), F.lit("").alias("text"), F.lit(True).alias("loss"), F.lit("").alias("state")).schema)


def read_back(formatted: DataFrame, template: Template = LLAMA_LIKE, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation of what format_conversations() gives, in its order, with what its text and mask say.

    The rows of a conversation must follow each other, its segments counting from 0 (a stored table is sorted by both
    first); other orders raise. An empty table gives an empty one.
    """
    import hashlib

    def run(batches):
        names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        conv, begun, reader, turns, said, learnt, chars, learnt_chars, state = None, False, None, 0, None, None, 0, 0, ""
        kind, place = None, 0
        for b in _and_none(batches):
            out: list[list] = [[] for _ in names]
            kind = b.schema.field(0).type if b is not None else kind
            for c, segment, text, loss, now in zip(*(b.column(k).to_pylist() for k in range(5))) if b is not None else [(None,) * 5]:
                if begun and (text is None or c != conv):
                    if reader.held:
                        raise ValueError(f"conversation {conv} has text after its last turn")
                    for column, value in zip(out, (conv, turns, said.hexdigest(), learnt_chars, learnt.hexdigest(), chars, state in template.accept)):
                        column.append(value)
                if text is None:
                    break
                if not begun or c != conv:
                    conv, begun, reader, turns, said, learnt, chars, learnt_chars = c, True, Reader(template), 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                    place = 0
                if segment != place:
                    raise ValueError(f"conversation {conv} has segment {segment} where {place} should be")
                place += 1
                chars, state = chars + len(text), now
                for role, body, masked in reader.feed(text, loss):
                    turns += 1
                    said.update(f"{role}\n{body}\n".encode())
                    learnt.update(masked.encode())
                    learnt_chars += len(masked)
            if out[0] or b is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()))], names)

    long, text = F.lit(0).cast("long"), F.lit("")
    return formatted.mapInArrow(run, formatted.select(conv_col, long.alias("n_turns"), text.alias("turns_sha256"), long.alias("loss_chars"), text.alias("loss_sha256"), long.alias("formatted_chars"), F.lit(True).alias("valid")).schema)


def _and_none(batches):
    yield from batches
    yield None

