"""Chat formatting: a template, a state machine over roles, and segments with loss flags.

A template is plain data: marks around the turns of each role, which roles may
follow which, where a conversation may end, and whose text is trained on. A
conversation becomes one string and a list of segments; text under the loss mask
is exactly the text of the trained roles. Marks inside texts are escaped, so that
a formatted conversation reads back as the turns it was made of.

Defined cases: turns are ordered by number, equal numbers by role and text; a
null text or role is empty; a role that the template does not know gets marks
with its name; a conversation in an order that the machine refuses is formatted
all the same, with ``valid`` false and the place of the first fault.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "start", "end"
_BACK = "\\"


@dataclass(frozen=True)
class Template:
    """Marks before and after the turns of a role, allowed successions, trained roles.

    A mark after a turn begins with no white space of its own beyond what is
    written here; ``other`` marks hold the name of any other role.
    """

    marks: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>\n", "\n<</SYS>>\n"),
            "user": ("<s>[INST] ", " [/INST]"),
            "assistant": (" [ANS] ", " </s>"),
        }
    )
    other: tuple[str, str] = ("[TURN {}]", "[/TURN]")
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            START: ("system", "user"),
            "system": ("user",),
            "user": ("assistant", END),
            "assistant": ("user", END),
        }
    )
    trained: tuple[str, ...] = ("assistant",)

    @cached_property
    def controls(self) -> list[str]:
        """The strings that must not stand in an escaped text."""
        marks = [m for pair in self.marks.values() for m in pair] + [self.other[0].split("{}")[0], self.other[1]]
        return sorted({part for m in marks for part in (m, m.strip()) if part}, key=len, reverse=True)

    @cached_property
    def _unsafe(self) -> re.Pattern:
        whole = [re.escape(c) for c in self.controls]
        begun = sorted({re.escape(c[:n]) for c in self.controls for n in range(1, len(c))}, key=len, reverse=True)
        return re.compile(rf"(?=(?:{'|'.join(whole)})|(?:{'|'.join(begun)})\Z)(.)", re.S)

    def escape(self, text: str) -> str:
        """Backslashes double; a mark, or what may begin one at the end, gets one inside."""
        return self._unsafe.sub(lambda m: m[1] + _BACK, text.replace(_BACK, _BACK + _BACK))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def around(self, role: str) -> tuple[str, str]:
        if role in self.marks:
            return self.marks[role]
        return self.other[0].format(quote(role, safe="")), self.other[1]

    def fault(self, roles: list[str]) -> int | None:
        """Place of the first turn that may not stand there, counted from 0; the number of turns if the end is."""
        state = START
        for place, role in enumerate([*roles, END]):
            if role not in self.follows.get(state, ()) or (role == END and place < len(roles)):
                return place
            state = role
        return None

    def segments(self, turns: list[tuple[str, str]]) -> Iterator[tuple[str, str, bool]]:
        """Pieces of the formatted conversation: text, role it belongs to, whether it is trained on."""
        for role, text in turns:
            before, after = self.around(role)
            yield before, role, False
            yield self.escape(text), role, role in self.trained
            yield after, role, False

    @cached_property
    def _opening(self) -> re.Pattern:
        known = "|".join(re.escape(before) for before, _ in self.marks.values())
        head, tail = map(re.escape, self.other[0].split("{}"))
        return re.compile(rf"({known})|{head}([^\]]*?){tail}")

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a formatted conversation."""
        by_mark = {before: role for role, (before, _) in self.marks.items()}
        turns, at = [], 0
        while at < len(formatted):
            opened = self._opening.match(formatted, at)
            if not opened:
                raise ValueError(f"no turn begins at {at}")
            role = by_mark[opened[1]] if opened[1] is not None else unquote(opened[2])
            end = formatted.index(self.around(role)[1], opened.end())
            turns.append((role, self.unescape(formatted[opened.end() : end])))
            at = end + len(self.around(role)[1])
        return turns


SEGMENTS = "array<struct<start: int, end: int, role: string, loss: boolean>>"


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, turns`` from rows by turn: one row per conversation, which is one sequence."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """``conv_id, formatted, segments, n_turns, valid, fault`` of every conversation.

    Segments cover the formatted string without gaps, in code points.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("role", pa.string()), ("loss", pa.bool_())]))
        for batch in batches:
            strings, all_segments, counts, faults = [], [], [], []
            for rows in batch.column(1).to_pylist():
                pairs = [(row["role"], row["text"]) for row in rows]
                pieces, segments, at = [], [], 0
                for piece, role, loss in template.segments(pairs):
                    segments.append({"start": at, "end": at + len(piece), "role": role, "loss": loss})
                    pieces.append(piece)
                    at += len(piece)
                strings.append("".join(pieces))
                all_segments.append(segments)
                counts.append(len(pairs))
                faults.append(template.fault([role for role, _ in pairs]))
            fault = pa.array(faults, pa.int32())
            columns = [batch.column(0), pa.array(strings, pa.string()), pa.array(all_segments, kind), pa.array(counts, pa.int64())]
            columns += [pa.array([f is None for f in faults], pa.bool_()), fault]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "formatted", "segments", "n_turns", "valid", "fault"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, formatted string, segments {SEGMENTS}, n_turns bigint, valid boolean, fault int"
    return conversations(turns).mapInArrow(write, schema)


def read_conversations(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """``conv_id, turns, loss_text, formatted_chars, valid`` from formatted conversations.

    ``turns`` (role, text) come from the string alone, ``loss_text`` from the
    segments that are trained on.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            strings = batch.column(1).to_pylist()
            turns = [[{"role": r, "text": t} for r, t in template.parse(string)] for string in strings]
            losses = [
                "".join(template.unescape(string[s["start"] : s["end"]]) for s in segments if s["loss"])
                for string, segments in zip(strings, batch.column(2).to_pylist())
            ]
            columns = [batch.column(0), pa.array(turns, kind), pa.array(losses, pa.string())]
            columns += [pa.array(list(map(len, strings)), pa.int64()), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turns", "loss_text", "formatted_chars", "valid"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, turns array<struct<role: string, text: string>>, loss_text string, formatted_chars bigint, valid boolean"
    return formatted.select("conv_id", "formatted", "segments", "valid").mapInArrow(read, schema)
