"""Chat formatting: a finite-state machine over roles, and a declarative template that yields text segments with loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around each role's text, whether the text counts in the loss, and the turns that may follow a role.

    marks: role to (opening, closing). Roles without marks are put, escaped, between other's first two marks, and closed by its
    third. follows: role, or start, to the roles that may come next; may_end: roles that may come last.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<s>[SYS]", "[/SYS]"), "user": ("<s>[INST]", "[/INST]"), "assistant": ("<s>[OUT]", "</s>")})
    other: tuple[str, str, str] = ("<s>[ROLE]", "[/ROLE]", "[/END]")
    loss: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    may_end: frozenset[str] = frozenset({"assistant"})
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", "[ROLE]", "[/ROLE]", "[/END]")

    def __post_init__(self):
        for mark in (*(m for pair in self.marks.values() for m in pair), *self.other):
            if "".join(c for c in re.split("(" + "|".join(map(re.escape, self.controls)) + ")", mark) if c not in self.controls):
                raise ValueError(f"a mark must consist of control strings: {mark!r}")

    @property
    def control(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, sorted(self.controls, key=len, reverse=True))))


def escape(text: str, control: re.Pattern) -> str:
    r"""Backslashes doubled, and one put after the first character of each control string: none is left in the result."""
    return control.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


_SEGMENT = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("segment", pa.int64()), ("text", pa.string()), ("loss", pa.bool_()), ("fault", pa.string())])


def _batches(rows: Iterator[tuple], schema: pa.Schema, chars: int = 4_000_000, at: int = 3) -> Iterator[pa.RecordBatch]:
    some, n = [], 0
    for row in rows:
        some.append(row)
        n += 100 + (len(row[at]) if isinstance(row[at], str) else 0)
        if n > chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some, n = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments (conv_id, turn, segment, text, loss, fault) of conversations (conv_id long, turn long, role, text).

    A conversation's rows come by turn, then role, then text (nulls first), so ties and repeated rows have one order. Null text
    and role are empty; a null conv_id is a conversation of its own; other columns are dropped. Each turn gives three segments: opening
    mark, escaped text, closing mark. loss is true for the text of roles in the loss. The machine over roles puts a fault on
    the first segment of a turn that may not follow, and on the last segment of a conversation that may not end there; such
    conversations are formatted all the same. Segments of one conversation lie together and in order in one partition.

    Rows stream through a task in order, so a conversation of any length needs the memory of one batch.
    """
    template = template or Template()
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        control = template.control

        def segments():
            before, state, k, held = object(), "start", 0, None
            for batch in batches:
                for conv_id, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if conv_id != before:
                        if held:
                            yield held if state in template.may_end else (*held[:5], f"may not end with {state}")
                        before, state, k, held = conv_id, "start", 0, None
                    if held:
                        yield held
                    fault = None if role in template.follows.get(state, ()) else f"{role} may not follow {state}"
                    state = role
                    if role in template.marks:
                        opening, closing = template.marks[role]
                    else:
                        opening, closing = template.other[0] + escape(role, control) + template.other[1], template.other[2]
                    yield conv_id, turn, k, opening, False, fault
                    yield conv_id, turn, k + 1, escape(text, control), role in template.loss, None
                    held = conv_id, turn, k + 2, closing, False, None
                    k += 3
            if held:
                yield held if state in template.may_end else (*held[:5], f"may not end with {state}")

        yield from _batches(segments(), _SEGMENT)

    return rows.mapInArrow(run, "conv_id long, turn long, segment long, text string, loss boolean, fault string")


class _Reader:
    """What read_back knows of one conversation so far."""

    def __init__(self, conv_id, template: Template):
        self.conv_id, self.n, self.chars, self.loss_chars, self.valid = conv_id, 0, 0, 0, True
        self.turns, self.loss, self.pending = hashlib.sha256(), hashlib.sha256(), ""
        own = [(role, re.compile(f"{re.escape(a)}(.*?){re.escape(b)}", re.S)) for role, (a, b) in template.marks.items()]
        a, b, c = map(re.escape, template.other)
        self.forms = [*own, (None, re.compile(f"{a}(.*?){b}(.*?){c}", re.S))]
        self.closings = tuple({template.other[2], *(b for _, b in template.marks.values())})

    def take(self, text: str, loss: bool, fault: str | None) -> None:
        self.chars += len(text)
        self.valid &= fault is None
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))
        self.pending += text
        if text.endswith(self.closings):  # else no turn can have ended
            self._turns()

    def _turns(self) -> None:
        while found := next(((role, m) for role, form in self.forms if (m := form.match(self.pending))), None):
            role, m = found
            role, text = (role, m[1]) if role is not None else (unescape(m[1]), m[2])
            self.turns.update(f"{role}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
            self.pending = self.pending[m.end() :]

    def row(self) -> tuple:
        if self.pending:
            raise ValueError(f"conversation {self.conv_id} doesn't follow the template")
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, read from format_chats' output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, valid (no segment has a fault).

    The formatted text is parsed by its control strings alone; the loss is the text that the flags mark; both are unescaped.
    Segments must lie as format_chats leaves them. Memory: one batch, and one turn of text. No segments give no rows.
    """
    template = template or Template()
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])

    def run(batches):
        def rows():
            now = None
            for batch in batches:
                for conv_id, text, loss, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "fault")), strict=True):
                    if now is None or conv_id != now.conv_id:
                        if now:
                            yield now.row()
                        now = _Reader(conv_id, template)
                    now.take(text, loss, fault)
            if now:
                yield now.row()

        yield from _batches(rows(), schema)

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
