"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Rendering longer and longer prefixes of a
conversation and comparing consecutive outputs shows where each turn's span begins; rendering the turn once more with two
different probe texts shows where in the span its text lies. If an output does not begin with the one before it, the
template rewrites history: the conversation is marked so, and its spans are not used.

Conversations stream through tasks in turn order, and every prefix is rendered in full. Where the caller declares that a
template renders each turn by itself, they are held a segment of turns at a time; a segment starts with the last turn of
the one before, which must look as it did.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import kind, pick

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

SEGMENT = 32  # turns that are rendered from the same start, for templates that render each turn by itself
PROBES = ("A", "B")
CONTROL = re.compile(r"\\|###|</turn>")
ESCAPED = re.compile(r"\\(\\|###|</turn>|n|:)")
HEAD = re.compile(r"### ((?:[^\\:\n]|\\(?:\\|###|</turn>|n|:))*): ")
BODY = re.compile(r"((?:[^\\<]|\\(?:\\|###|</turn>)|<(?!/turn>))*) </turn>\n")


def escape(text: str) -> str:
    """Control strings and back slashes after a back slash."""
    return CONTROL.sub(lambda found: "\\" + found[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda found: "\n" if found[1] == "n" else found[1], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n").replace(":", "\\:")


def turn_template(turns: Sequence[Turn]) -> str:
    """``### Role: text </turn>`` and a line break for each turn; the role's first letter is a capital."""
    return "".join(f"### {escape_role(cased(role))}: {escape(text)} </turn>\n" for role, text in turns)


def cased(role: str) -> str:
    """Swap the case of a first letter that has one, which undoes itself."""
    return role[:1].swapcase() + role[1:] if role[:1].isascii() else role


def read_turns(formatted: str) -> Iterator[Turn]:
    """The turns that ``turn_template`` wrote."""
    at = 0
    while at < len(formatted):
        head = HEAD.match(formatted, at)
        body = BODY.match(formatted, head.end()) if head else None
        if not body:
            raise ValueError(f"no turn at {at}")
        yield cased(unescape(head[1])), unescape(body[1])
        at = body.end()


@dataclass(frozen=True)
class Span:
    """Where a turn and its text stand in the formatted conversation."""

    start: int
    stop: int
    text_start: int
    text_stop: int


def turn_span(template: Template, turns: Sequence[Turn], before: str, after: str) -> tuple[int, int, int] | None:
    """(start, text start, text stop) of the last turn from outputs without and with it; None if history changed."""
    if not after.startswith(before):
        return None
    role = turns[-1][0]
    one, two = (template([*turns[:-1], (role, probe)]) for probe in PROBES)
    head = len(before)
    if not one.startswith(before) or len(one) != len(two):
        return None
    while head < len(one) and one[head] == two[head]:
        head += 1
    tail = len(one) - head - 1
    if head >= len(one) or one[head + 1 :] != two[head + 1 :] or len(after) < head + tail:
        return None
    if after[:head] != one[:head] or (tail and after[-tail:] != one[-tail:]):
        return None
    return len(before), head, len(after) - tail


class Renderer:
    """Formats one conversation turn by turn; holds its turns and output, or a segment of them at most."""

    def __init__(self, template: Template, segment: int | None = None):
        self.template, self.segment = template, segment
        self.turns: list[Turn] = []
        self.output = ""
        self.length = 0  # characters of the formatted conversation so far
        self.rewrites = False

    def add(self, turn: Turn) -> tuple[str, Span | None]:
        """(the turn's part of the output, its span); the span is None where the template rewrote history."""
        if self.segment is not None and len(self.turns) == self.segment:  # begin anew from the last turn, which must look as it did
            last = self.turns[-1]
            part = self.output[len(self.template(self.turns[:-1])) :]
            alone = self.template([last])
            self.rewrites |= not alone.endswith(part)
            self.turns, self.output = [last], alone
        self.turns.append(turn)
        after = self.template(self.turns)
        found = turn_span(self.template, self.turns, self.output, after)
        if found is None:
            self.rewrites = True
            common = min(len(after), len(self.output))
            part, span = after[common:], None
        else:
            start, text_start, text_stop = found
            part = after[start:]
            base = self.length - start
            span = Span(base + start, base + len(after), base + text_start, base + text_stop)
        self.output = after
        self.length += len(part)
        return part, None if self.rewrites else span


def format_conversations(
    rows: DataFrame,
    template: Template = turn_template,
    loss_roles: Sequence[str] = ("assistant",),
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    segment: int | None = None,
) -> DataFrame:
    """(id, place, role, part, start, stop, text_start, text_stop, loss, rewrites): one row per turn, in turn order.

    ``part`` is what the turn adds to the formatted conversation, the spans count its characters from 0, and the text span
    of a turn with ``loss`` is what its conversation's loss mask covers. ``rewrites`` is true from the turn on at which the
    template changed what it had rendered before; spans are null for such turns, and they bear no loss.

    Rows are ordered by turn, then role and text; a null turn comes first. A null text or role counts as empty, rows with
    a null id form one conversation, repeated rows are turns of their own; an empty table gives an empty one. Other
    columns are not carried.

    Every prefix of a conversation is rendered whole, so a conversation is held by its task and costs the square of its
    turns. For a template that renders each turn by itself, whatever stands before it, ``segment`` turns at a time may be
    rendered and held instead; for others a segment gives wrong spans.
    """
    turns = pick(rows, id=id_column, turn=turn_column, role=role_column, text=text_column)
    turns = turns.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    turns = turns.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")
    roles = frozenset(loss_roles)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, renderer, place = NOTHING, None, 0
        for whole in batches:
            for batch in (whole.slice(start, 500) for start in range(0, whole.num_rows, 500)):
                out = []
                for identity, role, text in zip(*(column.to_pylist() for column in batch.columns)):
                    if renderer is None or identity != now:
                        now, renderer, place = identity, Renderer(template, segment), 0
                    part, span = renderer.add((role, text))
                    spans = (span.start, span.stop, span.text_start, span.text_stop) if span else (None,) * 4
                    out.append((place, role, part, *spans, span is not None and role in roles, renderer.rewrites))
                    place += 1
                types = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.bool_()]
                columns = [pa.array(column, t) for column, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], FORMATTED)

    schema = (
        f"id {kind(rows, id_column)}, place bigint, role string, part string, start bigint, stop bigint,"
        " text_start bigint, text_stop bigint, loss boolean, rewrites boolean"
    )
    return turns.mapInArrow(run, schema)


NOTHING = object()
FORMATTED = "id place role part start stop text_start text_stop loss rewrites".split()


def conversation_digests(
    formatted: DataFrame, reader: Callable[[str], Iterable[Turn]] = read_turns, plain: Callable[[str], str] = unescape
) -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites), read back from formatted turns.

    Takes the rows of ``format_conversations`` as they come, without a further shuffle. ``reader`` gets the turns out of a
    formatted stretch, ``plain`` undoes the escapes of the text under the loss mask.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = NOTHING, None
        types: list[pa.DataType] = []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], DIGESTS)

        for batch in batches:
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            rows = []
            columns = (batch.column(batch.schema.get_field_index(name)).to_pylist() for name in READ_BACK)
            for identity, place, part, start, text_start, text_stop, loss, rewrites in zip(*columns):
                if state is None or place == 0:
                    if state:
                        rows.append(state.row(now))
                    now, state = identity, Digest()
                elif identity != now or place != state.rows:
                    raise ValueError("formatted turns must come in the order in which they were made")
                state.add(part, reader)
                if loss:
                    state.mask(plain(part[text_start - start : text_stop - start]))
                state.rewrites |= rewrites
            if rows:
                yield made(rows)
        if state:
            yield made([state.row(now)])

    identity = formatted.schema["id"].dataType.simpleString()
    return formatted.mapInArrow(
        run,
        f"id {identity}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
        " formatted_chars bigint, rewrites boolean",
    )


READ_BACK = "id place part start text_start text_stop loss rewrites".split()
DIGESTS = "id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars rewrites".split()


class Digest:
    """Running digests of one conversation."""

    def __init__(self):
        self.rows = self.turns = self.chars = self.loss_chars = 0
        self.seen, self.loss = sha256(), sha256()
        self.rewrites = False

    def add(self, part: str, reader: Callable[[str], Iterable[Turn]]) -> None:
        self.rows += 1
        self.chars += len(part)
        for role, text in reader(part):
            self.turns += 1
            self.seen.update(f"{role}\n{text}\n".encode())

    def mask(self, text: str) -> None:
        self.loss_chars += len(text)
        self.loss.update(text.encode())

    def row(self, identity) -> tuple:
        digests = self.seen.hexdigest(), self.loss_chars, self.loss.hexdigest()
        return identity, self.turns, *digests, self.chars, self.rewrites
