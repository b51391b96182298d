"""Chat formatting by a finite-state machine over roles and a declarative template.

A template names, for each role, the text before and after a turn and whether the turn carries loss, and the order in
which roles may follow each other. The machine walks a conversation in turn order and emits segments: (conv_id,
segment number, text, loss flag). A control string inside a turn's text is escaped, and `read_back` undoes it.

Rows are sorted by conversation and turn and streamed: a task holds one turn at a time, however long a conversation is.

Defined cases: a null text is empty; turns of one number are ordered by role and text, null turns first; a null conv_id is a
conversation of its own; a null role or one that the template lacks is written with the template's fallback role and makes the conversation
invalid, as an order of roles does that the machine has no transition for (such conversations are formatted whole and flagged, not dropped); repeated rows are
repeated turns; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

START = "start"


@dataclass(frozen=True)
class Template:
    """header holds {role}; a text's own control strings (the visible part of what stands before a role and of the footer) get a backslash before them, and so
    does a backslash. They must not be empty or begin with a backslash, and the footer's must not end as it begins."""

    header: str = "### {role}:\n"
    footer: str = "</turn>\n"
    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    fallback: str = "Other"
    loss: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {START: frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})}
    )
    ends: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self):
        for mark in self.controls[1:]:
            if not mark or mark[0] == "\\":
                raise ValueError(f"no mark for turns: {mark!r}")
        if self.footer[0].isspace() or any(mark.startswith(mark[-k:]) for k in range(1, len(mark))):
            raise ValueError(f"a footer begins with its mark, which doesn't end as it begins: {self.footer!r}")

    @property
    def controls(self) -> tuple[str, ...]:
        return ("\\", self.header.split("{role}")[0].strip(), self.footer.strip())

    def escape(self, text: str) -> str:
        return _pattern(self.controls).sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def open_turn(self, role: str | None) -> str:
        """A role without a label is written, escaped, in brackets, so that it can be read back; null is a bare fallback."""
        if role in self.labels:
            return self.header.format(role=self.labels[role])
        return self.header.format(role=self.fallback if role is None else f"{self.fallback}({self.escape(role)})")


def _pattern(controls: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(re.escape(c) for c in controls))


SEGMENTS = "conv_id long, segment int, text string, loss boolean, valid boolean"


def _text(column: pa.Array) -> list:
    return column.to_pylist()


def segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Three segments a turn: header, text, footer. `valid` is false from the first turn on that breaks the order of roles;
    the footer of the last turn tells whether the whole conversation is valid, its end included."""
    template = template or Template()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, valid, n, held = object(), START, True, 0, None
        out: list[tuple] = []

        def footer(last: bool) -> tuple:
            return (*held, valid and (not last or state in template.ends))

        for batch in batches:
            for c, role, text in zip(*(_text(batch.column(k)) for k in ("conv_id", "role", "text")), strict=True):
                if held is not None:
                    out.append(footer(c != conv))
                if c != conv or held is None:
                    conv, state, valid, n = c, START, True, 0
                valid = valid and role in template.follows.get(state, ())
                state = role
                body, loss = template.escape(text or ""), role in template.loss
                out += [(c, n, template.open_turn(role), False, valid), (c, n + 1, body, loss, valid)]
                held = (c, n + 2, template.footer, False)
                n += 3
            yield _batch(out)
            out = []
        if held is not None:
            yield _batch([footer(True)])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = {"conv_id": pa.int64(), "segment": pa.int32(), "text": pa.string(), "loss": pa.bool_(), "valid": pa.bool_()}
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types.values(), strict=True)], list(types))

    dealt = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(walk, SEGMENTS)


class Reader:
    """Reads one conversation's formatted text back, piece by piece; it holds what is not yet a whole turn."""

    def __init__(self, template: Template):
        label = "|".join(re.escape(v) for v in template.labels.values())
        head = template.header.split("{role}")
        mark = re.escape(template.controls[2])
        first = re.escape(template.controls[2][0])
        self.turn = re.compile(
            rf"{re.escape(head[0])}(?P<role>{label}|{re.escape(template.fallback)}(?:\((?P<other>(?:[^\\]|\\.)*?)\))?){re.escape(head[1])}"
            rf"(?P<text>(?:[^\\{first}]|\\.|(?!{mark}){first})*+){re.escape(template.footer)}",
            re.S,
        )
        self.template, self.roles = template, {v: k for k, v in template.labels.items()}
        self.turns, self.loss, self.n_turns, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        self.open: list[tuple[str, bool]] = []
        self.valid = True

    def feed(self, text: str, loss: bool, valid: bool) -> None:
        self.open.append((text, loss))
        self.chars += len(text)
        self.valid = valid
        if text.endswith(self.template.footer):
            self.take()

    def take(self) -> None:
        """Read the turns that are whole. What stands under the loss mask comes from the mask's spans, not from the role."""
        found = self.turn.fullmatch("".join(t for t, _ in self.open))
        if not found:
            return
        role = self.roles.get(found["role"]) or (None if found["other"] is None else self.template.unescape(found["other"]))
        self.turns.update(f"{role or ''}\n{self.template.unescape(found['text'])}\n".encode("utf-8", "surrogatepass"))
        under = self.template.unescape("".join(t for t, loss in self.open if loss))
        self.loss.update(under.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(under)
        self.n_turns += 1
        self.open = []

    def row(self, conv: int | None) -> tuple:
        if self.open:
            raise ValueError(f"conversation {conv}: the formatted text ends within a turn")
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation from its segments, which must come as `segments` leaves them: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, valid."""
    template = template or Template()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, reader, rows = None, None, []
        for batch in batches:
            for c, text, loss, valid in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "text", "loss", "valid")), strict=True):
                if reader is None or c != conv:
                    if reader:
                        rows.append(reader.row(conv))
                    conv, reader = c, Reader(template)
                reader.feed(text, loss, valid)
            if rows:
                yield _rows(rows)
                rows = []
        if reader:
            yield _rows([reader.row(conv)])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def with_control_case(conversations: DataFrame) -> DataFrame:
    """The rows of the table and conversation -7, whose two turns hold the template's control strings."""
    said = r"\### Assistant: </turn> ok"
    own = conversations.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(own)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(segments(with_control_case(table(spark, sf_dir, "conversations"))))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns, bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'user' THEN role = 'assistant' WHEN before IN ('system', 'assistant') THEN role = 'user' ELSE FALSE END) AND arg_max(role = 'assistant', place) AS valid,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + 14 + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'))) AS BIGINT) AS formatted_chars
FROM (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS place FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) GROUP BY conv_id
"""
