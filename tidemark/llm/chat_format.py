"""Chat formatting: a finite-state machine over roles checks turn order and a declarative template emits text segments with loss flags.

A template names the text around a conversation and around each role's turn; what
is escaped and how the output is read back both follow from it. Control
characters inside texts are escaped with a backslash, so no text can open or
close a turn and the output can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, stage


@dataclass(frozen=True)
class Template:
    """What stands around a conversation and around a turn; ``before`` names the role once, with a mark behind it.

    Characters that begin a mark or end one stand escaped in roles and texts, so the marks are found by reading on to the next that is not.
    """

    opening: str = "<s>"
    before: str = "[TURN {role}]"
    after: str = "[/TURN]"
    closing: str = "</s>"
    learned: frozenset = frozenset({"assistant"})
    #: role before -> roles that may follow ("" is the beginning; "end" the end)
    order: dict = field(default_factory=lambda: {"": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user", "end"}})

    def __post_init__(self):
        head, tail = self.role_marks
        if not (head and tail and self.after) or "\\" in self.opening + self.before + self.after + self.closing:
            raise ValueError("a turn needs marks before and behind its role and behind its text, without backslashes")
        if self.closing and self.closing[0] == head[0] and (self.closing.startswith(head) or head.startswith(self.closing)):
            raise ValueError("the closing and the mark before a role must differ")

    @property
    def role_marks(self) -> tuple[str, str]:
        head, _, tail = self.before.partition("{role}")
        return head, tail

    @property
    def special(self) -> str:
        """Characters that roles and texts hold escaped."""
        head, tail = self.role_marks
        marks = [m for m in (self.opening, head, tail, self.after, self.closing) if m]
        return "".join(sorted({"\\"} | {m[0] for m in marks} | {m[-1] for m in (self.opening, self.after, self.closing) if m}))

    def escape(self, text: str) -> str:
        return re.sub(f"[{re.escape(self.special)}]", r"\\\g<0>", text)

    def turn_pattern(self) -> re.Pattern:
        """One formatted turn, with role and text as groups."""
        plain = rf"((?:[^{re.escape(self.special)}]|\\.)*)"
        head, tail = map(re.escape, self.role_marks)
        return re.compile(head + plain + tail + plain + re.escape(self.after), re.DOTALL)


_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


#: The state behind the first turn out of order; no transition leaves it.
BROKEN = "\0broken"
#: What a transition emits stands in for the turn's own role or text.
ROLE, TEXT = object(), object()


class Machine:
    """A template as a finite-state machine over roles: each transition checks the order and emits its segments with their loss flags.

    States are the roles of ``order``, "" before the first turn, "end" behind the
    last, and ``BROKEN``. A role that the state's row lacks leads to ``BROKEN`` for
    good; what it emits stays the same, so no text is lost. Entering or leaving a
    conversation are transitions too: they emit the opening and the closing.
    """

    def __init__(self, template: Template):
        self.template = template
        self.next = {(at, role): role for at, roles in template.order.items() for role in roles if role != "end"}
        self.final = {at for at, roles in template.order.items() if "end" in roles}
        head, tail = template.role_marks
        #: the segments of a turn, each as its parts and whether it can carry loss (it does if the role is learned)
        self.emitted = (((head, ROLE, tail), False), ((TEXT,), True), ((template.after,), False))
        self.at = None

    @property
    def valid(self) -> bool:
        return self.at != BROKEN

    def begin(self) -> tuple[str, bool, bool]:
        self.at = ""
        return self.template.opening, False, True

    def step(self, role: str, text: str) -> Iterator[tuple[str, bool, bool]]:
        """Take one turn: (segment, loss, in order so far) for each segment of it."""
        self.at = self.next.get((self.at, role), BROKEN)
        learned = role in self.template.learned
        own = {ROLE: role, TEXT: text}
        for parts, loss in self.emitted:
            yield "".join(self.template.escape(own[x]) if x in own else x for x in parts), loss and learned, self.valid

    def end(self) -> tuple[str, bool, bool]:
        self.at = "end" if self.at in self.final else BROKEN
        return self.template.closing, False, self.valid


def format_segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """All conversations as text: conv_id, seq (from 0 in each conversation), segment, loss, valid; joined by seq they are the formatted text.

    The template's machine emits them; ``valid`` says whether the turns are in order up to this segment, so the last one's holds for the conversation.

    Rows are partitioned by conversation and sorted by turn, role, text; a task
    streams over them and holds one turn, so a conversation of any length takes
    bounded memory. A null text or role counts as empty (an empty role is never
    in order); null conversation ids form one conversation (ids are whole numbers); repeated rows are
    turns of their own; other columns are not read. An empty table gives none.
    """
    template = template or Template()
    arrow = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("segment", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seq, machine = _NONE, 0, Machine(template)

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        for b in batches:
            out = []
            for c, _, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if conv is _NONE or c != conv:
                    if conv is not _NONE:
                        out.append((conv, seq, *machine.end()))
                    conv, seq = c, 1
                    out.append((c, 0, *machine.begin()))
                for emitted in machine.step(role, text):
                    out.append((c, seq, *emitted))
                    seq += 1
            if out:
                yield batch(out)
        if conv is not _NONE:
            yield batch([(conv, seq, *machine.end())])

    prepare(conversations.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), empty("role"), empty("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, seq long, segment string, loss boolean, valid boolean")


_NONE = object()


class Reader:
    """Reads one formatted conversation, segment by segment: turns by the template's pattern, learned text by the loss flags."""

    def __init__(self, template: Template):
        self.template, self.pattern = template, template.turn_pattern()
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.held, self.begun, self.n_turns, self.loss_chars, self.chars, self.valid = "", False, 0, 0, 0, True

    def feed(self, segment: str, loss: bool, valid: bool) -> None:
        self.valid &= valid
        self.held += segment
        self.chars += len(segment)
        if loss:
            text = unescape(segment)
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))
        if not self.begun:
            if not self.held.startswith(self.template.opening):
                raise ValueError("a conversation begins without its opening")
            self.held, self.begun = self.held[len(self.template.opening) :], True
        if segment.endswith(self.template.after) and (m := self.pattern.match(self.held)):
            role, text = unescape(m[1]), unescape(m[2])
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.held = self.held[m.end() :]

    def close(self) -> tuple:
        if self.held != self.template.closing:
            raise ValueError("a conversation ends without its closing")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Read the output of ``format_segments``: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid (turns in the template's order, as the machine wrote it).

    Everything comes from the segments and their flags. Digests grow turn by turn; a task holds one turn. Output that the template can't have made raises.
    """
    template = template or Template()
    names = ("conv_id long", "n_turns long", "turns_sha256 string", "loss_chars long", "loss_sha256 string", "formatted_chars long", "valid boolean")
    arrow = pa.schema([(n.split()[0], {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[n.split()[1]]) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, reader = _NONE, None

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        for b in batches:
            out = []
            for c, _, segment, loss, valid in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if conv is _NONE or c != conv:
                    if reader:
                        out.append((conv, *reader.close()))
                    conv, reader = c, Reader(template)
                reader.feed(segment, loss, valid)
            if out:
                yield batch(out)
        if reader:
            yield batch([(conv, *reader.close())])

    rows = formatted.select("conv_id", "seq", "segment", "loss", "valid").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return rows.mapInArrow(run, ", ".join(names))


def format_digests(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Format all conversations, write the output, and read it back."""
    return read_back(stage(format_segments(conversations, template), "chat-formatted"), template)
