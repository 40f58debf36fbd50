"""Chat formatting with a grammar round trip.

A turn is rendered as  <|im_start|>ROLE newline TEXT<|im_end|> newline.  The
parser is deterministic: it reads one turn after another and unescapes role and
text. Text that holds a control string would be read wrongly, so a block of turns
is rendered plainly first, parsed, and compared with its source; turns that come
back different (or break the parse) are escaped, and the block is tried again
until what is parsed is identical.

Escaping puts ESCAPE after the second character of every control string, and after
that of everything that looks like one escaped already, so unescaping (taking one
ESCAPE away there) gives the text back whatever it is.

Turns stream through a task in the order of their conversation and are rendered
in blocks of bounded size; turns delimit themselves, so a rendered conversation
is the concatenation of its blocks, and memory doesn't depend on its length.

Defined results: null texts and roles are empty; turns are ordered by number,
those with the same by role and text, null numbers first; null conversation ids
are one conversation; repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import F, T

START, END = "<|im_start|>", "<|im_end|>"
ESCAPE = "\\"
#: A control string, or one with escapes in it: "<|" escapes "im_start|>".
CONTROL = re.compile(r"<\|(\\*)(im_start\|>|im_end\|>)")
ESCAPED = re.compile(r"<\|(\\*)\\(im_start\|>|im_end\|>)")
LINES = re.compile(r"\n|\\")
#: Characters of text after which a block is rendered and checked.
BLOCK_CHARS = 1 << 20


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "<|" + m[1] + ESCAPE + m[2], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: "<|" + m[1] + m[2], text)


def escape_role(role: str) -> str:
    r"""Roles end at a line's end, so they have theirs written as \n as well."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


class BadFormat(ValueError):
    pass


@dataclass(frozen=True)
class Parsed:
    role: str
    text: str
    begin: int  # of the formatted text, in the formatted string
    end: int


def parse(formatted: str) -> list[Parsed]:
    """The turns of a rendered block."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise BadFormat(f"no turn begins at {at}")
        line = formatted.find("\n", at + len(START))
        if line < 0:
            raise BadFormat("a role without end")
        end = formatted.find(END, line + 1)
        if end < 0 or not formatted.startswith("\n", end + len(END)):
            raise BadFormat("a text without end")
        role, text = formatted[at + len(START) : line], formatted[line + 1 : end]
        if START in text or END in role or START in role:
            raise BadFormat("a control string inside a turn")
        out.append(Parsed(unescape_role(role), unescape(text), line + 1, end))
        at = end + len(END) + 1
    return out


def _render(turns: list[tuple[str, str]], escaped: list[bool]) -> list[str]:
    return [f"{START}{escape_role(r) if e else r}\n{escape(t) if e else t}{END}\n" for (r, t), e in zip(turns, escaped)]


def format_turns(turns: list[tuple[str, str]]) -> tuple[list[str], list[Parsed]]:
    """Rendered turns, and what the parser makes of their concatenation, which is
    identical to the source."""
    escaped = [False] * len(turns)
    while True:
        parts = _render(turns, escaped)
        try:
            got = parse("".join(parts))
            if [(p.role, p.text) for p in got] == turns:
                return parts, got
        except BadFormat:
            pass
        # which turns conflict: those that don't come back by themselves
        conflicts = []
        for k, part in enumerate(parts):
            try:
                own = parse(part)
                good = [(p.role, p.text) for p in own] == [turns[k]]
            except BadFormat:
                good = False
            if not good:
                conflicts.append(k)
        if not conflicts or all(escaped[k] for k in conflicts):
            raise BadFormat("escaping doesn't help")
        for k in conflicts:
            escaped[k] = True


FORMATTED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("block", T.LongType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("loss", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ]
)
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Dealt by conversation, in the order of turns."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _blocks(batches):
    """(conv_id, number of the block, turns) from sorted rows."""
    current, turns, size, number = None, [], 0, 0
    fresh = True
    for batch in batches:
        for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if fresh or conv != current:
                if turns:
                    yield current, number, turns
                current, turns, size, number, fresh = conv, [], 0, 0, False
            elif size >= BLOCK_CHARS:
                yield current, number, turns
                turns, size, number = [], 0, number + 1
            turns.append((role, text))
            size += len(text) + len(role)
    if turns:
        yield current, number, turns


def format_conversations(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """FORMATTED rows: blocks of formatted text with the loss mask's intervals
    (code points of the block), in order within each partition."""

    def run(batches):
        rows = []
        chars = 0
        for conv, number, turns in _blocks(batches):
            parts, got = format_turns(turns)
            text = "".join(parts)
            rows.append((conv, number, text, [{"start": p.begin, "end": p.end} for p in got if p.role == trained_role]))
            chars += len(text)
            if chars > BLOCK_CHARS:
                yield _batch(rows)
                rows, chars = [], 0
        if rows:
            yield _batch(rows)

    def _batch(rows):
        c, n, t, m = (list(x) for x in zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(t), pa.array(m, _LOSS)], names=FORMATTED.names)

    return ordered_turns(conversations).mapInArrow(run, FORMATTED)


DIGESTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
    ]
)


def read_back(formatted: DataFrame) -> DataFrame:
    """DIGESTS of each conversation, from the rendered blocks alone: blocks must
    come in order within a partition, as format_conversations() gives them."""

    def run(batches):
        current, fresh, state = None, True, None
        rows = []

        def closed():
            n, turns, chars, loss, size = state
            return (current, n, turns.hexdigest(), chars, loss.hexdigest(), size)

        for batch in batches:
            for conv, block, text, mask in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if fresh or conv != current or block == 0:
                    if state is not None:
                        rows.append(closed())
                    current, fresh, state = conv, False, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for p in parse(text):
                    state[0] += 1
                    state[1].update(f"{p.role}\n{p.text}\n".encode())
                for m in mask:
                    own = unescape(text[m["start"] : m["end"]])
                    state[2] += len(own)
                    state[3].update(own.encode())
                state[4] += len(text)
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f) for c, f in zip(zip(*rows), _KINDS)], names=DIGESTS.names)
                rows = []
        if state is not None:
            rows.append(closed())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f) for c, f in zip(zip(*rows), _KINDS)], names=DIGESTS.names)

    return formatted.mapInArrow(run, DIGESTS)


_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
