"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, each turn as ``### role: text</turn>`` and a line end. In roles and texts a backslash
goes before every ``\\``, ``#`` and ``<`` (in roles also before ``:``), so no text can spell a control string, and
dropping the backslashes again gives it back. The whole is encoded once with offsets; the sorted spans of the
assistant's texts are intersected with the sorted token spans by binary search, clipped, so that what a token has
beyond a span stays out of the mask.

Rows of a conversation meet in one task, sorted, and are held one conversation at a time; a conversation is the unit
that is encoded, so its own size bounds the memory.

Defined results: a null text or role is empty; a null conv_id is a conversation of its own; rows are ordered by turn
(null first), then role, then text, and repeated rows are repeated turns; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import prepare
from quarrylight.llm.tokens import default_path

OPEN, END = "### ", "</turn>\n"
ESCAPED, ESCAPED_ROLE = re.compile(r"[\\#<]"), re.compile(r"[\\#<:]")
TURN = re.compile(r"### ((?:[^\\#<:]+|\\.)*): ((?:[^\\#<]+|\\.)*)</turn>\n", re.S)
LEARNED = "assistant"


def escape(text: str) -> str:
    return ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]], learned: str = LEARNED) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the sorted spans of its learned texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{ESCAPED_ROLE.sub(r'\\\g<0>', role)}: ", escape(text)
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def loss_mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(token, start, end) of every non-empty intersection of sorted token offsets with sorted spans."""
    starts = np.array([a for a, _ in offsets], np.int64)
    ends = np.array([b for _, b in offsets], np.int64)
    out = []
    for a, b in spans:
        for k in range(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))):
            if (x := max(a, int(starts[k]))) < (y := min(b, int(ends[k]))):
                out.append((k, x, y))
    return out


def masked_text(formatted: str, mask: list[tuple[int, int, int]]) -> str:
    """All text under the mask, unescaped; what several tokens of one character cover counts once."""
    parts, done = [], 0
    for _, a, b in mask:
        if b > done:
            parts.append(formatted[max(a, done) : b])
            done = b
    return unescape("".join(parts))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple[str, str]]]]:
    key, turns = None, None
    for b in batches:
        for k, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if turns is None or k != key:
                if turns is not None:
                    yield key, turns
                key, turns = k, []
            turns.append((role, text))
    if turns is not None:
        yield key, turns


def formatted(conversations: DataFrame, *, tokenizer: str | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned: str = LEARNED) -> DataFrame:
    """A row per conversation: formatted text, ids, loss mask per token, and the clipped character spans of masked tokens."""
    prepare(conversations.sparkSession)
    own = conversations.select(F.col(conv_col).alias("conv_id"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(turn_col).alias("turn"))
    rows = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kind = rows.schema["conv_id"].dataType
    span = pa.list_(pa.struct([("token", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type
        from tokenizers import Tokenizer

        encode = Tokenizer.from_file(tokenizer or default_path())
        encode.encode_special_tokens = True
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            held.clear()
            kinds = [to_arrow_type(kind), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int8()), span]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "formatted", "ids", "mask", "spans"])

        for key, turns in _conversations(batches):
            text, spans = render(turns, learned)
            e = encode.encode(text, add_special_tokens=False)
            found = loss_mask(e.offsets, spans)
            mask = np.zeros(len(e.ids), np.int8)
            mask[[k for k, _, _ in found]] = 1
            held.append((key, text, e.ids, mask, [{"token": k, "start": a, "end": b} for k, a, b in found]))
            if len(held) >= 64:
                yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(run, f"conv_id {kind.simpleString()}, formatted string, ids array<int>, mask array<tinyint>, spans array<struct<token:int,start:int,end:int>>")


def digest(shaped: DataFrame) -> DataFrame:
    """What the output says of each conversation: turns read back from the text, learned text read back from the mask."""
    kind = shaped.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("spans").to_pylist(), strict=True):
                turns = turns_of(text)
                learned = masked_text(text, [(s["token"], s["start"], s["end"]) for s in spans])
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((len(turns), whole, len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return shaped.select("conv_id", "formatted", "spans").mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
