r"""Chat formatting by columnar byte assembly.

A turn becomes ``<s>role\n`` + text + ``</s>\n``. In roles and texts a backslash is doubled and control strings get a
backslash after their first character, so that none stands unescaped; a line break in a role is escaped too. Dropping
the escaping backslashes gives the text back.

Rows are dealt into ranges of (conversation, turn) and sorted in them, so a conversation with very many turns is spread
over tasks. A task streams its range: for each Arrow batch it computes segment lengths, cumulative offsets and gather
indices in numpy and fills one preallocated buffer. A long conversation comes out in several parts, each of whole turns
and numbered in their order, so no task holds more than a batch and a part. Only the digest of a conversation, which is
one hash over all its turns, runs through all its parts in one task, a part at a time.

Defined cases: a null text or role is an empty one; a null turn comes first; equal turns are ordered by role, then text;
a null conversation id is a conversation of its own; repeated rows are turns of their own; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.arrow import buffers, ragged, utf8

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
PART_BYTES = 1 << 20
#: Conversations in an output batch, unless their text reaches PART_BYTES before.
ROWS = 512
FORMATTED = "conv_id long, part long, formatted string, loss array<struct<start:long,length:long>>"


def escape(column: pa.LargeStringArray, role: bool = False) -> pa.LargeStringArray:
    column = pc.replace_substring(column, "\\", "\\\\")
    for c in CONTROL:
        column = pc.replace_substring(column, c, f"{c[0]}\\{c[1:]}")
    return pc.replace_substring(column, "\n", "\\\n") if role else column


_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def assemble(role: pa.LargeStringArray, text: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of all turns in one buffer; for each turn its length in bytes and in characters, and the characters before its text."""
    fixed = [np.frombuffer(x, dtype=np.uint8) for x in (b"<s>", b"\n", b"</s>\n")]
    role_ends, role_data = buffers(role)
    text_ends, text_data = buffers(text)
    source = np.concatenate([*fixed, role_data, text_data])
    n = len(text)
    base = np.cumsum([0, *[len(f) for f in fixed]])
    starts = np.empty((n, 5), dtype=np.int64)
    lengths = np.empty((n, 5), dtype=np.int64)
    for k, piece in ((0, 0), (2, 1), (4, 2)):
        starts[:, k], lengths[:, k] = base[piece], len(fixed[piece])
    starts[:, 1], lengths[:, 1] = base[3] + role_ends[:-1], np.diff(role_ends)
    starts[:, 3], lengths[:, 3] = base[3] + len(role_data) + text_ends[:-1], np.diff(text_ends)
    out = np.take(source, ragged(starts.reshape(-1), lengths.reshape(-1)))
    role_chars, text_chars = (np.asarray(pc.utf8_length(c), dtype=np.int64) for c in (role, text))
    return out, lengths.sum(axis=1), role_chars + text_chars + 9, role_chars + 4


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])
    first = TaskContext.get().partitionId() << 33  # parts of a later range have higher numbers
    current, part, chunks, loss, size, chars = None, first, [], [], 0, 0

    ready: list[tuple] = []
    waiting = 0

    def row() -> bool:
        """Finish a row; whether it is time to emit those that are ready."""
        nonlocal waiting
        ready.append((current[0], part, b"".join(chunks).decode(), loss))
        waiting += size
        return waiting >= PART_BYTES or len(ready) >= ROWS

    def flush() -> pa.RecordBatch:
        nonlocal waiting
        columns = list(zip(*ready, strict=True))
        ready.clear()
        waiting = 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            role, text = utf8(batch.column("role")), utf8(batch.column("text"))
            learned = pc.equal(role, "assistant").to_pylist()
            escaped = escape(text)
            data, n_bytes, n_chars, before = assemble(escape(role, role=True), escaped)
            lengths = np.asarray(pc.utf8_length(escaped)).tolist()
            view, ends = memoryview(data), np.cumsum(n_bytes).tolist()
            for i, conv in enumerate(batch.column("conv_id").to_pylist()):
                if current is not None and current != (conv,):
                    if row():
                        yield flush()
                    current, part, chunks, loss, size, chars = None, first, [], [], 0, 0
                elif size >= PART_BYTES:
                    if row():
                        yield flush()
                    part, chunks, loss, size, chars = part + 1, [], [], 0, 0
                current = (conv,)
                if learned[i]:
                    loss.append({"start": chars + int(before[i]), "length": lengths[i]})
                chunks.append(view[ends[i] - int(n_bytes[i]) : ends[i]])
                size, chars = size + int(n_bytes[i]), chars + int(n_chars[i])
    if current is not None:
        row()
        yield flush()


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, part, formatted text, and the character spans of the assistant's texts in it (the loss mask)."""
    narrow = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    together = narrow.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return together.select("conv_id", "role", "text").mapInArrow(_format, FORMATTED)


_HEADER_END = re.compile(r"(?<!\\)(?:\\\\)*\n")


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted part."""
    out = []
    for turn in formatted.split("</s>\n")[:-1]:
        end = turn.index("\n") + 1
        if turn[end - 2] == "\\":  # an escaped line break, or a role that ends in a backslash
            end = _HEADER_END.search(turn, 3).end()
        out.append((unescape(turn[3 : end - 1]), unescape(turn[end:])))
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    rows: list[tuple] = []
    state = None  # [conv_id, turns, digest of turns, loss characters, digest of loss, characters]

    def close() -> None:
        if state is not None:
            rows.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for batch in batches:
        spans = batch.column("loss")
        inner = spans.flatten()
        begin, length = (inner.field(k).to_pylist() for k in range(2))
        ends = np.cumsum(np.asarray(pc.list_value_length(spans))).tolist()
        at = 0
        for i, (conv, formatted) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("conv_id", "formatted")], strict=True)):
            if state is None or state[0] != conv:
                close()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            turns = parse(formatted)
            learned = "".join([unescape(formatted[b : b + n]) for b, n in zip(begin[at : ends[i]], length[at : ends[i]], strict=True)])
            at = ends[i]
            state[1] += len(turns)
            state[2].update("".join([f"{role}\n{text}\n" for role, text in turns]).encode())
            state[3] += len(learned)
            state[4].update(learned.encode())
            state[5] += len(formatted)
        yield flush()
    close()
    yield flush()


def digest(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back, from whatever order: one row of counts and digests each."""
    together = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return together.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
