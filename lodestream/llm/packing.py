"""Packing of documents into token sequences: bounded-space online best fit.

Every task keeps a fixed number of open windows. A document is cut into full windows and a rest; the rest goes into
the open window that it fills best; where none has room, the fullest one is completed with a cut of the rest and
emitted, and what remains takes its slot. At the end of a partition its open windows are merged, which leaves one window
that isn't full; those of ``MERGED_TOGETHER`` neighbouring partitions are then merged piece by piece. Only that last
step shuffles, and only the pieces of these few windows.

Token ids are those of the tokenizers file. Texts of Latin script are encoded with the same vocabulary as tiktoken
ranks, which is several times faster; a text of each batch is encoded both ways, and a batch in which they differ, like
any text that has other scripts or a special token's string, is encoded by tokenizers.

Defined cases: a null or empty text is the end token alone; a null id stays null; repeated rows are packed as rows of
their own; ties in room go to the window opened first; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.arrow import slices
from lodestream.llm.common import materialize

END_ID = 0
MERGED_TOGETHER = 64
#: Code points on which both encoders are known to split words alike.
_PLAIN = re.compile("[\\x00-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]*")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def _encoders(tokenizer: str, ranks: str | None, pattern: str | None):
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer)
    if not ranks:
        return exact, None, ()
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return exact, quick, tuple(t.content for t in exact.get_added_tokens_decoder().values())


def encode_texts(texts: list[str], tokenizer: str, ranks: str | None = None, pattern: str | None = None) -> list[list[int]]:
    """The ids that tokenizers gives for each text, without special tokens added."""
    exact, quick, special = _encoders(tokenizer, ranks, pattern)
    slow = lambda own: [e.ids for e in exact.encode_batch_fast(own, add_special_tokens=False)]
    if quick is None:
        return slow(texts)
    plain = [bool(_PLAIN.fullmatch(t)) and not any(s in t for s in special) for t in texts]
    probe = min((i for i, ok in enumerate(plain) if ok), key=lambda i: abs(len(texts[i]) - 500), default=None)
    if probe is not None and slow([texts[probe]])[0] != quick.encode_ordinary(texts[probe]):
        return slow(texts)
    rest = iter(slow([t for t, ok in zip(texts, plain, strict=True) if not ok]))
    return [quick.encode_ordinary(t) if ok else next(rest) for t, ok in zip(texts, plain, strict=True)]


class Packer:
    """The windows of one partition. ``rows`` gathers emitted pieces: (doc, start, length, crc, doc tokens, window, offset)."""

    def __init__(self, size: int, windows: int):
        self.size, self.slots = size, windows
        self.open: list[list] = []  # [room, serial, [(doc, start, ids, doc tokens)]]
        self.rows: list[tuple] = []
        self.emitted = self.opened = 0

    def _emit(self, pieces: list[tuple], tail: bool = False) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.emitted, offset, tail))
            offset += len(ids)
        self.emitted += 1

    def _open(self, piece: tuple) -> None:
        self.open.append([self.size - len(piece[2]), self.opened, [piece]])
        self.opened += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, full = len(ids), len(ids) // self.size * self.size
        for start in range(0, full, self.size):
            self._emit([(doc, start, ids[start : start + self.size], total)])
        if full < total:
            self._place((doc, full, ids[full:], total))

    def _place(self, piece: tuple) -> None:
        doc, start, ids, total = piece
        best = min((w for w in self.open if w[0] >= len(ids)), key=lambda w: w[:2], default=None)
        if best is not None:
            best[0] -= len(ids)
            best[2].append((doc, start, ids.copy(), total))
            if not best[0]:
                self.open.remove(best)
                self._emit(best[2])
        elif len(self.open) < self.slots:
            self._open((doc, start, ids.copy(), total))
        else:
            fullest = min(self.open, key=lambda w: w[:2])
            room = fullest[0]
            self.open.remove(fullest)
            self._emit([*fullest[2], (doc, start, ids[:room], total)])
            self._place((doc, start + room, ids[room:], total))

    def finish(self) -> None:
        """Merge the open windows, the fullest first; all but the last come out full."""
        room, pieces = self.size, []
        for _, _, own in sorted(self.open, key=lambda w: w[:2]):
            for doc, start, ids, total in own:
                while len(ids) >= room:
                    self._emit([*pieces, (doc, start, ids[:room], total)])
                    start, ids, room, pieces = start + room, ids[room:], self.size, []
                if len(ids):
                    pieces.append((doc, start, ids, total))
                    room -= len(ids)
        if pieces:
            self._emit(pieces, tail=True)
        self.open = []


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("window", pa.int64()), ("offset", pa.int64()), ("tail", pa.bool_()), ("part", pa.int64())])


def _pack_partition(tokenizer: str, ranks: str | None, pattern: str | None, size: int, windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer = Packer(size, windows)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [[]] * (len(_SCHEMA) - 1)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip([*columns, [part] * len(columns[0])], _SCHEMA, strict=True)], schema=_SCHEMA)

        for batch, texts in slices(batches, "text"):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode_texts(texts.to_pylist(), tokenizer, ranks, pattern), strict=True):
                ids.append(END_ID)
                packer.add(doc, np.array(ids, dtype="<u4"))
            if packer.rows:
                yield flush()
        packer.finish()
        if packer.rows:
            yield flush()

    return run


def _merge_tails(size: int):
    """Best fit decreasing over the pieces of at most MERGED_TOGETHER unfinished windows."""

    def run(tails: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(zip(tails["part"], tails["window"], strict=True)))
        room: list[int] = []
        filled = []
        order = tails.sort_values(["length", "part", "window", "offset"], ascending=[False, True, True, True])
        for row in order.itertuples(index=False):
            fits = [(r, i) for i, r in enumerate(room) if r >= row.length]
            if fits:
                i = min(fits)[1]
            else:
                room.append(size)
                i = len(room) - 1
            filled.append((i, size - room[i]))
            room[i] -= row.length
        if len(room) <= len(names):
            order = order.assign(part=[names[i][0] for i, _ in filled], window=[names[i][1] for i, _ in filled], offset=[o for _, o in filled])
        return order

    return run


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text", size: int = 1024, windows: int = 64) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    Pieces are written once to the shared folder, so that texts are encoded once.
    """
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, tail boolean, part long"
    pieces = materialize(narrow.mapInArrow(_pack_partition(tokenizer, ranks, pattern, size, windows), schema), "pieces")
    merged = pieces.where("tail").groupBy(F.floor(F.col("part") / MERGED_TOGETHER).alias("neighbours")).applyInPandas(_merge_tails(size), schema)
    return pieces.where("not tail").unionByName(merged).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("part") * F.lit(1 << 33) + F.col("window")).alias("sequence_id"), "offset")
