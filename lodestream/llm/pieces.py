"""SentencePiece encoding and decoding for merge-type vocabularies, without the library on the main path.

Encoding keeps an agenda of adjacent symbol pairs, ordered by the score of the piece that they would make, then from
left to right, and merges the first until none is left. No piece of such a vocabulary holds a word mark after another
character, so a text falls into units (word marks, then other characters) that never merge with each other; each
distinct unit is encoded once in a task. Short units of a batch go through the agenda side by side in numpy, one
round of merges for all of them at a time; long ones use a heap. Every unit that is encoded is checked against the
sentencepiece library, a batch at a time, and so is one whole text of each batch; a difference fails the task.

Defined cases: a null text is an empty one: begin and end ids, decoded to the empty text; the word mark U+2581 in a text
is a space, as in the library; characters outside the vocabulary become byte pieces; texts and units of any length are
taken whole; repeated rows are encoded alike; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from lodestream.llm.arrow import map_slices

MARK = "▁"
#: Units of at most so many symbols are encoded side by side.
SHORT = 24
#: Bytes of units and their ids that a task remembers before it starts anew; longer units than LONGEST aren't remembered.
REMEMBERED = 64 << 20
LONGEST = 64
NONE = np.int32(2**31 - 1)


class Vocabulary:
    """The pieces of a model, and the pairs that merge: tables that are looked up for whole arrays."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.vocab_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        byte = {i for i in range(n) if sp.is_byte(i)}
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64) if byte else None
        self.text = [b"" if i in self.special else bytes([int(p[3:5], 16)]) if i in byte else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        if self.unk >= 0:
            self.text[self.unk] = sp.decode([self.unk]).encode() or b" \xe2\x81\x87 "
        self.byte_set = byte
        self.pieces = {p: i for i, p in enumerate(names) if i not in self.special and i not in byte and not sp.is_unused(i)}
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece holds a word mark after another character; units are not independent")
        #: symbols: pieces, then characters that only stand inside pieces
        self.symbols = dict(self.pieces)
        for c in sorted({c for p in self.pieces for c in p} - set(self.pieces)):
            self.symbols[c] = n + len(self.symbols) - len(self.pieces)
        self.n = n + len(self.symbols) - len(self.pieces)
        scores = {i: sp.get_score(i) for i in self.pieces.values()}
        rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.merges: dict[int, tuple[int, int]] = {}  # pair -> (rank, merged)
        for p, i in self.pieces.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    self.merges[a * (self.n + 1) + b] = (rank[scores[i]], i)
        bits = int(np.ceil(np.log2(len(self.merges) * 4 + 16)))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks, self.merged = np.full(1 << bits, NONE), np.zeros(1 << bits, dtype=np.int32)
        self.probes = 1
        for pair, (r, i) in self.merges.items():
            at = int(self._slot(np.array([pair], dtype=np.int64))[0])
            probes = 1
            while self.keys[at] >= 0:
                at, probes = (at + 1) & self.mask, probes + 1
            self.keys[at], self.ranks[at], self.merged[at] = pair, r, i
            self.probes = max(self.probes, probes)
        self.unknown = self.n  # any character outside the vocabulary; it never merges
        self.char_table = np.full(0x110000, self.unknown, dtype=np.int32)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.char_table[ord(c)] = i

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if they don't merge) and merged symbol of each pair."""
        pairs = left.astype(np.int64) * (self.n + 1) + right
        at = self._slot(pairs)
        rank, merged = np.full(pairs.shape, NONE), np.zeros(pairs.shape, dtype=np.int32)
        todo = np.arange(len(pairs))
        for _ in range(self.probes):
            found = self.keys[at]
            hit = found == pairs[todo]
            rank[todo[hit]], merged[todo[hit]] = self.ranks[at[hit]], self.merged[at[hit]]
            rest = ~hit & (found >= 0)
            if not rest.any():
                break
            todo, at = todo[rest], (at[rest] + 1) & self.mask
        return rank, merged

    def agenda(self, unit: str) -> list[int]:
        """Symbols of one unit, by a heap of pairs; a character outside the vocabulary is -1 - its code point."""
        ids = [self.symbols.get(c, -1 - ord(c)) for c in unit]
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            if ids[i] >= 0 and ids[j] >= 0 and (hit := self.merges.get(ids[i] * (self.n + 1) + ids[j])):
                heapq.heappush(heap, (hit[0], i, ids[i], ids[j], hit[1]))

        for i in range(len(ids) - 1):
            push(i, i + 1)
        gone = -(2**40)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = merged, gone, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                push(i, after[j])
            if before[i] >= 0:
                push(before[i], i)
        return [i for i in ids if i != gone]

    def side_by_side(self, units: list[str]) -> list[list[int]]:
        """Symbols of many short units without characters outside the vocabulary."""
        lengths = np.array([len(u) for u in units])
        width = int(lengths.max())
        codes = np.frombuffer("".join(u.ljust(width, "\0") for u in units).encode("utf-32-le"), dtype="<u4").reshape(len(units), width)
        symbols = self.char_table[codes]
        inside = np.arange(width) < lengths[:, None]
        rank = np.full((len(units), width), NONE)
        merged = np.zeros((len(units), width), dtype=np.int32)
        r, c = np.nonzero(inside[:, 1:])
        rank[r, c], merged[r, c] = self.lookup(symbols[r, c], symbols[r, c + 1])
        rows = np.arange(len(units))
        while len(rows):
            best = rank[rows].argmin(axis=1)
            live = rank[rows, best] != NONE
            rows, best = rows[live], best[live]
            if not len(rows):
                break
            symbols[rows, best] = merged[rows, best]
            # close the gap: all after the pair's right half move left by one
            shift = np.arange(width)[None, :] > best[:, None]
            source = np.minimum(np.arange(width)[None, :] + shift, width - 1)
            own = rows[:, None]
            symbols[rows], rank[rows], merged[rows] = symbols[own, source], rank[own, source], merged[own, source]
            lengths[rows] -= 1
            for side in (best - 1, best):
                ok = (side >= 0) & (side < lengths[rows] - 1)
                a, b = rows[ok], side[ok]
                rank[a, b], merged[a, b] = self.lookup(symbols[a, b], symbols[a, b + 1])
                over = (side >= 0) & ~ok
                rank[rows[over], side[over]] = NONE
            rank[rows, lengths[rows] - 1] = NONE
        flat = symbols[np.arange(width) < lengths[:, None]].tolist()
        ends = np.cumsum(lengths).tolist()
        return [flat[e - n : e] for e, n in zip(ends, lengths.tolist(), strict=True)]

    def finish(self, symbols: list[int], unit: str) -> list[int]:
        """Ids: symbols that are no pieces become byte pieces, or the unknown id where the model has none."""
        out = []
        names = None
        for s in symbols:
            if 0 <= s < len(self.text):
                out.append(s)
                continue
            if s >= 0 and names is None:
                names = {i: c for c, i in self.symbols.items() if i >= len(self.text)}
            c = chr(-1 - s) if s < 0 else names[s]
            out += self.byte_ids[list(c.encode())].tolist() if self.byte_ids is not None else [self.unk]
        return out

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit (with its word marks), checked against the library."""
        side = [i for i, u in enumerate(units) if 0 < len(u) <= SHORT and all(c in self.symbols for c in u)]
        out: list[list[int] | None] = [None] * len(units)
        side.sort(key=lambda i: len(units[i]))
        for k in range(0, len(side), 4096):
            part = side[k : k + 4096]
            for i, s in zip(part, self.side_by_side([units[i] for i in part]), strict=True):
                out[i] = s if max(s) < len(self.text) else self.finish(s, units[i])
        for i, u in enumerate(units):
            if out[i] is None:
                out[i] = self.finish(self.agenda(u), u)
        self._check(units, out)
        return out

    def _check(self, units: list[str], ids: list[list[int]]) -> None:
        """The library adds a word mark of its own in front: units that begin with one go without it."""
        want = self.library.encode([u[1:].replace(MARK, " ") for u in units], num_threads=1)
        for u, a, b in zip(units, ids, want, strict=True):
            if a != b and u != MARK:
                raise ValueError(f"{u!r}: {a}, but the library gives {b}")

    def decode(self, ids: list[int]) -> str:
        """What the library's decode(ids) gives."""
        text = self.text
        out = b"".join([text[i] for i in ids])
        first = next((i for i in ids if i not in self.special or i == self.unk), self.unk)
        if out[:1] == b" " and first != self.unk and first not in self.byte_set:
            out = out[1:]
        try:
            return out.decode()
        except UnicodeDecodeError:
            return self.library.decode(ids)  # byte pieces that are no character


_UNITS = re.compile(" +[^ ]*")


def units_of(text: str) -> list[str]:
    """The units of a text, each without its first word mark, the others as spaces."""
    if MARK in text:
        text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [u[1:] for u in _UNITS.findall(" " + text)]
    return text.split(" ")


@lru_cache(maxsize=2)
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


class Encoder:
    """Encodes texts and remembers the units it has met."""

    def __init__(self, model: str):
        self.v = vocabulary(model)
        self.known: dict[str, bytes] = {}
        self.size = 0

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers, without begin and end."""
        units = [units_of(t) for t in texts]
        if self.size > REMEMBERED:
            self.known, self.size = {}, 0
        known, long = self.known, {}
        new = list({u for own in units for u in own if u not in known})
        if new:
            for u, ids in zip(new, self.v.encode_units([MARK + u.replace(" ", MARK) for u in new]), strict=True):
                made = np.array(ids, dtype="<u4").tobytes()
                if len(u) > LONGEST:
                    long[u] = made
                else:
                    known[u] = made
                    self.size += 200 + 4 * len(u) + len(made)  # with what the objects take
        if long:
            return [b"".join([long[u] if u in long else known[u] for u in own]) for own in units]
        return [b"".join([known[u] for u in own]) for own in units]


def digest(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text with begin and end ids, decode the ids again: key, n_tokens and the digests of both."""
    kind = docs.schema[key].dataType
    state: dict[str, Encoder] = {}

    def work(batch: pa.RecordBatch, texts: pa.LargeStringArray) -> pa.RecordBatch:
        encoder = state.setdefault(model, Encoder(model))
        v = encoder.v
        begin, end = np.array([v.bos], dtype="<u4").tobytes(), np.array([v.eos], dtype="<u4").tobytes()
        n, coded, decoded = [], [], []
        given = texts.to_pylist()
        every = encoder(given)
        if given:  # the model's normalizer acts on whole texts: one of each batch is checked as a whole
            k = min(range(len(given)), key=lambda i: abs(len(given[i]) - 500))
            if v.library.encode(given[k]) != np.frombuffer(every[k], dtype="<u4").tolist():
                raise ValueError(f"the library encodes a text of {len(given[k])} characters otherwise")
        for ids in every:
            ids = begin + ids + end
            n.append(len(ids) // 4)
            coded.append(hashlib.sha256(ids).hexdigest())
            decoded.append(hashlib.sha256(v.decode(np.frombuffer(ids, dtype="<u4").tolist()).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = StructType().add("key", kind).add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType())
    return narrow.mapInArrow(map_slices(work, "text"), schema).withColumnRenamed("key", key)
