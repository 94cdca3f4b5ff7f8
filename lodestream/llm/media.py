"""Telephony audio as media columns: mu-law and A-law by lookup tables, ADPCM by blocks in numpy, resampled PCM.

A media column holds RIFF/WAVE files. ``encode_payload`` stores any bytes as the 8-bit mu-law samples of such a file,
losslessly; ``decode`` reads one back and gives 16-bit samples; ``at_rate`` changes their rate by an integer factor, and
``store`` makes a table of both columns, the media and the resampled PCM, which ``describe`` reads back.

Defined cases: a null text is an empty one, whose payload is one unit of zero bytes; equal texts give equal files and
features; an empty table gives an empty table; extra columns are ignored. Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from lodestream.llm.arrow import SLICE_BYTES, buffers, map_slices
from lodestream.llm.common import materialize

UNIT = 64
RATE = 8000
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17  # format tags


def mulaw_table() -> np.ndarray:
    """Samples of the 256 mu-law codes (G.711)."""
    code = ~np.arange(256) & 0xFF
    level = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -level, level).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Samples of the 256 A-law codes (G.711)."""
    code = np.arange(256) ^ 0x55
    segment, step = code >> 4 & 7, (code & 15) << 4
    level = np.where(segment == 0, step + 8, (step + 264) << np.maximum(segment - 1, 0))
    return np.where(code & 128, level, -level).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}

#: Changes of the step index by the low three bits of an ADPCM code, and the 89 step sizes (IMA).
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)
IMA_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int32,
)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks (rows of bytes): the header's and two for each byte after it, a row per block.

    One step of the loop decodes the same nibble of all blocks; what a block decodes to depends on its own bytes only.
    """
    predictor = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out = np.empty((1 + 2 * (blocks.shape[1] - 4), len(blocks)), dtype=np.int16)
    out[0] = predictor
    for k in range(4, blocks.shape[1]):
        column = blocks[:, k]
        for half, code in enumerate((column & 15, column >> 4)):
            step, low = IMA_STEPS[index], (code & 7).astype(np.int32)
            change = (step >> 3) + np.where(low & 4, step, 0) + np.where(low & 2, step >> 1, 0) + np.where(low & 1, step >> 2, 0)
            predictor = np.clip(np.where(code & 8, predictor - change, predictor + change), -32768, 32767)
            index = np.clip(index + IMA_INDEX[low], 0, 88)
            out[1 + 2 * (k - 4) + half] = predictor
    return out.T


def resample(samples: np.ndarray, factor: int = 2) -> np.ndarray:
    """Samples at ``factor`` times the rate, by linear interpolation in integers; the last sample is held."""
    wide = samples.astype(np.int32)
    after = np.append(wide[1:], wide[-1:])
    out = np.empty((len(wide), factor), dtype=np.int16)
    for k in range(factor):
        out[:, k] = (wide * (factor - k) + after * k) // factor
    return out.reshape(-1)


def decimate(samples: np.ndarray, factor: int = 2) -> np.ndarray:
    """Samples at 1 / ``factor`` of the rate: means of neighbours, rounded down; the last group may be short."""
    wide = samples.astype(np.int64)
    starts = np.arange(0, len(wide), factor)
    return (np.add.reduceat(wide, starts) // np.diff(np.append(starts, len(wide)))).astype(np.int16) if len(wide) else samples


def at_rate(samples: np.ndarray, rate: int, wanted: int) -> np.ndarray:
    if wanted % rate == 0:
        return resample(samples, wanted // rate)
    if rate % wanted == 0:
        return decimate(samples, rate // wanted)
    raise ValueError(f"{rate} and {wanted} samples a second are no multiples of each other")


def wave(tag: int, data: bytes, rate: int = RATE, bits: int = 8, align: int | None = None) -> bytes:
    """A mono RIFF/WAVE file."""
    align = align or bits // 8
    extra = struct.pack("<HH", 2, 1 + 2 * (align - 4)) if tag == IMA else b"" if tag == PCM else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", tag, 1, rate, rate * align // (1 + 2 * (align - 4)) if tag == IMA else rate * align, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def pcm_wave(samples: np.ndarray, rate: int) -> bytes:
    return wave(PCM, samples.astype("<i2").tobytes(), rate, 16)


def read_wave(media) -> tuple[int, int, int, memoryview]:
    """Format tag, rate, block size and data of a mono RIFF/WAVE file; other chunks are skipped."""
    view = memoryview(media)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= len(view):
        name, n = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", view, at + 8)
        elif name == b"data" and form:
            if at + 8 + n > len(view):
                raise ValueError("the data chunk is cut off")
            return form[0], form[2], form[4], view[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def decode(media) -> tuple[np.ndarray, int]:
    """16-bit samples and rate of a mono file in PCM, mu-law, A-law or IMA ADPCM."""
    tag, rate, align, data = read_wave(media)
    raw = np.frombuffer(data, dtype=np.uint8)
    if tag in TABLES:
        return TABLES[tag][raw], rate
    if tag == IMA:
        return decode_adpcm(raw[: len(raw) // align * align].reshape(-1, align)).reshape(-1), rate
    if tag == PCM:
        return raw.view("<i2"), rate
    raise ValueError(f"format {tag} is not supported")


def encode_payload(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and a media column: the text's UTF-8, padded to a multiple of UNIT bytes, as mu-law samples."""
    kind = docs.schema[key].dataType
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def work(batch: pa.RecordBatch, texts: pa.LargeStringArray) -> pa.RecordBatch:
        ends, data = buffers(texts)
        n = np.diff(ends)
        files = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            size = max(UNIT, -(-(b - a) // UNIT) * UNIT)
            files.append(wave(MULAW, data[a:b].tobytes().ljust(size, b"\0")))
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(files, pa.binary())], names=["key", "n_bytes", "media"])

    return narrow.mapInArrow(map_slices(work, "text"), StructType().add("key", kind).add("n_bytes", LongType()).add("media", BinaryType()))


def _levels(name: str, samples: np.ndarray, ends: np.ndarray) -> list[str]:
    """For each segment of samples: root mean square, peak and sign changes in thousandths, all in integers."""
    starts, n = ends[:-1], np.diff(ends)
    wide = samples.astype(np.int64)
    power = np.add.reduceat(wide * wide, starts) // n
    peak = np.maximum.reduceat(np.abs(wide), starts)
    turn = np.zeros(len(samples), dtype=np.int64)
    turn[1:] = (samples[1:] < 0) != (samples[:-1] < 0)
    turn[starts] = 0
    turns = np.add.reduceat(turn, starts) * 1000 // n
    return [f"{name}:rms={int(np.sqrt(p))},peak={k},zc={t}" for p, k, t in zip(power.tolist(), peak.tolist(), turns.tolist(), strict=True)]


def features(payloads: list[np.ndarray]) -> list[str]:
    """A feature string for each payload: its bytes read as mu-law, as A-law and as ADPCM blocks of UNIT bytes.

    The payloads are decoded together, the ADPCM blocks of all of them side by side.
    """
    flat = np.concatenate(payloads)
    ends = np.concatenate([[0], np.cumsum([len(p) for p in payloads])])
    adpcm = decode_adpcm(flat.reshape(-1, UNIT))
    read = [("ulaw", TABLES[MULAW][flat], ends), ("alaw", TABLES[ALAW][flat], ends), ("adpcm", adpcm.reshape(-1), ends // UNIT * adpcm.shape[1])]
    return [";".join(x) for x in zip(*[_levels(*r) for r in read], strict=True)]


def store(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = 2 * RATE) -> DataFrame:
    """Write key, n_bytes, media and pcm to the shared folder; pcm is the decoded media, resampled, as a PCM file."""
    media = encode_payload(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = []
                for x in part.column("media"):
                    samples, own = decode(x.as_buffer())
                    made.append(pcm_wave(at_rate(samples, own, rate), rate))
                yield part.append_column("pcm", pa.array(made, pa.binary()))

    return materialize(media.mapInArrow(run, StructType([*media.schema.fields, StructField("pcm", BinaryType())])), "media", level=6)


def describe(media: DataFrame, key: str = "key") -> DataFrame:
    """Read a table of ``store`` back: key, n_bytes, payload and media digests, features, samples and digest of the PCM."""

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        files = [memoryview(x.as_buffer()) for x in batch.column("media")]
        payloads = [np.frombuffer(read_wave(f)[3], dtype=np.uint8) for f in files]
        rows = []
        for file, payload, text, pcm in zip(files, payloads, features(payloads), batch.column("pcm"), strict=True):
            samples, _ = decode(pcm.as_buffer())
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), text, len(samples), hashlib.sha256(pcm.as_buffer()).hexdigest()))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(key), batch.column("n_bytes"), *columns], names=["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_samples", "pcm_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, total = 0, 0
            for i, n in enumerate(pc.binary_length(batch.column("media")).to_pylist()):
                if i > at and total + n > SLICE_BYTES // 2:
                    yield some(batch.slice(at, i - at))
                    at, total = i, 0
                total += n
            if at < batch.num_rows:
                yield some(batch.slice(at))

    schema = StructType().add("key", media.schema[key].dataType)
    for name in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_samples", "pcm_sha256"):
        schema = schema.add(name, "string" if name.endswith("sha256") or name == "feature" else "long")
    return media.mapInArrow(run, schema)


def profile(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = 2 * RATE) -> DataFrame:
    """Store every text as media and as PCM of ``rate`` samples a second, and describe what is read back."""
    return describe(store(docs, key, text, rate)).withColumnRenamed("key", key)
