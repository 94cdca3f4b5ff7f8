"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are its only input. Every fourth byte starts a position; a filter's response there is the sum of
learned weights of the eight bytes at and after it, and of learned weights of how many of them repeat the byte ``lag``
before, for some lags. Positions are taken in overlapping chunks that together cover the whole document; rectified
responses are max-pooled in each chunk, then over all chunks (maximum and mean), and a small hidden layer combines them
into one probability.

The network is fitted on the driver on a bounded sample: at most ``max_rows`` labelled documents with at most
``max_bytes`` of text together, each read whole. Scoring reads every byte of every document; scores are rounded to six
places, so that they don't depend on which texts are scored together.

Defined cases: a null or empty text is one chunk of padding; without labels of both kinds every document gets the share of
good ones among the labels (0.5 without any); repeated rows get equal scores; an empty table gives an empty table; extra
columns are kept by ``score_column``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.arrow import SLICE_BYTES, buffers, slices, utf8
from lodestream.llm.common import fresh_name

WIDTH, STRIDE = 8, 4
CHUNK, STEP = 128, 112  # positions
LAGS = tuple(range(2, 24))
PAD = 32
THRESHOLD = 0.7


def layout(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded with zeros; first position and number of positions of each text."""
    ends, data = buffers(texts)
    n = np.diff(ends)
    positions = np.maximum(-(-n // STRIDE), 1)
    starts = np.concatenate([[0], np.cumsum(positions * STRIDE + PAD)])
    flat = np.zeros(int(starts[-1]) + PAD, dtype=np.uint8)
    for s, a, b in zip(starts[:-1].tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        flat[s : s + b - a] = data[a:b]
    return flat, starts[:-1] // STRIDE, positions


def repeats(flat: np.ndarray, count: int) -> np.ndarray:
    """For each of ``count`` positions and each lag: how many of the bytes at the position repeat the byte ``lag`` before."""
    out = np.zeros((count, len(LAGS)), dtype=np.float32)
    some = flat != 0
    for k, lag in enumerate(LAGS):
        same = np.zeros(len(flat), dtype=np.uint8)
        same[lag:] = (flat[lag:] == flat[:-lag]) & some[lag:]
        four = same[0::4] + same[1::4] + same[2::4] + same[3::4]
        out[:, k] = four[:count] + four[1 : count + 1]
    out *= 1 / WIDTH
    return out


def chunk_bounds(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first position in the text and end of each chunk."""
    chunks = np.maximum(-(-(positions - CHUNK) // STEP), 0) + 1
    text = np.repeat(np.arange(len(positions)), chunks)
    k = np.arange(int(chunks.sum())) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    return text, k * STEP, np.minimum(k * STEP + CHUNK, positions[text])


@dataclass
class Network:
    """The learned weights. ``constant`` stands in for all of them where nothing could be learned."""

    constant: float | None = None
    table: np.ndarray = field(default_factory=lambda: np.zeros((WIDTH, 256, 1), dtype=np.float32))
    lag: np.ndarray = field(default_factory=lambda: np.zeros((len(LAGS), 1), dtype=np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.float32))
    w1: np.ndarray = field(default_factory=lambda: np.zeros((2, 1), dtype=np.float32))
    b1: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.float32))
    w2: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.float32))
    b2: float = 0.0

    def responses(self, flat: np.ndarray, count: int) -> np.ndarray:
        out = repeats(flat, count) @ self.lag
        out += self.bias
        row = np.empty_like(out)
        for j in range(WIDTH):
            np.take(self.table[j], flat[j : j + STRIDE * count : STRIDE], axis=0, out=row)
            out += row
        return np.maximum(out, 0, out=out)

    def score(self, texts: pa.LargeStringArray) -> np.ndarray:
        if self.constant is not None or not len(texts):
            return np.full(len(texts), self.constant or 0.0)
        flat, first, positions = layout(texts)
        count = len(flat) // STRIDE - WIDTH // STRIDE
        text, begin, end = chunk_bounds(positions)
        index = np.empty(2 * len(text), dtype=np.int64)
        index[0::2], index[1::2] = first[text] + begin, first[text] + end
        pooled = np.maximum.reduceat(self.responses(flat, count), index, axis=0)[0::2]
        at = np.flatnonzero(np.diff(text, prepend=-1))
        features = np.hstack([np.maximum.reduceat(pooled, at, axis=0), np.add.reduceat(pooled, at, axis=0) / np.diff(np.append(at, len(text)))[:, None]])
        z = np.tanh(features @ self.w1 + self.b1) @ self.w2 + self.b2
        return np.round(1 / (1 + np.exp(-z.astype(np.float64))), 6)


def chunks_of(texts: pa.LargeStringArray) -> list[bytes]:
    """All chunks of each text, as equal blocks of CHUNK positions and the bytes around them."""
    flat, first, positions = layout(texts)
    text, begin, end = chunk_bounds(positions)
    flat = np.concatenate([np.zeros(PAD, dtype=np.uint8), flat])  # what stands before a chunk, for the lags
    out = []
    for own in np.split(np.arange(len(text)), np.flatnonzero(np.diff(text)) + 1) if len(texts) else []:
        t = text[own[0]]
        blocks = np.zeros((len(own), PAD + CHUNK * STRIDE + PAD), dtype=np.uint8)
        for r, c in enumerate(own.tolist()):
            s, n = int(first[t] + begin[c]) * STRIDE, int(end[c] - begin[c]) * STRIDE
            blocks[r, : PAD + n + WIDTH] = flat[s : s + PAD + n + WIDTH]
            if begin[c] == 0:
                blocks[r, :PAD] = 0
        out.append(blocks.tobytes())
    return out


#: Chunks whose responses a fit holds at a time.
AT_ONCE = 1024


def _pool(x: np.ndarray, p: dict[str, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each chunk and filter: the largest response, and the bytes and the lags' shares at its position."""
    windows = x[:, rows]  # chunks x positions x width
    real = x[:, PAD : PAD + CHUNK * STRIDE : STRIDE] != 0
    real[:, 0] = True
    lags = repeats(x.reshape(-1), x.size // STRIDE - 1).reshape(-1)
    lags = np.append(lags, np.zeros(len(LAGS), dtype=np.float32)).reshape(len(x), -1, len(LAGS))[:, PAD // STRIDE : PAD // STRIDE + CHUNK]
    r = lags @ p["lag"] + p["bias"]
    for j in range(WIDTH):
        r += p["table"][j][windows[:, :, j]]
    r = np.where(real[:, :, None], np.maximum(r, 0), 0)
    top = r.argmax(axis=1)  # chunks x filters
    c = np.arange(len(x))[:, None]
    return np.take_along_axis(r, top[:, None], axis=1)[:, 0], windows[c, top], lags[c, top]


def fit(samples: list[bytes], labels: list[int], filters: int = 16, hidden: int = 8, epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Fit the network to documents, each given as blocks of chunks_of, with Adam on the logistic loss."""
    y = np.array(labels, dtype=np.float32)
    if len(set(labels)) < 2:
        return Network(constant=float(y.mean()) if len(y) else 0.5)
    width = PAD + CHUNK * STRIDE + PAD
    blocks = [np.frombuffer(s, dtype=np.uint8).reshape(-1, width) for s in samples]
    rng = np.random.default_rng(seed)
    share = float(y.mean())
    p = {
        "table": rng.normal(0, 0.1, (WIDTH, 256, filters)), "lag": rng.normal(0, 0.3, (len(LAGS), filters)), "bias": np.zeros(filters),
        "w1": rng.normal(0, 0.3, (2 * filters, hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 0.3, hidden), "b2": np.array([np.log(share / (1 - share))]),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    rows = np.arange(CHUNK)[:, None] * STRIDE + np.arange(WIDTH) + PAD
    turn = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            x = np.concatenate([blocks[i] for i in own])
            doc = np.repeat(np.arange(len(own)), [len(blocks[i]) for i in own])
            at = np.flatnonzero(np.diff(doc, prepend=-1))
            n = np.diff(np.append(at, len(doc)))[:, None]
            pooled, seen, lagged = (np.concatenate(z) for z in zip(*[_pool(x[lo : lo + AT_ONCE], p, rows) for lo in range(0, len(x), AT_ONCE)], strict=True))
            best = np.maximum.reduceat(pooled, at, axis=0)
            features = np.hstack([best, np.add.reduceat(pooled, at, axis=0) / n])
            h = np.tanh(features @ p["w1"] + p["b1"])
            z = h @ p["w2"] + p["b2"]
            dz = (1 / (1 + np.exp(-z)) - y[own]) / len(own)
            g = {"w2": h.T @ dz, "b2": np.array([dz.sum()])}
            dh = dz[:, None] * p["w2"] * (1 - h * h)
            g["w1"], g["b1"] = features.T @ dh, dh.sum(axis=0)
            df = dh @ p["w1"].T
            first = pooled == best[doc]
            dp = np.where(first, df[doc, :filters], 0) + df[doc, filters:] / n[doc]
            dp *= pooled > 0
            f = np.broadcast_to(np.arange(filters), dp.shape)
            g["bias"] = dp.sum(axis=0)
            g["lag"] = np.einsum("cfl,cf->lf", lagged, dp)
            g["table"] = np.stack([np.bincount((seen[:, :, j].astype(np.int64) * filters + f).reshape(-1), dp.reshape(-1), 256 * filters).reshape(256, filters) for j in range(WIDTH)])
            turn += 1
            pace = rate * (1 if epoch < epochs * 0.7 else 0.3)
            for name, grad in g.items():
                grad = grad.astype(np.float32) + (1e-4 * p[name] if name in ("table", "lag", "w1") else 0)
                m[name] += 0.1 * (grad - m[name])
                v[name] += 0.001 * (grad * grad - v[name])
                p[name] -= pace * (m[name] / (1 - 0.9**turn)) / (np.sqrt(v[name] / (1 - 0.999**turn)) + 1e-8)
    return Network(None, p["table"], p["lag"], p["bias"], p["w1"], p["b1"], p["w2"], float(p["b2"][0]))


def held_out(key: Column) -> Column:
    """Whether a document's labels are kept from learning."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = 3000, max_bytes: int = 64 << 20, max_text: int = 4 << 20) -> Network:
    """Fit on at most max_rows labelled documents that aren't held out, in the order of a hash of their id, as long as their
    texts take at most max_bytes together.

    Of a document over max_text bytes nothing is learned (it is scored as a whole, like all others), so no single one can
    use up the room. If that leaves none of the labelled documents, training raises rather than return a network that knows
    nothing. The chosen ids are at most max_rows rows and are broadcast; what reaches the driver is their sizes, then the
    chunks of those that fit. A document labelled twice counts as good only if every label says so.
    """
    ours = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    marks = ours.groupBy(F.col("doc_id").alias("k")).agg(F.min("quality").cast("int").alias("quality"))

    narrow = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    chosen = marks.orderBy(F.xxhash64("k"), "k").limit(max_rows)
    sizes = narrow.join(F.broadcast(chosen.select(F.col("k").cast("long").alias("k"))), F.col("id") == F.col("k")).groupBy("k").agg(F.max(F.octet_length(F.coalesce("text", F.lit("")))).alias("n"))
    total, fitting, met = 0, [], 0
    for r in sizes.orderBy(F.xxhash64("k"), "k").collect():
        met += 1
        if r["n"] > min(max_text, max_bytes):
            continue
        total += r["n"]
        if total > max_bytes:
            break
        fitting.append((r["k"],))
    if met and not fitting:
        raise ValueError(f"all of the {met} labelled documents looked at are longer than {min(max_text, max_bytes)} bytes: raise max_text and max_bytes")
    ids = docs.sparkSession.createDataFrame(fitting, "fits long")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("quality"), pa.array(chunks_of(texts), pa.binary())], names=["k", "quality", "blocks"])

    chosen = chosen.withColumn("k", F.col("k").cast("long")).join(F.broadcast(ids), F.col("k") == F.col("fits"))
    found = narrow.join(F.broadcast(chosen), F.col("id") == F.col("k")).select("k", "quality", "text")
    rows = found.mapInArrow(sample, "k long, quality int, blocks binary").groupBy("k", "quality").agg(F.min("blocks").alias("blocks")).orderBy("k").collect()
    return fit([bytes(r["blocks"]) for r in rows], [int(r["quality"] > 0) for r in rows])


def score_column(text: Column, network: Network) -> Column:
    """The probability that a text is good; null and empty texts get one too."""

    @F.arrow_udf("double")
    def scored(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            column = utf8(array)
            ends, _ = buffers(column)
            out, at = [np.zeros(0)], 0
            while at < len(column):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES // 8, side="right")) - 1)
                out.append(network.score(column.slice(at, to - at)))
                at = to
            yield pa.array(np.concatenate(out))

    return scored(text)


def rate(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score and predicted, one row per document."""
    network = train(docs, labels, key, text)
    scored = docs.select(F.col(key), F.col(text).alias("__text")).withColumn("score", score_column(F.col("__text"), network))
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labelled: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are predicted to be good.

    ``labelled`` has the documents that the labels are about. It may hold more than docs: where earlier steps have taken
    the bad documents out of docs, nothing could be learned from docs alone. Without labels, or with labels of one class
    only, nothing can be told apart and all rows stay.
    """
    network = train(labelled, labels, key, text)
    if network.constant is not None:
        return docs
    score = fresh_name(docs, "score")
    return docs.withColumn(score, score_column(F.col(text), network)).where(F.col(score) >= THRESHOLD).drop(score)
