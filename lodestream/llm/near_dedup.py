"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

1. One pass over the texts makes each document's set of word shingles as 64-bit hashes, its fingerprint, and a min-max
   signature: from one permutation of the shingles both the smallest and the largest value are kept, which halves the
   hash evaluations. Bands of the signature are the candidates' buckets. Their number follows from the similarity, so
   that a pair right at the threshold shares no bucket with a chance of ``MISS`` only.
2. Documents with equal sets become one class, represented by the smallest id.
3. In each bucket the representative that shares most bucket places with others is the hub. It is compared with the
   bucket's other members whose sizes allow a link: stars, whose work grows with the members. A star with many members
   is dealt into parts, each with a copy of the hub.
4. Components of the links found so far close a bucket when all its members but the hub are in one of them. The members of
   the buckets that stay open form groups, directly or in a chain; in each group the sets are compared exactly, but for
   those of one component, by blocks: a group with more than ``BLOCK`` shingles is dealt into blocks, and every two blocks
   meet in a task of their own, whatever the group's size.
5. Connected components of all links give the result.

So any two representatives that share a bucket have been compared, or were linked before.

Defined cases: a null text, and one without words, has an empty set and is linked with nothing; a text with fewer words
than a shingle is one shingle; a row without doc_id is linked with nothing, has no component and is kept; repeated rows
get equal results; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.arrow import buffers, map_slices, slices
from lodestream.llm.common import discard, fresh_name, materialize
from lodestream.llm.components import connected_components

MISS = 1e-5
BLOCK = 32_000
BLOCK_ROWS = 256
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass(frozen=True)
class Measure:
    """width: words in a shingle; percent: least Jaccard similarity of a link; rows: signature values in a band."""

    width: int = 5
    percent: int = 80
    rows: int = 6

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** self.rows))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        n = max(n, 1 << 22)
        for name, base in (("up", _P), ("down", _P_INVERSE)):
            a = np.full(n, base, dtype=np.uint64)
            a[0] = 1
            _POWERS[name] = np.cumprod(a)
    return _POWERS["up"], _POWERS["down"]


_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(texts: pa.LargeStringArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, in order and with repeats, and where each text's shingles end.

    Word hashes are differences of one running polynomial over the bytes of all texts.
    """
    ends, data = buffers(texts)
    n = len(data)
    gap = np.ones(n + 2, dtype=bool)  # a separator before, after, and at each text's start
    gap[1:-1] = _SEPARATOR[data]
    inside = ~gap[1:-1]
    first = inside & gap[:-2]
    starts_at = ends[:-1][ends[:-1] < n]
    first[starts_at] = inside[starts_at]
    last = inside & gap[2:]
    stops_at = ends[1:][ends[1:] > 0] - 1
    last[stops_at] = inside[stops_at]
    begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n + 1)
    running = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=running[1:])
    words = mix((running[stop] - running[begin]) * down[begin], 1) + (stop - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    per_text = np.searchsorted(begin, ends)  # words before each text
    count = np.diff(per_text)
    n_shingles = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out_ends = np.concatenate([[0], np.cumsum(n_shingles)])
    if len(words) >= width:
        rolled = np.zeros(len(words) - width + 1, dtype=np.uint64)
        for k in range(width):
            rolled += mix(words[k : len(words) - width + 1 + k], 2 + k)
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, dtype=np.uint64)
    full = np.flatnonzero(count >= width)
    out = np.zeros(int(out_ends[-1]), dtype=np.uint64)
    place = np.repeat(per_text[full] - out_ends[full], n_shingles[full]) if len(full) else np.zeros(0, dtype=np.int64)
    at = np.repeat(out_ends[full], n_shingles[full]) + np.arange(int(n_shingles[full].sum())) - np.repeat(np.cumsum(n_shingles[full]) - n_shingles[full], n_shingles[full])
    out[at] = rolled[at + place]
    for i in np.flatnonzero((count > 0) & (count < width)):
        own = words[per_text[i] : per_text[i + 1]]
        out[out_ends[i]] = mix(np.array([sum(int(mix(own[k : k + 1], 2 + k)[0]) for k in range(len(own))) % 2**64], dtype=np.uint64), 100 + len(own))[0]
    return out, out_ends


def signatures(hashes: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket keys of texts with at least one shingle: one row each, one column a band."""
    half = math.ceil(bands * rows / 2)
    rng = np.random.default_rng(20240)
    a, b = rng.integers(0, 2**32, half, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, half, dtype=np.uint32)
    values = np.empty((len(ends) - 1, 2 * half), dtype=np.uint32)
    narrow = (hashes >> np.uint64(32)).astype(np.uint32)
    i = 0
    while i < len(ends) - 1:  # as many texts at a time as fit in a cache
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + 65536, side="right")) - 1)
        x, starts = narrow[ends[i] : ends[j]], ends[i:j] - ends[i]
        for k in range(half):
            h = x * a[k] + b[k]
            values[i:j, k] = np.minimum.reduceat(h, starts)
            values[i:j, half + k] = np.maximum.reduceat(h, starts)
        i = j
    keys = np.zeros((len(values), bands), dtype=np.uint64)
    for k in range(rows):
        keys = mix(keys ^ values[:, k : bands * rows : rows].astype(np.uint64), k)
    return mix(keys + np.arange(bands, dtype=np.uint64), 77)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def sign(docs: DataFrame, m: Measure) -> DataFrame:
    """doc_id, size of the shingle set, its 128-bit fingerprint and bucket keys. ``docs`` has doc_id and text."""
    width, bands, rows = m.width, m.bands, m.rows

    def work(batch: pa.RecordBatch, texts: pa.LargeStringArray) -> pa.RecordBatch:
        hashes, ends = shingle_hashes(texts, width)
        some = np.flatnonzero(np.diff(ends))
        sizes, f1, f2 = (np.zeros(len(texts), dtype=t) for t in (np.int64, np.uint64, np.uint64))
        for i in some:
            own = np.unique(hashes[ends[i] : ends[i + 1]])
            sizes[i], f1[i], f2[i] = len(own), mix(own, 11).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(own, 12))
        keys = signatures(hashes, np.append(ends[some], ends[-1]), bands, rows)
        has = np.diff(ends) > 0
        offsets = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists], schema=_SIGNED)

    return docs.mapInArrow(map_slices(work, "text"), "doc_id long, n long, f1 long, f2 long, bands array<long>")


def block_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, parts: list[int] | None = None) -> Iterator[tuple[int, int]]:
    """Links between two lists of sets, or within one (right None): places in left + right, a spanning forest of them.

    ``parts``: for each place the component that is known; sets of one component aren't compared.
    """
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    flags = np.zeros(int(codes.max()) + 1, dtype=np.int32)
    root = np.arange(len(sets)) if parts is None else np.unique(np.array(parts), return_inverse=True)[1]
    for i in range(len(left)):
        own = codes[starts[i] : starts[i] + sizes[i]]
        lo = len(left) if right is not None else i + 1
        if lo >= len(sets):
            break
        ratio = (np.minimum(sizes[lo:], sizes[i]) * 100 >= percent * np.maximum(sizes[lo:], sizes[i])) & (root[lo:] != root[i])
        if not ratio.any():
            continue
        flags[own] = 1
        shared = np.add.reduceat(flags[codes[starts[lo] :]], starts[lo:] - starts[lo])
        flags[own] = 0
        for j in np.flatnonzero(ratio & (100 * shared >= percent * (sizes[lo:] + sizes[i] - shared))) + lo:
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                yield i, int(j)


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])


def star_links(stars: DataFrame, m: Measure) -> DataFrame:
    """Links (a, b) between a hub and its members. ``stars``: hub, part, is_hub, doc_id, text; each part has its hub's row.

    A task holds one hub's set and a slice of the rows.
    """
    width, percent = m.width, m.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, dtype=np.uint64)
        for batch, texts in slices(batches, "text"):
            hashes, ends = shingle_hashes(texts, width)
            links = []
            for k, (hub, is_hub, doc) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("hub", "is_hub", "doc_id")], strict=True)):
                own = np.unique(hashes[ends[k] : ends[k + 1]])
                if is_hub:
                    centre = own
                elif len(own) and len(centre):
                    at = np.searchsorted(centre, own)
                    shared = int((centre[np.minimum(at, len(centre) - 1)] == own).sum())
                    if 100 * shared >= percent * (len(own) + len(centre) - shared):
                        links.append((hub, doc))
            if links:
                yield _link_batch(links)

    dealt = stars.repartition("hub", "part").sortWithinPartitions("hub", "part", F.desc("is_hub"), "doc_id")
    return dealt.select("hub", "is_hub", "doc_id", "text").mapInArrow(run, "a long, b long")


def confirmed_links(groups: DataFrame, m: Measure) -> DataFrame:
    """Links (a, b) among the members of each group. ``groups``: doc_id, text, grp, part, block, first, second.

    Rows with equal (grp, first, second) are compared in one place: block ``first`` with block ``second``. ``part`` is the
    component that a member is known to be in. A task holds the sets of two blocks and a slice of the rows, not their texts.
    """
    width, percent = m.width, m.percent

    def compare(rows: list[tuple[int, int, np.ndarray, int]], first: int, second: int) -> list[tuple[int, int]]:
        sides: list[list] = [[], []]
        ids: list[list] = [[], []]
        parts: list[list] = [[], []]
        for doc, block, own, part in rows:
            side = int(block != first)
            sides[side].append(own)
            ids[side].append(doc)
            parts[side].append(part)
        if first == second:
            return [(ids[0][i], ids[0][j]) for i, j in block_links(sides[0], None, percent, parts[0])] if len(ids[0]) > 1 else []
        if not ids[0] or not ids[1]:
            return []
        both = ids[0] + ids[1]
        return [(both[i], both[j]) for i, j in block_links(sides[0], sides[1], percent, parts[0] + parts[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, links = None, [], []
        for batch, texts in slices(batches, "text"):
            hashes, ends = shingle_hashes(texts, width)
            columns = [batch.column(c).to_pylist() for c in ("grp", "first", "second", "doc_id", "block", "part")]
            for k, (grp, first, second, doc, block, part) in enumerate(zip(*columns, strict=True)):
                own = np.unique(hashes[ends[k] : ends[k + 1]])
                if not len(own):  # a row without words that shares its id with another
                    continue
                if current != (grp, first, second):
                    if current is not None:
                        links += compare(rows, current[1], current[2])
                    current, rows = (grp, first, second), []
                rows.append((doc, block, own, part))
            if len(links) > 10_000:
                yield _link_batch(links)
                links = []
        if current is not None:
            links += compare(rows, current[1], current[2])
        if links:
            yield _link_batch(links)

    met = groups.repartition("grp", "first", "second").sortWithinPartitions("grp", "first", "second", "doc_id")
    return met.select("grp", "first", "second", "doc_id", "block", "text", "part").mapInArrow(run, "a long, b long")


def _stars(members: DataFrame, hubs: DataFrame, narrow: DataFrame, m: Measure, scratch: list[str]) -> DataFrame:
    """Links of the stars. ``members``: bucket, doc_id, n; ``hubs``: b (a bucket), hub, hub_n."""
    fits = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * m.percent
    pairs = members.join(hubs, F.col("bucket") == F.col("b")).where((F.col("doc_id") != F.col("hub")) & fits).select("hub", "doc_id", "n").distinct()
    pairs = materialize(pairs, "dedup-pairs", scratch)
    sizes = pairs.groupBy(F.col("hub").alias("h")).agg(F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.count("n") / BLOCK_ROWS)).cast("int").alias("parts"))
    sizes = materialize(sizes, "dedup-parts", scratch)
    rays = pairs.join(sizes, F.col("hub") == F.col("h")).select(F.col("doc_id").alias("member"), "hub", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("is_hub"))
    centres = sizes.select(F.col("h").alias("member"), F.col("h").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_hub"))
    placed = materialize(rays.unionByName(centres), "dedup-rays", scratch)
    return materialize(star_links(narrow.join(placed.hint("merge"), F.col("doc_id") == F.col("member")).select("hub", "part", "is_hub", "doc_id", "text"), m), "dedup-star-links", scratch)


def _rest(members: DataFrame, hubs: DataFrame, parts: DataFrame, narrow: DataFrame, m: Measure, scratch: list[str]) -> DataFrame:
    """Links among the members, but the hubs, of the buckets that the stars' components leave open."""
    others = members.join(hubs.select("b", "hub"), F.col("bucket") == F.col("b")).where("doc_id <> hub").select("bucket", "doc_id", "n")
    known = others.join(parts, F.col("doc_id") == F.col("node"), "left").select("bucket", "doc_id", "n", F.coalesce("component", "doc_id").alias("part"))
    known = materialize(known, "dedup-others", scratch)
    mixed = known.groupBy("bucket").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.min("doc_id").alias("first_id")).where("least < most").select(F.col("bucket").alias("b"), "first_id")
    mixed = materialize(mixed, "dedup-open", scratch)
    left = materialize(known.join(mixed, F.col("bucket") == F.col("b")).select("doc_id", "n", "part", "first_id").distinct(), "dedup-left", scratch)
    groups = connected_components(left.select(F.col("first_id").alias("a"), F.col("doc_id").alias("b")), "dedup-groups")
    sized = materialize(groups.join(left.select("doc_id", "n", "part").distinct(), F.col("node") == F.col("doc_id")).select("doc_id", "component", "n", "part"), "dedup-grouped", scratch)
    blocks = sized.groupBy("component").agg(F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.count("n") / BLOCK_ROWS)).cast("int").alias("blocks"))
    blocks = materialize(blocks.select(F.col("component").alias("grp"), "blocks"), "dedup-blocks", scratch)
    dealt = sized.join(blocks, F.col("component") == F.col("grp")).select(F.col("doc_id").alias("member"), "grp", "part", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"), "blocks")
    dealt = materialize(dealt, "dedup-dealt", scratch)
    source = narrow.join(dealt.hint("merge"), F.col("doc_id") == F.col("member"))
    meetings = source.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("doc_id", "text", "grp", "part", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    return materialize(confirmed_links(meetings, m), "dedup-links", scratch)


def near_duplicates(docs: DataFrame, m: Measure = Measure(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles, component_id and kept.

    Texts are joined to written tables of ids, which grow with the input and so are not broadcast, at any size: the texts
    are shuffled once for the stars and once for the rest.
    """
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = materialize(sign(narrow, m), "dedup-signed")
    named = signed.where("n > 0 and doc_id is not null")
    same = named.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most"))
    classes = materialize(same.where("rep < most").select(F.col("f1").alias("c1"), F.col("f2").alias("c2"), "rep"), "dedup-classes")
    member = signed.join(classes, (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2")), "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    scratch: list[str] = []
    reps = member.where("n > 0 and doc_id is not null and rep = doc_id").select("doc_id", "n", "bands")

    buckets = materialize(reps.select(F.explode("bands").alias("bucket"), "doc_id", "n"), "dedup-buckets", scratch)
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    shared = materialize(shared.select(F.col("bucket").alias("b"), "members"), "dedup-shared", scratch)
    members = materialize(buckets.join(shared, F.col("bucket") == F.col("b")).select("bucket", "doc_id", "n", "members"), "dedup-members", scratch)
    weight = materialize(members.groupBy(F.col("doc_id").alias("d")).agg(F.sum("members").alias("weight")), "dedup-weights", scratch)
    weighed = members.join(weight, F.col("doc_id") == F.col("d")).groupBy("bucket").agg(F.max(F.struct("weight", -F.col("doc_id"), "n")).alias("top"))
    hubs = materialize(weighed.select(F.col("bucket").alias("b"), (-F.col("top.col2")).alias("hub"), F.col("top.n").alias("hub_n")), "dedup-hubs", scratch)
    links = _stars(members.drop("members"), hubs, narrow, m, scratch)
    links = links.unionAll(_rest(members.drop("members"), hubs, connected_components(links, "dedup-stars"), narrow, m, scratch))

    parts = connected_components(links, "dedup-result")
    discard(narrow.sparkSession, scratch)
    out = member.select("doc_id", "n", "rep").join(parts, F.col("rep") == F.col("node"), "left")
    component = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, m: Measure = Measure(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of one document of each group; rows without an id stay.

    Rows that share an id and a text are one document: one of them stays, the first by a hash of all columns. An id that
    stands for different texts can't be judged as one document: its rows stay, each text once.
    """
    verdict = materialize(near_duplicates(docs, m, key, text), "dedup-verdict")
    gone, many = fresh_name(docs, "gone"), fresh_name(docs, "many")
    dropped = materialize(verdict.where("not kept").select(F.col(key).alias(gone)).distinct(), "dedup-gone")
    repeated = materialize(verdict.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(many)).count().where("count > 1").select(many), "dedup-repeated")
    if repeated.isEmpty():
        return docs.join(dropped, F.col(key) == F.col(gone), "left_anti")
    single = docs.join(repeated, F.col(key) == F.col(many), "left_anti").join(dropped, F.col(key) == F.col(gone), "left_anti")
    rank, kinds = fresh_name(docs, "rank"), fresh_name(docs, "kinds")
    several = docs.join(repeated, F.col(key) == F.col(many), "left_semi")
    first = Window.partitionBy(key, F.sha2(F.coalesce(text, F.lit("")), 256)).orderBy(F.xxhash64(*docs.columns))
    once = several.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).withColumn(kinds, F.count(F.lit(1)).over(Window.partitionBy(key)))
    judged = once.join(dropped.withColumn(rank + "d", F.lit(True)), F.col(key) == F.col(gone), "left").where((F.col(kinds) > 1) | F.col(rank + "d").isNull())
    return single.unionByName(judged.select(*[F.col(f"`{c}`") for c in docs.columns]))
