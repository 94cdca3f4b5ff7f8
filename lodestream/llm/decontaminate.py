"""Benchmark passages in training documents, found in a positional inverted index that is spread over shards.

A shard of the index holds a few megabytes of whole documents: the list of addresses of each term, the documents' keys
and first addresses. An address is a word's place in the shard; GAP addresses that no word has lie between documents, so
nothing is found across them. A document is in one shard whole, so phrases are found without a shuffle.

The test side is the distinct windows of the items' words. In a shard only windows whose terms all have lists are
looked at; the list of a window's rarest term there, less the term's offset, gives the places where it may start, and
these are intersected with the offset-adjusted list of the next rarest, and so on. For exact matches every term stands at
its offset; for proximity matches within SLOP words of it.

Windows are handed to the tasks in blocks of at most BLOCK_BYTES; a larger benchmark takes several scans of the index,
whose results are joined by document. Only a benchmark of one block restricts the stored terms to its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.arrow import buffers, ragged, slices
from lodestream.llm.common import ascii_lower, discard, materialize

WIDTH = 10
SLOP = 2
GAP = WIDTH + 2 * SLOP
BLOCK_BYTES = 8 << 20
#: Longer terms are kept as a digest, so that a window has a bounded size.
TERM_BYTES = 64
#: So many places are tried at a time.
TRIED = 1 << 20
#: A long text is split into words in pieces of about so many bytes.
PIECE = 1 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _short(term: bytes) -> bytes:
    """A term of bounded length; no word has a blank."""
    return term if len(term) <= TERM_BYTES else b"sha256 " + hashlib.sha256(term).hexdigest().encode()


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in pieces; a piece ends at the end of a word."""
    at = 0
    while at < len(text):
        end = BREAK.search(text, at + PIECE)
        to = end.end() if end else len(text)
        yield WORD.findall(text[at:to].lower())
        at = to


def windows(benchmark: DataFrame, item_group: int = 1000) -> DataFrame:
    """(terms, items, size): each distinct window of the items, the ids (as strings) of items that have it, and its bytes.

    A window is WIDTH consecutive words; an item of fewer words, but not none, is one window. A null text has no words;
    rows without item_id are left out; rows of one item_id are one item with the windows of each. A window of very many
    items comes in several rows of about ``item_group`` items.
    """
    clean = F.regexp_replace(F.regexp_replace(ascii_lower(F.coalesce("text", F.lit(""))), NO_WORD, " "), "^ | $", "")
    words = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), clean.alias("clean")).where("clean <> ''")
    salts = words.count() // item_group + 1
    words = words.select("item", F.transform(F.split("clean", " "), lambda w: F.when(F.octet_length(w) <= TERM_BYTES, w).otherwise(F.concat(F.lit("sha256 "), F.sha2(w, 256)))).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - WIDTH + 1, F.lit(1)))
    each = words.select("item", "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at"), WIDTH).alias("terms"))
    grouped = each.groupBy("terms", F.pmod(F.xxhash64("item"), F.lit(salts)).alias("salt")).agg(F.collect_set("item").alias("items"))
    length = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 8)
    return grouped.select("terms", "items", (length("terms") + length("items")).alias("size"))


def blocks_of(benchmark: DataFrame, scratch: list[str], limit: int = BLOCK_BYTES) -> list[DataFrame]:
    """The windows in blocks of at most ``limit`` bytes each."""
    found = materialize(windows(benchmark), "benchmark-windows", scratch)
    n = -(-(found.agg(F.sum("size")).first()[0] or 0) // limit) or 1
    while True:
        dealt = found.withColumn("block", F.pmod(F.xxhash64("terms", "items"), F.lit(n)))
        if (dealt.groupBy("block").agg(F.sum("size").alias("size")).agg(F.max("size")).first()[0] or 0) <= limit:
            return [dealt.where(F.col("block") == k) for k in range(n)]
        n *= 2


class Block(NamedTuple):
    """Windows as tasks get them: terms are numbered, -1 stands behind a short window's end; items by number as well."""

    numbers: dict[bytes, int]
    terms: np.ndarray
    item_sets: list[list[str]]
    set_of: np.ndarray


def make_block(rows: list) -> Block:
    numbers: dict[bytes, int] = {}
    sets: dict[tuple[str, ...], int] = {}
    terms = np.full((len(rows), WIDTH), -1, dtype=np.int64)
    set_of = np.zeros(len(rows), dtype=np.int64)
    for k, row in enumerate(rows):
        terms[k, : len(row["terms"])] = [numbers.setdefault(t.encode(), len(numbers)) for t in row["terms"]]
        set_of[k] = sets.setdefault(tuple(row["items"]), len(sets))
    return Block(numbers, terms, [list(s) for s in sets], set_of)


INDEX = pa.schema(
    [("terms", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("addresses", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int32())), ("n_words", pa.list_(pa.int64()))]
)
INDEX_SCHEMA = "terms array<binary>, lengths array<int>, addresses array<int>, keys array<long>, firsts array<int>, n_words array<long>"


def index(docs: DataFrame, only: dict[bytes, int] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per shard: its terms with the lengths and the addresses of their lists, and its documents.

    ``only`` are the terms to store; without it all are. A null text has no words. Every document is in one shard.
    """
    kept = docs.sparkSession.sparkContext.broadcast(only) if only is not None else None

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            yield _shard(batch.column("key"), texts, kept.value if kept else None)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(shards, INDEX_SCHEMA)


def _shard(keys: pa.Array, texts: pa.LargeStringArray, only: dict[bytes, int] | None) -> pa.RecordBatch:
    ends, data = buffers(texts)
    whole = data.tobytes()
    numbers = only if only is not None else {}
    long_terms = only is None or any(t.startswith(b"sha256 ") for t in only)
    found, firsts, counts, at = [], [], [], 0
    for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        firsts.append(at)
        n = 0
        for words in words_of(whole[begin:end]):
            if long_terms:
                words = [_short(w) for w in words]
            if only is None:
                own = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
            else:
                own = np.fromiter(map(numbers.get, words, repeat(-1)), np.int64, len(words))
            places = np.flatnonzero(own >= 0)
            found.append((own[places] << 32) | (places + at + n))
            n += len(words)
        counts.append(n)
        at += n + GAP
    if at > 2**31 - 1:
        raise ValueError("a document has more words than an address can count")
    postings = np.sort(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    present, lengths = np.unique(postings >> 32, return_counts=True)
    names = list(numbers)
    row = [[[names[t] for t in present]], [lengths.astype(np.int32)], [(postings & 0xFFFFFFFF).astype(np.int32)], [keys.to_pylist()], [np.array(firsts, dtype=np.int32)], [np.array(counts, dtype=np.int64)]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, INDEX, strict=True)], schema=INDEX)


def _starts(terms: np.ndarray, postings: np.ndarray, sizes: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, address) of all places where the windows match, each term within ``slop`` of its offset.

    ``postings`` are the sorted term << 32 | address of the shard, ``sizes`` the length of each term's list.
    """
    wanted = terms >= 0
    lengths = np.where(wanted, sizes[terms], np.iinfo(np.int64).max)
    live = np.flatnonzero(((lengths > 0) | ~wanted).all(axis=1))
    order = np.argsort(lengths[live], axis=1, kind="stable")
    rarest = order[:, 0] if len(live) else np.zeros(0, dtype=np.int64)
    tries = np.take_along_axis(lengths[live], order[:, :1], axis=1)[:, 0] * (2 * slop + 1) if len(live) else np.zeros(0, dtype=np.int64)
    batch = np.cumsum(tries) // TRIED
    for b in np.unique(batch):
        some = np.flatnonzero(batch == b)
        term = terms[live[some], rarest[some]]
        own = ragged(np.searchsorted(postings, term << 32), sizes[term])
        window = np.repeat(some, sizes[term])
        address = (postings[own] & 0xFFFFFFFF) - rarest[window]
        if slop:
            shift = np.arange(-slop, slop + 1)
            window, address = np.repeat(window, len(shift)), (address[:, None] + shift).ravel()
        for rank in range(1, WIDTH):
            offset = order[window, rank]
            other = terms[live[window], offset]
            low = np.searchsorted(postings, (other << 32) + np.maximum(address + offset - slop, 0))
            near = postings[np.minimum(low, len(postings) - 1)]
            hit = (other < 0) | ((low < len(postings)) & (near >> 32 == other) & ((near & 0xFFFFFFFF) <= address + offset + slop))
            window, address = window[hit], address[hit]
            if not len(window):
                break
        if len(window):
            yield live[window], address


PART = pa.schema([("shard", pa.int64()), ("place", pa.int32()), ("key", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])
PART_SCHEMA = "shard long, place int, key long, n_words long, hits array<struct<start: int, end: int>>, items array<string>, near array<string>"


def _by_document(found: list[tuple[np.ndarray, np.ndarray]], firsts: np.ndarray, block: Block) -> dict[int, list[str]]:
    """The sorted items that have a match in each document of a shard."""
    pairs: set[tuple[int, int]] = set()
    for window, address in found:
        place = np.searchsorted(firsts, address, side="right") - 1
        pairs.update(map(tuple, np.unique(np.stack([place, block.set_of[window]], axis=1), axis=0).tolist()))
    items: dict[int, set[str]] = {}
    for place, number in pairs:
        items.setdefault(place, set()).update(block.item_sets[number])
    return {place: sorted(names) for place, names in items.items()}


def _covered(found: list[tuple[np.ndarray, np.ndarray]], widths: np.ndarray) -> np.ndarray:
    """The disjoint sorted spans [start, end) of addresses inside any match; spans of two documents never touch."""
    if not found:
        return np.zeros((0, 2), dtype=np.int64)
    start = np.concatenate([a for _, a in found])
    end = start + np.concatenate([widths[w] for w, _ in found])
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return np.stack([start[new], end[np.concatenate([new[1:], [True]])]], axis=1)


def search(shards: DataFrame, block: Block) -> DataFrame:
    """One row per document: shard, place, key, n_words, hits (spans of words), items and near (ids of matching items).

    ``shards`` is a stored index with a column shard. ``near`` are the items with a proximity match, exact ones included.
    """
    sent = shards.sparkSession.sparkContext.broadcast(block)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _search_shard({name: batch.column(name)[k] for name in batch.schema.names}, sent.value)

    return shards.mapInArrow(look, PART_SCHEMA)


def _search_shard(shard: dict[str, pa.Scalar], block: Block) -> pa.RecordBatch:
    array = lambda name: shard[name].values.to_numpy(zero_copy_only=False)
    number = np.array([block.numbers.get(t, -1) for t in shard["terms"].as_py()], dtype=np.int64)
    postings = (np.repeat(number, array("lengths")) << 32) | array("addresses").astype(np.int64)
    postings = np.sort(postings[postings >= 0])
    sizes = np.bincount(postings >> 32, minlength=len(block.numbers) + 1)
    firsts = array("firsts").astype(np.int64)
    exact = list(_starts(block.terms, postings, sizes, 0)) if len(postings) else []
    near = list(_starts(block.terms, postings, sizes, SLOP)) if len(postings) else []
    # a place may lie up to SLOP words before its document
    items, nearby = _by_document(exact, firsts, block), _by_document([(w, a + SLOP) for w, a in near], firsts, block)
    spans = _covered(exact, (block.terms >= 0).sum(axis=1))
    place = np.searchsorted(firsts, spans[:, 0], side="right") - 1
    hits: dict[int, list[dict]] = {}
    for p, (start, end) in zip(place.tolist(), (spans - firsts[place][:, None]).tolist(), strict=True):
        hits.setdefault(p, []).append({"start": start, "end": end})
    n = len(firsts)
    columns = [[shard["shard"].as_py()] * n, range(n), shard["keys"].as_py(), shard["n_words"].as_py(), [hits.get(p, []) for p in range(n)], [items.get(p, []) for p in range(n)], [nearby.get(p, []) for p in range(n)]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PART, strict=True)], schema=PART)


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", limit: int = BLOCK_BYTES, scratch: list[str] | None = None) -> DataFrame:
    """One row per document: key, n_words, hits (disjoint spans of words inside windows), items and near (sorted ids).

    Rows of docs are judged one by one, so repeated rows and rows without a key are rows of the result as well. Other
    columns of docs are not read. Without documents, or with an empty benchmark, there is nothing to hit.
    """
    scratch = [] if scratch is None else scratch
    blocks = blocks_of(benchmark, scratch, limit)
    first = make_block(blocks[0].collect())
    stored = index(docs, first.numbers if len(blocks) == 1 else None, key, text).withColumn("shard", F.monotonically_increasing_id())
    shards = materialize(stored, "postings", scratch)
    found = search(shards, first)
    for block in blocks[1:]:
        found = found.unionByName(search(shards, make_block(block.collect())).where("size(near) > 0"))
    if len(blocks) > 1:
        gathered = lambda c: F.flatten(F.collect_list(c)).alias(c)
        found = found.groupBy("shard", "place", "key", "n_words").agg(gathered("hits"), gathered("items"), gathered("near"))
        spans = F.aggregate(F.array_sort("hits"), F.array().cast("array<struct<start: int, end: int>>"), lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))))).otherwise(F.array_append(done, s)))
        found = found.withColumns({"hits": spans, "items": F.array_sort(F.array_distinct("items")), "near": F.array_sort(F.array_distinct("near"))})
    return found.select(F.col("key").alias(key), "n_words", "hits", "items", "near")


def report(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items."""
    scratch: list[str] = []
    found = matches(docs, benchmark, limit=limit, scratch=scratch)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.size("near").cast("long").alias("n_near_items"))
    out = materialize(out.withColumn("contaminated", F.col("n_hit") > 0), "decontamination")
    discard(docs.sparkSession, scratch)
    return out


def oracle_sql() -> str:
    """The same rows in DuckDB's SQL: n-grams for the exact matches, joins around each window's rarest word for the near ones."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS words FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS words FROM benchmark WHERE item_id IS NOT NULL),
        w AS (SELECT DISTINCT item, words[i : i + {WIDTH - 1}] AS terms FROM b, unnest(range(1, greatest(len(words) - {WIDTH - 1}, 1) + 1)) r(i) WHERE len(words) > 0),
        win AS (SELECT DISTINCT terms, len(terms) AS n FROM w),
        spot AS (SELECT rid, i - 1 AS pos, words[i] AS word FROM d, unnest(range(1, len(words) + 1)) r(i)),
        gram AS (SELECT rid, i - 1 AS pos, n, words[i : i + n - 1] AS terms FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, len(words) - n + 2)) r(i)),
        hit AS (SELECT rid, pos, win.n, win.terms FROM gram JOIN win USING (terms)),
        covered AS (SELECT rid, count(DISTINCT pos + k) AS n_hit FROM hit, unnest(range(0, n)) r(k) GROUP BY rid),
        items AS (SELECT rid, list_sort(list(DISTINCT item)) AS items FROM (SELECT DISTINCT rid, terms FROM hit) JOIN w USING (terms) GROUP BY rid),
        term AS (SELECT terms, n, k, terms[k + 1] AS word FROM win, unnest(range(0, n)) r(k)),
        freq AS (SELECT word, count(*) AS f FROM spot GROUP BY word),
        rare AS (SELECT terms, n, arg_min(k, coalesce(f, 0)) AS k, arg_min(word, coalesce(f, 0)) AS word FROM term LEFT JOIN freq USING (word) GROUP BY terms, n),
        places AS (SELECT DISTINCT rid, terms, n, pos - k + shift AS place FROM rare JOIN spot USING (word), unnest(range(-{SLOP}, {SLOP + 1})) r(shift)),
        near AS (SELECT rid, terms, place FROM places JOIN term USING (terms, n) JOIN spot USING (rid, word) WHERE pos BETWEEN place + k - {SLOP} AND place + k + {SLOP} GROUP BY rid, terms, n, place HAVING count(DISTINCT k) = n),
        close AS (SELECT rid, count(DISTINCT item) AS n_near_items FROM (SELECT DISTINCT rid, terms FROM near) JOIN w USING (terms) GROUP BY rid)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near_items, 0) AS BIGINT) AS n_near_items
        FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid) LEFT JOIN close USING (rid)"""
