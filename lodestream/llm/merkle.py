"""Merkle manifest of a dataset: a node store in level-partitioned Parquet, proofs by merge-scans over it.

Leaves are sorted by group and key into runs (range partitions), where a leaf's coordinate is its place in its group.
``FAN`` consecutive nodes become one node of the next level, until one is left: the group's subroot. The subroots, in
order of their groups, are the leaves of a top tree that gives the root.

Nodes are built in bands of HEIGHT levels. A block is all that stands below one node at the top of a band, at most
FAN ** HEIGHT nodes wide, however large its group is. A task reads its blocks in coordinate order; each level reads the
one below sequentially, holds one run, and its nodes go to the level's folder of the store. Proofs are extracted from the
top band downwards: a block's levels, sorted from top to bottom, are merged level by level, each node taking its siblings
from its run and the rest of the path from its parent. Neither a group nor a level is ever in one task as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby, islice
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import discard, materialize

FAN = 3
HEIGHT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
OUT_ROWS = 2000


def field_bytes(*values: Column) -> Column:
    """The values one after the other: '-' for null, else the number of bytes, ':' and the value."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def hashed(text: Column) -> Column:
    """The 32 bytes of the SHA-256."""
    return F.unhex(F.sha2(text, 256))


def _node(children: list[bytes]) -> bytes:
    """The hash of a run of nodes, whose digests enter as hex text."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


class Tree(NamedTuple):
    """A forest's stored levels: its leaves (grp, idx, key, hash, claim), and by band the nodes (grp, idx, hash, level)."""

    leaves: DataFrame
    bands: list[DataFrame]
    height: int


def place(rows: DataFrame, label: str, scratch: list[str]) -> DataFrame:
    """Leaves (grp, key, hash, claim) with their place idx in the group, by key and hash.

    Rows are dealt by range and sorted; a task counts on within its run. A group that goes on in a later run starts there
    at the number of its rows in earlier runs, which is known for one group a run: as many rows as there are tasks.
    """
    scratch_rows = materialize(rows.select("grp", "key", "hash", "claim"), f"{label}-unsorted", scratch)
    ordered = scratch_rows.repartitionByRange("grp", "key", "hash").sortWithinPartitions("grp", "key", "hash").withColumn("run", F.spark_partition_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, head = None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            spans = pc.run_end_encode(batch.column("grp"))
            ends, values = spans.run_ends.to_numpy(), spans.values.to_pylist()
            starts = np.concatenate([[0], ends[:-1]])
            if last is not None and last[0] != values[0]:
                seen, head = 0, False
            before = np.zeros(len(ends), dtype=np.int64)
            before[0] = seen
            heads = np.zeros(len(ends), dtype=bool)
            heads[0] = head
            at = np.arange(batch.num_rows, dtype=np.int64) - np.repeat(starts - before, ends - starts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(np.repeat(heads, ends - starts))], names=[*batch.schema.names, "at", "head"])
            last, seen, head = (values[-1],), int(at[-1]) + 1, head and len(ends) == 1

    fields = ", ".join(f"{n} {t}" for n, t in ordered.dtypes)
    runs = materialize(ordered.mapInArrow(count, f"{fields}, at long, head boolean"), f"{label}-runs", scratch)
    sizes = runs.groupBy("run", "grp", "head").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.expr("sum(n) OVER (PARTITION BY grp ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    carried = sizes.withColumn("carry", earlier).where("head AND carry IS NOT NULL").select(F.col("run").alias("carry_run"), "carry")
    idx = F.col("at") + F.when(F.col("head"), F.coalesce("carry", F.lit(0))).otherwise(F.lit(0))
    return runs.join(F.broadcast(carried), F.col("run") == F.col("carry_run"), "left").select("grp", idx.alias("idx"), "key", "hash", "claim")


def _block_levels(block: int, nodes: list[bytes], height: int) -> Iterator[tuple[int, int, bytes]]:
    """(levels up, place in the level, hash) of the nodes above one block's base nodes.

    The first block stops at its single node; if more blocks follow it is full, and that node stands at ``height``.
    """
    up, first = 0, block
    wide = FAN**height
    while up < height and (len(nodes) > 1 or block > 0):
        up, wide = up + 1, wide // FAN
        nodes = [_node(nodes[k : k + FAN]) for k in range(0, len(nodes), FAN)]
        for k, node in enumerate(nodes):
            yield up, first * wide + k, node


def _grouped(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Consecutive rows with equal values of ``by``."""
    rows = (row for batch in batches for row in batch.to_pylist())
    row = next(rows, None)
    while row is not None:
        group = tuple(row[b] for b in by)

        def same() -> Iterator[dict]:
            nonlocal row
            while row is not None and tuple(row[b] for b in by) == group:  # noqa: B023
                yield row
                row = next(rows, None)

        mine = same()
        yield group, mine
        for _ in mine:
            pass


NODE = pa.schema([("grp", pa.string()), ("idx", pa.int64()), ("hash", pa.binary()), ("level", pa.int32())])
STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
PATH = "subroot string, root string, steps array<struct<left: string, right: string>>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, OUT_ROWS)):
        yield _batch(some, schema)


def build(leaves: DataFrame, label: str, scratch: list[str], height: int = HEIGHT) -> Tree:
    """All levels above the placed leaves, written band by band, a folder for each level."""
    base, bands = leaves.select("grp", "idx", "hash"), []
    while True:
        start = len(bands) * height

        def climb(batches: Iterator[pa.RecordBatch], start: int = start) -> Iterator[pa.RecordBatch]:
            rows = (row for batch in batches for row in batch.to_pylist())
            blocks = groupby(rows, key=itemgetter("grp", "block"))
            return _batches(((grp, k, node, start + up) for (grp, block), nodes in blocks for up, k, node in _block_levels(block, [n["hash"] for n in nodes], height)), NODE)

        blocks = base.withColumn("block", F.expr(f"idx div {FAN**height}")).repartition("grp", "block").sortWithinPartitions("grp", "block", "idx")
        nodes = blocks.mapInArrow(climb, "grp string, idx long, hash binary, level int").sortWithinPartitions("level", "grp", "idx")
        bands.append(materialize(nodes, f"{label}-band{start}", scratch, by=("level",)))
        base = bands[-1].where(F.col("level") == start + height).select("grp", "idx", "hash")
        if base.where("idx > 0").isEmpty():
            return Tree(leaves, bands, height)


def subroots(tree: Tree) -> DataFrame:
    """(grp, hash): the highest node of each group."""
    firsts = tree.leaves.select("grp", "idx", "hash", F.lit(0).alias("level"))
    for band in tree.bands:
        firsts = firsts.unionByName(band)
    return firsts.where("idx = 0").groupBy("grp").agg(F.max_by("hash", "level").alias("hash"))


def paths(tree: Tree, seeds: DataFrame, label: str, scratch: list[str]) -> DataFrame:
    """The leaves (grp, idx, key, hash, claim) with subroot, root and the steps from the leaf to the root.

    ``seeds`` (grp, subroot, root, steps) hold what stands above each group's own tree. A step is the hex text left and
    right of the node in its run. Bands are scanned from the top; a band's base nodes are the seeds of the band below.
    """
    key = dict(tree.leaves.dtypes)["key"]
    none = {"key": F.lit(None).cast(key), "claim": F.lit(None).cast("binary")}
    above = seeds.withColumn("block", F.lit(0).cast("long"))
    for number in reversed(range(len(tree.bands))):
        start = number * tree.height
        base = tree.leaves if number == 0 else tree.bands[number - 1].where(F.col("level") == start).drop("level").withColumns(none)
        upper = tree.bands[number].where(F.col("level") > start).withColumn("up", (F.col("level") - start).cast("int")).drop("level").withColumns(none)
        wide = ", ".join(f"{FAN ** (tree.height - up)}L" for up in range(tree.height + 1))
        nodes = base.withColumn("up", F.lit(0)).unionByName(upper).withColumn("block", F.expr(f"idx div get(array({wide}), up)"))
        rows = nodes.unionByName(above.withColumn("up", F.lit(tree.height + 1)), allowMissingColumns=True)
        rows = rows.repartition("grp", "block").sortWithinPartitions("grp", "block", F.desc("up"), "idx")
        found = rows.mapInArrow(_descend(pa.int64() if key == "bigint" else pa.string()), f"grp string, idx long, key {key}, hash binary, claim binary, {PATH}")
        if number:
            above = materialize(found.select("grp", F.col("idx").alias("block"), "subroot", "root", "steps"), f"{label}-paths{start}", scratch)
    return found


def _siblings(nodes: list[dict], parents: list[list[dict]]) -> Iterator[list[dict]]:
    """The path of each node: the rest of its run, then the path of its parent. Both lists are in order of their places."""
    for parent, at in zip(parents, range(0, len(nodes), FAN), strict=True):
        run = [n["hash"].hex() for n in nodes[at : at + FAN]]
        for k in range(len(run)):
            yield [{"left": "".join(run[:k]), "right": "".join(run[k + 1 :])}, *parent]


def _descend(key: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merge the levels of each block; rows come sorted by block, from its seed and its top down, and by place."""
    schema = pa.schema([("grp", pa.string()), ("idx", pa.int64()), ("key", key), ("hash", pa.binary()), ("claim", pa.binary()), ("subroot", pa.string()), ("root", pa.string()), ("steps", pa.list_(STEP))])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for (grp, block), mine in groupby(rows, key=itemgetter("grp", "block")):
            seed = next(mine)
            known = [seed["steps"]]
            up, top = None, True
            for up, level in groupby(mine, key=itemgetter("up")):
                nodes = list(level)
                known = known if top else list(_siblings(nodes, known))
                top = False
                if up == 0:
                    for node, steps in zip(nodes, known, strict=True):
                        yield grp, node["idx"], node["key"], node["hash"], node["claim"], seed["subroot"], seed["root"], steps
            if up is None:  # a group that ends in a lower band: its seed goes on
                yield grp, block, None, None, None, seed["subroot"], seed["root"], seed["steps"]

    return lambda batches: _batches(leaves(batches), schema)


def proofs(docs: DataFrame, leaf: Column, claim: Column, group: str = "source", key: str = "doc_id", height: int = HEIGHT, scratch: list[str] | None = None) -> DataFrame:
    """One row per document: grp, idx, key, hash (its leaf), claim, subroot, root, steps.

    ``claim`` is the leaf that somebody presents for checking, null for the true one. Rows of one key keep their order
    by leaf; null keys come first, the null group comes first and is a group of its own. An empty table gives no rows.
    """
    scratch = [] if scratch is None else scratch
    rows = docs.select(F.col(group).cast("string").alias("grp"), F.col(key).cast("long").alias("key"), leaf.alias("hash"), claim.alias("claim"))
    tree = build(place(rows, "manifest", scratch), "manifest", scratch, height)
    tops = subroots(tree).select(F.lit("").alias("grp"), F.col("grp").alias("key"), "hash", F.lit(None).cast("binary").alias("claim"))
    top = build(place(tops, "manifest-top", scratch), "manifest-top", scratch, height)
    root = F.lower(F.hex("hash"))
    start = subroots(top).select("grp", root.alias("subroot"), root.alias("root"), F.array().cast("array<struct<left: string, right: string>>").alias("steps"))
    seeds = paths(top, start, "manifest-top", scratch).select(F.col("key").alias("grp"), root.alias("subroot"), "root", "steps")
    return paths(tree, materialize(seeds, "manifest-seeds", scratch), "manifest", scratch)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf (hex) leads to with its siblings."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def verify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Of documents whose id has an even CRC-32 the presented text lacks its line feeds. Other columns of docs than FIELDS
    are not read. A document without id is not tampered with.
    """
    scratch: list[str] = []
    fields = [F.col(c) for c in FIELDS]
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    claim = F.when(tampered, hashed(field_bytes(*fields[:-1], F.replace("text", F.lit("\n"), F.lit("")))))
    found = proofs(docs, hashed(field_bytes(*fields)), claim, scratch=scratch)
    leaf = F.lower(F.hex("hash"))
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    out = found.select(F.col("key").alias("doc_id"), leaf.alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce(F.lower(F.hex("claim")), leaf), F.col("steps")).alias("folded_root"))
    out = materialize(out.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest-result")
    discard(docs.sparkSession, scratch)
    return out


def oracle_sql() -> str:
    """The same rows in DuckDB's SQL: all levels by recursion, siblings by a join of each level."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join([*(field(c) for c in FIELDS[:-1]), field(text)]) + ")"
    levels = lambda name, base: f"""{name}(grp, level, idx, h, n) AS (SELECT grp, 0, idx, h, n FROM {base}
            UNION ALL SELECT grp, level + 1, idx // {FAN}, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + {FAN - 1}) // {FAN} FROM {name} WHERE n > 1 GROUP BY grp, level, idx // {FAN})"""  # noqa: E731
    steps = lambda name: f"""(SELECT c.grp, c.level, c.idx, coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx < c.idx), '') AS l, coalesce(string_agg(s.h, '' ORDER BY s.idx) FILTER (s.idx > c.idx), '') AS r
            FROM {name} c JOIN {name} s ON s.grp = c.grp AND s.level = c.level AND s.idx // {FAN} = c.idx // {FAN} WHERE c.n > 1 GROUP BY ALL)"""  # noqa: E731
    # CRC-32 bit by bit: a byte is added, then eight shifts follow
    signs = "list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])))"
    crc = f"xor(list_reduce({signs}, lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295)"
    return f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS grp, {leaf("text")} AS leaf, {crc} AS crc, {leaf("replace(text, chr(10), '')")} AS changed FROM documents),
        p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS idx, leaf AS h, count(*) OVER (PARTITION BY grp) AS n FROM d),
        {levels("lv", "p")},
        sub AS (SELECT grp, h FROM lv WHERE n = 1),
        t AS (SELECT '' AS grp, grp AS source, row_number() OVER (ORDER BY encode(grp)) - 1 AS idx, h, count(*) OVER () AS n FROM sub),
        {levels("tl", "t")},
        own AS (SELECT * FROM {steps("lv")}), upper AS (SELECT * FROM {steps("tl")}),
        heights AS (SELECT grp, max(level) AS height FROM lv GROUP BY grp),
        steps AS (SELECT p.rid, own.level, own.l, own.r FROM p JOIN own ON own.grp = p.grp AND own.idx = p.idx // CAST(power({FAN}, own.level) AS BIGINT)
                  UNION ALL SELECT p.rid, heights.height + upper.level, upper.l, upper.r FROM p JOIN heights USING (grp) JOIN t ON t.source = p.grp JOIN upper ON upper.idx = t.idx // CAST(power({FAN}, upper.level) AS BIGINT)),
        fold(rid, level, h) AS (SELECT rid, 0, CASE WHEN crc % 2 = 0 THEN changed ELSE leaf END FROM d UNION ALL SELECT rid, level + 1, sha256(l || h || r) FROM fold JOIN steps USING (rid, level)),
        proof AS (SELECT rid, sha256(string_agg(l || r, '' ORDER BY level)) AS proof FROM steps GROUP BY rid),
        ended AS (SELECT rid, arg_max(h, level) AS folded_root FROM fold GROUP BY rid),
        root AS (SELECT h AS root FROM tl WHERE n = 1)
        SELECT doc_id, leaf, sub.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM p JOIN sub USING (grp) JOIN ended USING (rid) LEFT JOIN proof USING (rid), root"""
