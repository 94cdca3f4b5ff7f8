"""Audit of how filters interact: what each one removes in every order, and its Shapley share, from one polynomial a part.

A document's mask says which filters it fails. With c[M] documents of mask M in a part, the expected number removed when
filter i is applied with chance x[i] is the multilinear polynomial

    f(x) = sum over M of c[M] * (1 - product over i in M of (1 - x[i])).

At a corner (each x[i] 0 or 1) it counts what a set of filters removes, which gives every step of every order. The
Shapley value of filter i is the integral of its partial derivative along the diagonal x = (t, ..., t), here with exact
rationals; times the number of orders it is what the filter removes, summed over all orders.

Spark reduces the documents to at most 2 ** filters counts a part. Equal texts are found by a SHA-256 of the text: the
smallest id of each text is reduced before the shuffle, so a text with very many copies is one row of each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import UPPER, discard, materialize

#: Failure conditions of a text that is not null, by the letter of the filter; the last filter, DUPLICATE, is of the table.
WORD_BREAKS = "\t\n\x0b\x0c\r"
DUPLICATE = "E"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, WORD_BREAKS, " " * len(WORD_BREAKS)), " ", -1), "")


def conditions(text: Column) -> dict[str, Column]:
    """A: under 200 words; B: under half of the words distinct; C: over 3 % capitals; D: a character of markup."""
    words = _words(text)
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, tests: Callable[[Column], dict[str, Column]] = conditions) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters that they fail, bit k for the k-th letter.

    A null text is empty, a null lang the part ''. A row without doc_id is no copy and has no copies; rows of one doc_id
    are not copies of each other. Of several labels of a document the largest counts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    flags = list(tests(text).values())
    mask = sum((F.when(flag, F.lit(1 << k)).otherwise(F.lit(0)) for k, flag in enumerate(flags[1:], 1)), F.when(flags[0], F.lit(1)).otherwise(F.lit(0)))
    digest = F.when(F.col("doc_id").isNotNull(), F.unhex(F.sha2(text, 256)))
    scratch: list[str] = []
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), mask.alias("mask"), digest.alias("digest"))
    rows = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled")).agg(F.coalesce(F.max("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.max("toxic") == 1, F.lit(False)).alias("toxic"))
    marked = rows.join(marks, F.col("doc_id") == F.col("labelled"), "left").drop("labelled").fillna(False, ["good", "toxic"])
    # rows of one id and text differ by their part only
    texts = marked.groupBy("doc_id", "digest", "mask", "good", "toxic").agg(F.collect_list(F.struct("part", "n")).alias("parts"))
    texts = materialize(texts, "audit-texts", scratch)
    by = ["part", "mask", "good", "toxic"]
    spread = lambda df: df.select(F.inline("parts"), "mask", "good", "toxic").groupBy(*by).agg(F.sum("n").alias("n"))
    first = texts.where("digest IS NOT NULL").groupBy("digest").agg(F.min_by(F.struct("parts", "mask", "good", "toxic"), "doc_id").alias("first")).select("first.*")
    first = spread(first.unionByName(texts.where("digest IS NULL").drop("doc_id", "digest")))
    # all fail DUPLICATE but the first of each text
    signed = spread(texts).withColumn("mask", F.col("mask") + (1 << len(flags))).unionByName(first.withColumn("mask", F.col("mask") + (1 << len(flags))).withColumn("n", -F.col("n"))).unionByName(first)
    when = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0)))
    counts = signed.groupBy("part", "mask").agg(F.sum("n").alias("n"), when("good").alias("good"), when("toxic").alias("toxic"))
    counts = materialize(counts, "audit-counts")
    discard(docs.sparkSession, scratch)
    return counts


class Removal:
    """The multilinear polynomial of what is removed: the coefficient of each product of variables, by mask."""

    def __init__(self, counts: dict[int, int], filters: int):
        self.filters = filters
        holding = [sum(c for m, c in counts.items() if m & s == s) for s in range(1 << filters)]
        self.coefficient = [0] + [holding[s] * (-1) ** (s.bit_count() + 1) for s in range(1, 1 << filters)]

    def corner(self, chosen: int) -> int:
        """Documents that the chosen filters remove together."""
        return sum(a for s, a in enumerate(self.coefficient) if s & chosen == s)

    def shapley(self, k: int) -> Fraction:
        """The integral over t from 0 to 1 of the derivative by x[k] at (t, ..., t)."""
        diagonal = [0] * self.filters
        for s, a in enumerate(self.coefficient):
            if s >> k & 1:
                diagonal[s.bit_count() - 1] += a
        return sum((Fraction(a, power + 1) for power, a in enumerate(diagonal)), Fraction(0))


def part_rows(part: str, masks: list[dict], letters: str) -> dict[str, list]:
    """All orders and steps of one part."""
    n = len(letters)
    polynomial = {what: Removal({m["mask"]: m[what] for m in masks}, n) for what in ("n", "good", "toxic")}
    total, everything = sum(m["n"] for m in masks), (1 << n) - 1
    removed = {what: [p.corner(s) for s in range(1 << n)] for what, p in polynomial.items()}
    shares = [polynomial["n"].shapley(k) * factorial(n) for k in range(n)]
    out: dict[str, list] = {name: [] for name in SCHEMA.names}
    for order in permutations(range(n)):
        before = 0
        for step, k in enumerate(order, 1):
            after = before | 1 << k
            lost = {what: r[after] - r[before] for what, r in removed.items()}
            row = (part, "".join(letters[i] for i in order), step, total - removed["n"][after], lost["n"], removed["n"][1 << k] - lost["n"], removed["n"][everything] - removed["n"][everything ^ 1 << k], lost["good"], lost["toxic"], int(shares[k]))
            for name, value in zip(SCHEMA.names, row, strict=True):
                out[name].append(value)
            before = after
    return out


_LONGS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((name, pa.int64()) for name in _LONGS)])
SPARK_SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{name} long" for name in _LONGS)


def audit(docs: DataFrame, labels: DataFrame, tests: Callable[[Column], dict[str, Column]] = conditions) -> DataFrame:
    """One row per part, order of the filters and step, zeros included; an empty table has no parts and gives no rows.

    Columns of docs other than doc_id, lang and text are not read.
    """
    letters = "".join(tests(F.col("text"))) + DUPLICATE
    parts = mask_counts(docs, labels, tests).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pydict(part_rows(row["part"], row["masks"], letters), schema=SCHEMA)

    return parts.mapInArrow(expand, SPARK_SCHEMA)


def oracle_sql() -> str:
    """The same rows in DuckDB's SQL, by applying every order."""
    letters = [(c, 1 << k) for k, c in enumerate("ABCDE")]
    names = ("a", "b", "c", "d", "e")
    distinct = " AND ".join(f"{x}.x <> {y}.x" for i, x in enumerate(names) for y in names[i + 1 :])
    return rf"""
        WITH f(x, bit) AS (VALUES {", ".join(f"('{c}', {b})" for c, b in letters)}),
        orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM {", ".join(f"f {n}" for n in names)} WHERE {distinct}),
        w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        l AS (SELECT doc_id, coalesce(max(quality) = 1, false) AS good, coalesce(max(toxic) = 1, false) AS toxic FROM labels GROUP BY doc_id),
        d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                     CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
                     + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                     + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
              FROM w LEFT JOIN l USING (doc_id)),
        m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY part, mask),
        s AS (SELECT filter_order, step, bit, CAST(coalesce((SELECT sum(b.bit) FROM f b WHERE strpos(filter_order, b.x) < step), 0) AS BIGINT) AS prior
              FROM orders, range(1, 6) r(step) JOIN f ON f.x = filter_order[step]),
        r AS (SELECT part, filter_order, step, bit,
                     sum(CASE WHEN mask & (prior | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & prior = 0 THEN n ELSE 0 END) AS removed,
                     sum(CASE WHEN mask & bit > 0 AND mask & prior > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN mask & bit > 0 AND mask & prior = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & prior = 0 THEN toxic ELSE 0 END) AS toxic_lost
              FROM m, s GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
        FROM r"""
