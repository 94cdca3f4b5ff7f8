"""Connected components of a graph of links, by contraction in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import discard, materialize

ROUNDS = 64


def connected_components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node that can be reached.

    In a round each node takes its smallest neighbour as parent, if that is smaller, and the links are carried over to
    the parents. Every node that isn't smaller than all its neighbours leaves, so the graph shrinks at least by half
    and is gone after a few rounds; then the parents are followed back. Rounds are written to the shared folder, and deleted but for the result. All
    joins are between written tables, so a node with very many links is split by adaptive execution.
    """
    steps: list[DataFrame] = []
    scratch: list[str] = []
    edges = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-edges", scratch)
    for turn in range(ROUNDS):
        if edges.isEmpty():
            break
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select("b", "a"))
        parents = materialize(ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("parent")), f"{label}-parents{turn}", scratch)
        steps.append(parents)
        pa, pb = (parents.select(F.col("node").alias(n), F.col("parent").alias(p)) for n, p in (("na", "pa"), ("nb", "pb")))
        left = edges.join(pa, F.col("a") == F.col("na")).select("b", "pa")
        both = left.join(pb, F.col("b") == F.col("nb")).where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        # a parent that has a parent of its own stays linked to it
        chains = parents.where("parent <> node").select(F.col("parent").alias("c")).distinct().join(pa, F.col("c") == F.col("na")).where("pa <> c").select(F.col("pa").alias("a"), F.col("c").alias("b"))
        edges = materialize(both.unionAll(chains).distinct(), f"{label}-edges{turn}", scratch)
    else:
        raise RuntimeError("the links did not contract")
    spark = links.sparkSession
    if not steps:
        discard(spark, scratch)
        return spark.createDataFrame([], f"node {dict(edges.dtypes)['a']}, component {dict(edges.dtypes)['a']}")
    found = steps.pop().select("node", F.col("parent").alias("component"))
    while steps:
        up = found.select(F.col("node").alias("up"), "component")
        found = materialize(steps.pop().join(up, F.col("parent") == F.col("up"), "left").select("node", F.coalesce("component", "parent").alias("component")), f"{label}-back{len(steps)}", scratch)
    found = materialize(found, label)
    discard(spark, scratch)
    return found
