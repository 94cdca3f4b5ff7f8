"""Evaluate expensive expressions once, and on all cores.

The optimizer moves filters below a projection by putting the projected expression into the filter, and adds filters on
the array below an ``explode``. Either evaluates the expression again for each mention, which costs more than the filter
saves where it parses a text. Filters on what a generator gives stay above it, so these helpers use one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_columns_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with the columns added, one row for each of its rows."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def explode_present(df: DataFrame, array: Column, name: str, keep: list[str]) -> DataFrame:
    """The columns to keep and each non-null element of the array; rows without one go, as with ``explode``."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def spread(df: DataFrame, piece: int = 16 << 20) -> DataFrame:
    """df on as many tasks as there are cores, if its scan may give it fewer: one small file is one task.

    Only what is estimated to be smaller than one split of files for each core is dealt anew, so the shuffle is bounded;
    larger inputs have enough tasks as they are. A task gets about ``piece`` of the estimated bytes, so that its share does
    not grow with the input. Dealing sorts the rows of each task, so rows should be dealt while they are narrow, before
    texts are made of them. Streams stay as they are.
    """
    spark = df.sparkSession
    if df.isStreaming:
        return df
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(cores, -(-size // piece))) if size < cores * split else df
