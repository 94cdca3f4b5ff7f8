"""Table mutations as joins: upsert, change data capture, slowly changing dimensions of type 2.

Each takes the target and the changes and returns the next version of the target; ``lodestream.sources.versioned``
writes it beside the old one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def _together(target: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, WindowSpec, Column]:
    """Rows of both with _change, a window over each key, and the number of its changes; more than one fails the job.

    Source and target are read once each and meet in one shuffle. Which of two changes of a key holds isn't known. Rows
    without a key never meet others; a hash of the row spreads them over the tasks.
    """
    both = target.withColumn("_change", F.lit(0)).unionByName(changes.withColumn("_change", F.lit(1)), allowMissingColumns=True)
    hashed = [c for c, kind in both.dtypes if "map<" not in kind and "variant" not in kind]
    window = Window.partitionBy(key, F.when(F.col(key).isNull(), F.xxhash64(*hashed)))
    changed = F.sum("_change").over(window)
    several = F.raise_error(F.concat(F.lit("several changes of one key: "), F.col(key).cast("string"))).cast("long")
    return both, window, F.when(F.col(key).isNotNull() & (changed > 1), several).otherwise(changed)


def upsert(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of changes, one per key, replace those of the target with the same key; others are added."""
    if sorted(target.columns) != sorted(changes.columns):
        raise ValueError(f"the target has the columns {target.columns}, the changes {changes.columns}")
    both, _, changed = _together(target, changes, key)
    return both.withColumn("_changed", changed).where(F.col(key).isNull() | (F.col("_change") == 1) | (F.col("_changed") == 0)).select(*target.columns)


def apply_changes(target: DataFrame, changes: DataFrame, key: str, time: str, deleted: str) -> DataFrame:
    """Apply only the latest change of each key: delete, update, or insert; a delete of an unknown key does nothing."""
    values = [c for c in changes.columns if c not in (key, time, deleted)]
    latest = changes.groupBy(key).agg(F.max(F.struct(time, *values, deleted)).alias("c"))
    new = latest.where(~F.col(f"c.{deleted}")).select(key, *[f"c.{v}" for v in values])
    return target.join(latest.select(key), key, "left_anti").unionByName(new)


def scd2(target: DataFrame, updates: DataFrame, key: str, value: str, effective: str) -> DataFrame:
    """Close the current row of each key whose value changed at the update's date, and add the new current row.

    target: key, value, current, effective, end_date. An update that changes nothing is ignored.
    """
    both, window, changed = _together(target, updates.select(key, value, effective), key)
    one = lambda when, *columns: F.first(F.when(when, F.struct(*columns)), ignorenulls=True).over(window)
    both = both.withColumns({"_changed": changed, "_new": one(F.col("_change") == 1, value, effective), "_old": one(F.col("current"), value)})
    keyed, is_target = F.col(key).isNotNull() & (F.col("_changed") > 0), F.col("_change") == 0
    closes = is_target & F.col("current") & keyed & F.col(f"_new.{effective}").isNotNull() & ~F.col(value).eqNullSafe(F.col(f"_new.{value}"))
    known = F.when(F.col(key).isNotNull(), F.col(f"_old.{value}"))
    kept = both.where(is_target | ~F.col(value).eqNullSafe(known))
    return kept.select(
        key, value, F.when(is_target, F.col("current") & ~closes).otherwise(F.lit(True)).alias("current"), effective,
        F.when(closes, F.col(f"_new.{effective}")).otherwise(F.col("end_date")).cast(dict(target.dtypes)["end_date"]).alias("end_date"),
    )
