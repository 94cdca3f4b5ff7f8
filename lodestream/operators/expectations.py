"""Data-quality expectations: keep and count, drop, quarantine, or fail."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holds(condition: str) -> Column:
    """A condition whose value is null counts as broken."""
    return F.coalesce(F.expr(condition), F.lit(False))


@dataclass
class Expectations:
    """Named SQL conditions by what happens to a row that breaks them."""

    warn: dict[str, str] = field(default_factory=dict)
    drop: dict[str, str] = field(default_factory=dict)
    quarantine: dict[str, str] = field(default_factory=dict)
    fail: dict[str, str] = field(default_factory=dict)

    def all(self) -> dict[str, str]:
        return {**self.warn, **self.drop, **self.quarantine, **self.fail}

    def metrics(self, df: DataFrame) -> DataFrame:
        """One row per expectation: rows seen and rows that break it, in one pass."""
        rules = self.all()
        counted = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.when(holds(c), 0).otherwise(1)).alias(n) for n, c in rules.items()])
        return counted.select(F.col("_n").alias("seen"), F.explode(F.create_map(*[x for n in rules for x in (F.lit(n), F.coalesce(F.col(n), F.lit(0)))])).alias("expectation", "broken"))

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows that pass, and rows for quarantine with the names of what they break."""
        for name, c in self.fail.items():
            df = df.where(holds(c) | F.raise_error(F.lit(f"expectation {name} is broken")).cast("boolean"))
        for c in self.drop.values():
            df = df.where(holds(c))
        broken = F.array_compact(F.array(*[F.when(~holds(c), n) for n, c in self.quarantine.items()])) if self.quarantine else F.array().cast("array<string>")
        return df.where(F.size(broken) == 0), df.withColumn("_broken", broken).where(F.size("_broken") > 0)
