"""Python function surfaces: scalar, vectorised, grouped, windowed and ridge folds. Built-in forms are preferred in plans."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

# The layout of encrypted texts and how their keys are derived.
SALT_BYTES, KEY_CHARS, ROUNDS = 32, 32, 1000


def register_squared(spark: SparkSession) -> None:
    """``squared(x)`` for SQL: a long, null for null."""
    spark.udf.register("squared", lambda x: None if x is None else x * x, "long")


@F.pandas_udf(DoubleType())
def plus_one(v: pd.Series) -> pd.Series:
    return v + 1


@F.pandas_udf(DoubleType())
def product(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield a * b


@F.pandas_udf(DoubleType())
def mean(v: pd.Series) -> float:
    return v.mean()


def grouped_mean(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """key and the mean of a value, in pandas with a step in each task; null for a group without values.

    A task gives out one row per group and batch, and Spark adds these up, so that no task holds a group.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.groupby(key, dropna=False)[value].agg(total="sum", n="count").reset_index()

    parts = df.select(key, F.col(value).cast("double").alias(value)).mapInPandas(add, f"`{key}` {dict(df.dtypes)[key]}, total double, n long")
    return parts.groupBy(key).agg(F.try_divide(F.sum("total"), F.sum("n")).alias(out))


def subtract_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    def centre(g: pd.DataFrame) -> pd.DataFrame:
        return g.assign(**{value: g[value] - g[value].mean()})

    return df.select(key, value).groupBy(key).applyInPandas(centre, df.select(key, value).schema)


def arrow_sums(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """keys, n, total, weights, weighted: sums of a value by group, in Python with a step in each task.

    A task adds up each Arrow batch by group and gives out one row per group and batch; Spark adds these up. So no task
    holds a group, however few groups there are. Rows without value (or weight) are left out.
    """
    given = df.select(*keys, F.col(value).cast("double").alias("_value"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_weight")).where("_value IS NOT NULL AND _weight IS NOT NULL")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.append_column("_product", pc.multiply(table["_value"], table["_weight"]))
            sums = table.group_by(keys).aggregate([("_value", "count"), ("_value", "sum"), ("_weight", "sum"), ("_product", "sum")])
            yield from sums.select([*keys, "_value_count", "_value_sum", "_weight_sum", "_product_sum"]).rename_columns([*keys, "n", "total", "weights", "weighted"]).to_batches()

    types = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys)
    parts = given.mapInArrow(add, f"{types}, n long, total double, weights double, weighted double")
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "total", "weights", "weighted")])


def arrow_subtract_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    """df with the group's mean taken off the value: sums in two steps, joined back, then a vectorised subtraction."""
    means = arrow_sums(df, [key], value).select(F.col(key).alias("_key"), (F.col("total") / F.col("n")).alias("_mean"))
    return df.join(means, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn(value, minus(F.col(value).cast("double"), "_mean")).drop("_key", "_mean")


@F.pandas_udf(DoubleType())
def minus(a: pd.Series, b: pd.Series) -> pd.Series:
    return a - b


def encrypt(value: Column, key: Column) -> Column:
    """AES in CBC mode, base64. The key comes from the caller's configuration."""
    return F.base64(F.aes_encrypt(value, key, F.lit("CBC")))


def decrypt(value: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(value), key, F.lit("CBC")).cast("string")


def derive_key(password: str, salt: bytes) -> bytes:
    """An AES-256 key from the first 32 characters of a password: PBKDF2 with HMAC-SHA1."""
    return hashlib.pbkdf2_hmac("sha1", password[:KEY_CHARS].encode(), salt, ROUNDS, KEY_CHARS)


def encrypt_with_password(value: Column, password: str, salt: bytes | None = None) -> Column:
    """base64 of salt, initial vector and AES-CBC text, under a key derived from a password.

    One salt serves the whole expression (random unless given) and each value has its own random vector, so the costly
    derivation is made once, on the driver, and encryption stays in the JVM. The key is part of the plan, so plans must
    not be logged where the data are secret.
    """
    salt = os.urandom(SALT_BYTES) if salt is None else salt
    if len(salt) != SALT_BYTES:
        raise ValueError(f"the salt must have {SALT_BYTES} bytes")
    return F.base64(F.concat(F.lit(bytearray(salt)), F.aes_encrypt(value.cast("string"), F.lit(bytearray(derive_key(password, salt))), F.lit("CBC"))))


def decrypt_with_password(value: Column, password: str) -> Column:
    """What encrypt_with_password or any writer of that format gave, whatever the salts; null for null.

    The key of each salt is derived once for each Arrow batch; the decryption itself stays in the JVM. A wrong password
    or a damaged text raises.
    """

    @F.pandas_udf(BinaryType())
    def key_of(salts: pd.Series) -> pd.Series:
        keys = {bytes(s): derive_key(password, bytes(s)) for s in salts.dropna().unique()}
        return salts.map(lambda s: None if s is None else keys[bytes(s)])

    raw = F.unbase64(value)
    return F.aes_decrypt(F.substring(raw, SALT_BYTES + 1, 2**31 - 1), key_of(F.substring(raw, 1, SALT_BYTES)), F.lit("CBC")).cast("string")


def ridge_folds(df: DataFrame, features: list[str], label: str, alphas: list[float], folds: int) -> DataFrame:
    """Root mean square error of ridge regression by alpha and fold, from sums of products only.

    One pass gives each fold's Gram matrix (fixed size, whatever the rows); each (alpha, fold) is then a small solve.
    """
    cols = [*features, label]
    fold = F.pmod(F.xxhash64(*cols), F.lit(folds)).cast("int").alias("fold")
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in cols]]
    sums = df.groupBy(fold).agg(F.array(*[F.sum(a * b) for a in x for b in x]).alias("gram"))
    every = sums.agg(F.collect_list(F.struct("fold", "gram")).alias("all"))
    tasks = every.select("all", F.explode(F.array(*map(F.lit, alphas))).alias("alpha")).select("all", "alpha", F.explode(F.transform("all", lambda s: s["fold"])).alias("fold"))

    @F.pandas_udf(DoubleType())
    def error(grams: pd.Series, alpha: pd.Series, fold: pd.Series) -> pd.Series:
        out, n = [], len(cols) + 1
        for g, a, f in zip(grams, alpha, fold, strict=True):
            parts = {s["fold"]: np.array(s["gram"]).reshape(n, n) for s in g}
            train, test = sum(m for k, m in parts.items() if k != f), parts[f]
            w = np.append(np.linalg.solve(train[:-1, :-1] + a * np.eye(n - 1), train[:-1, -1]), -1.0)
            out.append(float(np.sqrt(max(w @ test @ w, 0) / test[0, 0])))
        return pd.Series(out)

    return tasks.select("alpha", "fold", error(F.transform("all", lambda s: s), "alpha", "fold").alias("rmse"))
