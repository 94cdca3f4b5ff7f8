"""Encryption under keys derived from passwords."""

import base64

import pytest
from pyspark.sql import functions as F

from lodestream.functions import udfs


def test_layout_and_round_trip(spark):
    texts = ["", "x", "exactly sixteen!", "ä€𝄞" * 1000, None, "x"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(3)
    secret = df.select("k", udfs.encrypt_with_password(F.col("t"), "password", b"s" * 32).alias("s")).collect()
    raw = {r["k"]: r["s"] and base64.b64decode(r["s"]) for r in secret}
    assert raw[4] is None and all(v[:32] == b"s" * 32 and len(v) == 48 + 16 * (len(texts[k].encode()) // 16 + 1) for k, v in raw.items() if v)
    assert raw[1] != raw[5]  # equal texts, own vectors
    back = spark.createDataFrame(secret, "k int, s string").select("k", udfs.decrypt_with_password(F.col("s"), "password")).collect()
    assert {k: t for k, t in back} == dict(enumerate(texts))


def test_key_by_hand(spark):
    """A text that is decrypted with nothing but the key that the standard gives."""
    key = udfs.derive_key("p" * 40, b"n" * 32)
    assert key == udfs.derive_key("p" * 32, b"n" * 32) != udfs.derive_key("p" * 31, b"n" * 32)
    secret = spark.range(1).select(udfs.encrypt_with_password(F.lit("hello"), "p" * 40, b"n" * 32).alias("s"))
    plain = secret.select(F.aes_decrypt(F.substring(F.unbase64("s"), 33, 1000), F.lit(bytearray(key)), F.lit("CBC")).cast("string")).first()[0]
    assert plain == "hello"


def test_derivation_is_the_standard_one(monkeypatch):
    """Vector of RFC 6070 with 4096 rounds and 20 bytes."""
    monkeypatch.setattr(udfs, "ROUNDS", 4096)
    assert udfs.derive_key("password", b"salt")[:20].hex() == "4b007901b765489abead49d926f721d065a429c1"


def test_many_salts_and_wrong_passwords(spark):
    parts = [spark.range(2).select("id", udfs.encrypt_with_password(F.concat(F.lit(f"v{k}-"), F.col("id")), "a").alias("s")) for k in range(5)]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    assert sorted(r[0] for r in every.select(udfs.decrypt_with_password(F.col("s"), "a")).collect()) == [f"v{k}-{i}" for k in range(5) for i in range(2)]
    with pytest.raises(ValueError, match="32 bytes"):
        udfs.encrypt_with_password(F.lit("x"), "a", b"short")
    with pytest.raises(Exception, match="AES_CRYPTO_ERROR|bad key"):
        fixed = spark.range(50).select(udfs.encrypt_with_password(F.col("id"), "a", b"s" * 32).alias("s"))
        fixed.select(udfs.decrypt_with_password(F.col("s"), "b")).collect()
