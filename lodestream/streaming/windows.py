"""Structured Streaming: windowed counts, interval joins, metrics and upserts, the same plans for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestream.operators import merge
from lodestream.sources import versioned


def is_stream(df: DataFrame) -> bool:
    return df.isStreaming


def windowed_counts(events: DataFrame, key: str, time: str, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Rows by key and tumbling window. ``late`` sets a watermark, which a stream needs to drop old state."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    if late:
        timed = timed.withWatermark(time, late)
    return timed.groupBy(key, F.window(time, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def interval_join(left: DataFrame, right: DataFrame, key: tuple[str, str], time: tuple[str, str], within: str, how: str = "inner", late: tuple[str, str] = ("10 seconds", "20 seconds")) -> DataFrame:
    """Rows of right with the same key at most ``within`` after a row of left. Both times get watermarks on streams.

    Time is cut into buckets as long as the interval. A right row goes to its own bucket and the one before, a left row
    only to its own, so each pair meets once, a left row stays one row for outer joins, and a key with very many rows is
    split by time.
    """
    (lk, rk), (lt, rt) = key, time
    left, right = left.withColumn(lt, F.col(lt).cast("timestamp")), right.withColumn(rt, F.col(rt).cast("timestamp"))
    if is_stream(left):
        left, right = left.withWatermark(lt, late[0]), right.withWatermark(rt, late[1])
    bucket = lambda t: F.floor(F.unix_micros(t) / F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {within}")))
    left = left.withColumn("_at", bucket(F.col(lt)))
    right = right.withColumn("_near", F.explode_outer(F.array(bucket(F.col(rt)), bucket(F.col(rt)) - 1)))
    on = (F.col(lk) == F.col(rk)) & (F.col("_at") == F.col("_near")) & (F.col(rt) >= F.col(lt)) & (F.col(rt) <= F.col(lt) + F.expr(f"interval {within}"))
    return left.join(right, on, how).drop("_at", "_near")


def file_stream(spark: SparkSession, path: str, schema, glob: str | None = None, files_per_trigger: int = 1) -> DataFrame:
    reader = spark.readStream.format("parquet").schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def run_to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and return the result table."""
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def upsert_stream(counts: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Merge every micro-batch of an update-mode aggregate into a versioned table. A replayed batch changes nothing."""

    def merge_batch(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch if not versioned.versions(spark, path) else merge.upsert(versioned.read(spark, path), batch, key)
        versioned.write(new, path)

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge_batch).start()
