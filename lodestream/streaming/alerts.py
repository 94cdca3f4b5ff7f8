"""Rows of a stream handed to a writer one by one, and made streams to try joins with."""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class AlertFiles:
    """Writes a line of JSON for each row, a file for each partition of each batch, for ``DataStreamWriter.foreach``.

    A file appears under its name when it is whole. A partition that is written again, after a failed batch or a lost
    executor, finds its file and is skipped, so each row is there once as long as a repeated batch deals its rows alike,
    which file sources do.
    """

    def __init__(self, path: str):
        self.path = path

    def open(self, partition: int, epoch: int) -> bool:
        self.files, root = fs.FileSystem.from_uri(self.path)
        self.final = f"{root}/epoch-{epoch:08d}-part-{partition:05d}.json"
        self.draft = f"{root}/.{epoch}-{partition}"
        if self.files.get_file_info(self.final).type != fs.FileType.NotFound:
            return False
        self.files.create_dir(root, recursive=True)
        self.out = self.files.open_output_stream(self.draft)
        return True

    def process(self, row: Row) -> None:
        self.out.write(json.dumps(row.asDict(recursive=True), default=str).encode() + b"\n")

    def close(self, error: Exception | None) -> None:
        out, self.out = getattr(self, "out", None), None
        if out is None:
            return
        out.close()
        if error is None:
            self.files.move(self.draft, self.final)
        else:
            self.files.delete_file(self.draft)


def alert_each(rows: DataFrame, path: str, checkpoint: str, writer: type[AlertFiles] = AlertFiles) -> StreamingQuery:
    """Hand each row that has arrived to a writer, and stop. ``path`` is an address that all executors reach."""
    query = rows.writeStream.foreach(writer(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def counter(spark: SparkSession, per_second: int = 5, partitions: int = 2) -> DataFrame:
    """A stream of timestamp and value: so many rows a second, numbered from 0."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).option("numPartitions", partitions).load()


def counted(spark: SparkSession, rows: int, start_ms: int, step_ms: int) -> DataFrame:
    """The same by batch: ``rows`` rows in each, at times that rise by ``step_ms`` from batch to batch, alike in every run."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows).option("startTimestamp", start_ms).option("advanceMillisPerBatch", step_ms).load()


def sampled(value: Column, percent: int) -> Column:
    """Whether a value is in a sample: by its hash, so alike in every run and on every executor."""
    return F.pmod(F.xxhash64(value), F.lit(100)) < percent


def impressions_and_clicks(made: DataFrame, behind: int = 50, percent: int = 10) -> tuple[DataFrame, DataFrame]:
    """Impressions (adId, impressionTime) of each number; clicks (adId, clickTime) of a sample, on ads ``behind`` numbers back."""
    clicks = made.where(sampled(F.col("value"), percent) & (F.col("value") > behind))
    return made.select(F.col("value").alias("adId"), F.col("timestamp").alias("impressionTime")), clicks.select((F.col("value") - behind).alias("adId"), F.col("timestamp").alias("clickTime"))
