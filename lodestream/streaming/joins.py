"""Joins of two streams that run: both sides are file streams, the join's state is kept in a checkpoint between runs.

A run takes what has arrived since the last one as one batch, gives out what is final, and stops; the next run goes on
from the checkpoint. An outer join gives out a row without a match when the watermark says that none can come any more,
so the last rows need later rows on both sides, and one batch more that is run with the watermark so reached; ``finish``
sends them.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestream.sources.shared import new_folder
from lodestream.streaming.windows import interval_join


def time_cuts(sides: list[tuple[DataFrame, str]], parts: int) -> list[float]:
    """Seconds that cut the times of all sides into parts of about equal size."""
    seconds = None
    for df, time in sides:
        one = df.select((F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("s"))
        seconds = one if seconds is None else seconds.unionAll(one)
    return sorted(set(seconds.approxQuantile("s", [k / parts for k in range(1, parts)], 0.01)))


def part_of(df: DataFrame, time: str, cuts: list[float], number: int) -> DataFrame:
    """The rows between two cuts; rows without a time are in the first part."""
    s = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    low = s >= cuts[number - 1] if number else F.lit(True)
    high = s < cuts[number] if number < len(cuts) else F.lit(True)
    return df.where(F.coalesce(low & high, F.lit(number == 0)))


@dataclass
class JoinedStreams:
    """Two file streams, their join, its checkpoint and its output, below one folder."""

    spark: SparkSession
    folder: str
    left: DataFrame
    right: DataFrame
    key: tuple[str, str]
    time: tuple[str, str]
    within: str | None = None
    how: str = "inner"
    late: tuple[str, str] = ("10 seconds", "20 seconds")

    def arrive(self, left: DataFrame | None = None, right: DataFrame | None = None) -> None:
        """New rows on either side."""
        for side, df in (("left", left), ("right", right)):
            if df is not None:
                df.write.mode("append").parquet(f"{self.folder}/{side}")

    def joined(self) -> DataFrame:
        read = lambda side, like: self.spark.readStream.schema(like.schema).parquet(f"{self.folder}/{side}")
        left, right = read("left", self.left), read("right", self.right)
        if self.within is None:  # the state of both sides is kept for good
            return left.join(right, F.col(self.key[0]) == F.col(self.key[1]))
        return interval_join(left, right, self.key, self.time, self.within, self.how, self.late)

    def run(self) -> StreamingQuery:
        """Join what has arrived since the last run, as one batch, and stop. A batch that a lost run left open is repeated first."""
        out = self.joined().writeStream.format("parquet").outputMode("append").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/checkpoint")
        query = out.trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    def finish(self) -> datetime:
        """Two runs over rows so late on both sides that all before them becomes final. Returns their time.

        The left one has no key. The right one needs some key, since rows without are filtered before they move the
        watermark; at its time no left row is left to match.
        """
        latest = [df.agg(F.max(F.col(t).cast("timestamp_ntz"))).first()[0] for df, t in ((self.left, self.time[0]), (self.right, self.time[1]))]
        seconds = self.spark.sql(f"SELECT sum(unix_micros(timestamp_seconds(0) + x)) / 1e6 FROM VALUES {', '.join(f'(interval {i})' for i in (self.within or '0 seconds', *self.late))} t(x)").first()[0]
        end = max([t for t in latest if t] or [datetime(1970, 1, 1)]) + timedelta(seconds=float(seconds) + 1)

        def row(df: DataFrame, time: str, key: str | None) -> DataFrame:
            given = {time: F.lit(end), **({key: F.lit(0)} if key else {})}
            return self.spark.range(1).select(*[given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in df.dtypes])

        for _ in range(2):  # the first run moves the watermark, the second gives out what it closes, if the first did not
            self.arrive(row(self.left, self.time[0], None), row(self.right, self.time[1], self.key[1]))
            self.run()
        return end

    def result(self, before: datetime | None = None) -> DataFrame:
        """What has been given out, without the closing rows."""
        out = self.spark.read.parquet(f"{self.folder}/out")
        return out if before is None else out.where(F.col(self.time[0]) < F.lit(before))


def replayed_join(left: DataFrame, right: DataFrame, key: tuple[str, str], time: tuple[str, str], within: str | None = None, how: str = "inner", parts: int = 3, label: str = "joined-streams") -> DataFrame:
    """The join of two tables, run as streams: their rows arrive in order of time in several parts, with a restart after each.

    The rows are those of the batch join, except left rows without a time, which no watermark ever closes. ``within``
    bounds the time from a left row to its right ones and with it the state; without it the state keeps all rows. ``how``
    is inner or left_outer.
    """
    spark = left.sparkSession
    streams = JoinedStreams(spark, new_folder(spark, label), left, right, key, time, within, how)
    cuts = time_cuts([(left, time[0]), (right, time[1])], parts)
    for number in range(len(cuts) + 1):
        streams.arrive(part_of(left, time[0], cuts, number), part_of(right, time[1], cuts, number))
        streams.run()
    return streams.result() if how == "inner" else streams.result(streams.finish())
