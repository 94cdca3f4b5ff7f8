"""Expectations that are counted by the job that writes, in batch and in streams.

The counts ride along in the plan of the write (``DataFrame.observe``), so nothing is read twice. Rows that break an
expectation of kind quarantine go to a folder of their own in the same write. Named metrics and a listener are used in
batch as well: with an ``Observation`` the session can no longer be serialized, and models whose summaries hold it fail.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.java_gateway import ensure_callback_server_started
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from lodestream.operators.expectations import Expectations, holds

GOOD = "_good"
#: Share of rows, in percent, that must pass for each status; below the last it is CRITICAL.
STATUS = ((99.0, "HEALTHY"), (95.0, "WARNING"))


@dataclass
class RunResult:
    """What a run read, wrote and found; ``broken`` counts the rows that break each expectation."""

    run_id: str
    table: str
    success: bool
    seen: int = 0
    written: int = 0
    quarantined: int = 0
    dropped: int = 0
    batches: int = 0
    broken: dict[str, int] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    duration_seconds: float = 0.0

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    def pass_percent(self) -> dict[str, float]:
        """Share of rows that hold each expectation; 100 for a run without rows."""
        return {name: round(100.0 * (self.seen - n) / self.seen, 2) if self.seen else 100.0 for name, n in self.broken.items()}

    def status(self) -> str:
        """The status of the worst expectation; FAILED for a run that did not end well."""
        worst = min(self.pass_percent().values(), default=100.0)
        return next((name for least, name in STATUS if worst >= least), "CRITICAL") if self.success else "FAILED"

    def metrics(self, spark: SparkSession) -> DataFrame:
        """One row per expectation, with the columns of ``Expectations.metrics``."""
        return spark.createDataFrame([(self.seen, name, n) for name, n in self.broken.items()], "seen long, expectation string, broken long")


class WriteFailed(RuntimeError):
    """A checked write that failed; ``result`` says what is known of it."""

    def __init__(self, result: RunResult):
        super().__init__(result.errors[0])
        self.result = result


def _counts(rules: Expectations) -> list[Column]:
    names = list(rules.all().items())
    return [F.count(F.lit(1)).alias("seen"), *[F.coalesce(F.sum(F.when(holds(c), 0).otherwise(1)), F.lit(0)).alias(f"broken_{k}") for k, (_, c) in enumerate(names)]]


def _outcome() -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col(GOOD), 1).otherwise(0)), F.lit(0)).alias("written"), F.coalesce(F.sum(F.when(F.col(GOOD), 0).otherwise(1)), F.lit(0)).alias("quarantined")]


def checked(df: DataFrame, rules: Expectations, before: str, after: str) -> DataFrame:
    """df with its expectations counted on the way: rows that fail or are dropped are gone, others have _broken and _good."""
    out = df.observe(before, *_counts(rules))
    for name, c in rules.fail.items():
        out = out.where(holds(c) | F.raise_error(F.lit(f"expectation {name} is broken")).cast("boolean"))
    for c in rules.drop.values():
        out = out.where(holds(c))
    broken = F.array_compact(F.array(*[F.when(~holds(c), F.lit(n)) for n, c in rules.quarantine.items()])).cast("array<string>")
    return out.withColumn("_broken", broken).withColumn(GOOD, F.size("_broken") == 0).observe(after, *_outcome())


def _result(run: str, table: str, rules: Expectations, counted: list[dict[str, int]], start: float) -> RunResult:
    total = lambda name: sum(int(c.get(name) or 0) for c in counted)
    seen, written, quarantined = total("seen"), total("written"), total("quarantined")
    broken = {name: total(f"broken_{k}") for k, name in enumerate(rules.all())}
    return RunResult(run, table, True, seen, written, quarantined, seen - written - quarantined, len(counted), broken, [], round(time.time() - start, 3))


class _Executions:
    """Hears of the session's executions and keeps the metrics of some names."""

    def __init__(self, names: list[str]):
        self.names, self.found, self.complete = names, {}, threading.Event()

    def onSuccess(self, function, execution, nanoseconds) -> None:
        metrics = execution.observedMetrics()
        for name in self.names:
            if metrics.contains(name):
                self.found.update(json.loads(metrics.apply(name).json()))
                self.names = [n for n in self.names if n != name]
        if not self.names:
            self.complete.set()

    def onFailure(self, function, execution, error) -> None:
        pass

    class Java:
        implements = ["org.apache.spark.sql.util.QueryExecutionListener"]


def write(df: DataFrame, rules: Expectations, path: str, patience: float = 60.0) -> RunResult:
    """Write df below ``path``, good rows and rows for quarantine in folders of their own, counted by that one job."""
    spark, run, start = df.sparkSession, uuid.uuid4().hex, time.time()
    names = [f"before-{run}", f"after-{run}"]
    ensure_callback_server_started(spark.sparkContext._gateway)
    heard, listeners = _Executions(list(names)), spark._jsparkSession.listenerManager()
    listeners.register(heard)
    try:
        checked(df, rules, *names).write.partitionBy(GOOD).parquet(path)
        if not heard.complete.wait(patience):  # the listener hears of the write a little later
            raise TimeoutError(f"{path} is written, but its counts did not come in {patience} seconds")
    except Exception as error:
        raise WriteFailed(RunResult(run, path, False, errors=[str(error)], duration_seconds=round(time.time() - start, 3))) from error
    finally:
        listeners.unregister(heard)
    return _result(run, path, rules, [heard.found], start)


class _Listener(StreamingQueryListener):
    """The observed counts of a query's batches, by number; a repeated batch replaces its counts."""

    def __init__(self, run: str):
        self.run, self.batches, self.ended, self.query = run, {}, threading.Event(), None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = {name: row.asDict() for name, row in event.progress.observedMetrics.items() if name.endswith(self.run)}
        if found:
            self.query = event.progress.runId
            self.batches[event.progress.batchId] = {k: v for row in found.values() for k, v in row.items()}

    def onQueryTerminated(self, event) -> None:
        if self.query is None or event.runId == self.query:
            self.ended.set()


def write_stream(df: DataFrame, rules: Expectations, path: str, checkpoint: str, patience: float = 60.0) -> RunResult:
    """Write what a stream has now, as ``write`` does, each batch counted by its own job; ends when all of it is written.

    A later call with the same checkpoint goes on from there, and its result counts what it wrote itself.
    """
    spark, run, start = df.sparkSession, uuid.uuid4().hex, time.time()
    listener = _Listener(run)
    spark.streams.addListener(listener)
    try:
        query = checked(df, rules, f"before-{run}", f"after-{run}").writeStream.partitionBy(GOOD).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        listener.query = query.runId if hasattr(query, "runId") else None
        try:
            query.awaitTermination()
        except Exception as error:
            raise WriteFailed(RunResult(run, path, False, errors=[str(error)], duration_seconds=round(time.time() - start, 3))) from error
        listener.ended.wait(patience)  # the listener hears of a batch a little later
    finally:
        spark.streams.removeListener(listener)
    return _result(run, path, rules, [counts for counts in listener.batches.values() if counts.get("seen")], start)


def read(spark: SparkSession, path: str, good: bool = True) -> DataFrame:
    """The good rows of a checked write, without its own columns; or those in quarantine, with what they break."""
    rows = spark.read.parquet(path).where(F.col(GOOD) == good).drop(GOOD)
    return rows.drop("_broken") if good else rows
