"""Tables of hash buckets with a manifest, for upserts that rewrite only the buckets that they touch.

A row's bucket is a hash of its key. A version is a manifest: for each bucket the folders with its rows, the batches
that each writer has committed, the time. Data files are never changed. A commit renames a finished manifest to the next
number, which fails where another writer was first; then a writer whose buckets the other left alone moves its own
entries to the new version, and only one whose buckets were changed merges again. A batch that was committed before is
not applied again. What a lost writer leaves is files that no manifest names; ``vacuum`` removes them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestream.operators import merge

BUCKET = "_bucket"
TRIES = 20


class VersionGone(ValueError):
    """A version that never was, or whose files were removed by vacuum."""


def _fs(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions."""
    fs, folder = _fs(spark, f"{path}/_manifests")
    return sorted(int(e.getPath().getName().removesuffix(".json")) for e in fs.listStatus(folder) if e.getPath().getName().endswith(".json")) if fs.exists(folder) else []


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The manifest of a version, by default of the latest; None for a table without any."""
    known = versions(spark, path)
    if not known and version is None:
        return None
    number = known[-1] if version is None else version
    if number not in known:
        raise VersionGone(f"{path} has no version {number}; it has {known[:1]} to {known[-1:]}")
    return json.loads(spark.read.text(f"{path}/_manifests/{number:08d}.json", wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, content: dict) -> bool:
    """Make the content the version of its number, unless that number is taken."""
    jvm = spark._jvm
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}/_manifests/.{uuid.uuid4().hex}")
    final = jvm.org.apache.hadoop.fs.Path(f"{path}/_manifests/{content['version']:08d}.json")
    fs = draft.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(draft)
    out.write(json.dumps(content).encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(draft, final, none)  # unlike FileSystem.rename, never over an existing file
    except Exception as taken:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(taken):
            return False
        raise
    return True


def _rows(spark: SparkSession, path: str, state: dict, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a version, or of some of its buckets."""
    schema = StructType.fromJson(state["schema"])
    folders = [f"{path}/{f}" for b, fs in state["buckets"].items() if buckets is None or int(b) in buckets for f in fs]
    if not folders:
        return spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).parquet(*folders)
    except AnalysisException as gone:
        raise VersionGone(f"files of version {state['version']} of {path} were removed") from gone


def read(spark: SparkSession, path: str, version: int | None = None, as_of: datetime | None = None) -> DataFrame:
    """The rows of the latest version, of a number, or of the last version that was committed by a time."""
    if as_of is not None:
        known = [(n, manifest(spark, path, n)) for n in versions(spark, path)]
        found = [m for _, m in known if m["committed"] <= as_of.timestamp()]
        if not found:
            raise VersionGone(f"{path} has no version as early as {as_of}")
        return _rows(spark, path, found[-1])
    state = manifest(spark, path, version)
    if state is None:
        raise VersionGone(f"{path} is no table")
    return _rows(spark, path, state)


def _written(rows: DataFrame, path: str, key: str, buckets: int, files: int) -> dict[str, list[str]]:
    """Write rows by bucket, each in at most ``files`` files; the new folder of each bucket that got rows."""
    spark = rows.sparkSession
    folder = f"data/{uuid.uuid4().hex}"
    rows.repartition(F.col(BUCKET), F.pmod(F.hash(key), F.lit(files))).write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
    fs, root = _fs(spark, f"{path}/{folder}")
    names = [e.getPath().getName() for e in fs.listStatus(root) if e.isDirectory()]
    return {name.removeprefix(f"{BUCKET}="): [f"{folder}/{name}"] for name in names if name.startswith(f"{BUCKET}=")}


def upsert(changes: DataFrame, path: str, key: str, buckets: int = 64, writer: str | None = None, batch: int | None = None, files: int = 1, before_commit: Callable[[], None] | None = None) -> dict | None:
    """Merge changes, one per key, into the table; returns the manifest, or None for a batch that was committed before.

    Only buckets with changes are read and written. ``buckets`` holds for a new table and stays. ``writer`` and ``batch``
    name a batch of a stream: numbers of a writer rise, and a number that isn't above the last one is a replay. An empty
    batch commits its number only. ``before_commit`` is called ahead of each attempt to commit, for tests of conflicts.
    """
    changes = changes.persist()
    try:
        return _upsert(changes, path, key, buckets, writer, batch, files, before_commit or (lambda: None))
    finally:
        changes.unpersist()


def _upsert(changes: DataFrame, path: str, key: str, buckets: int, writer: str | None, batch: int | None, files: int, before_commit: Callable[[], None]) -> dict | None:
    spark = changes.sparkSession
    merged_from: dict | None = None
    new: dict[str, list[str]] = {}
    for _ in range(TRIES):
        state = manifest(spark, path) or {"version": -1, "key": key, "n_buckets": buckets, "buckets": {}, "batches": {}, "schema": changes.schema.jsonValue()}
        names = [f["name"] for f in state["schema"]["fields"]]
        if state["key"] != key or sorted(names) != sorted(changes.columns):
            raise ValueError(f"{path} has the key {state['key']} and the columns {names}, not {key} and {changes.columns}")
        if writer is not None and batch is not None and state["batches"].get(writer, -1) >= batch:
            return None
        if merged_from is None or any(state["buckets"].get(b) != merged_from["buckets"].get(b) for b in new):
            dealt = changes.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(state["n_buckets"])))
            touched = [r[0] for r in dealt.select(BUCKET).distinct().collect()]
            old = _rows(spark, path, state, touched).withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(state["n_buckets"])))
            new = _written(merge.upsert(old, dealt.select(*old.columns), key), path, key, state["n_buckets"], files) if touched else {}
            merged_from = state
        before_commit()
        done = {**state["batches"], **({writer: batch} if writer is not None else {})}
        after = {**state, "version": state["version"] + 1, "buckets": {**state["buckets"], **new}, "batches": done, "committed": time.time()}
        if _publish(spark, path, after):
            return after
    raise RuntimeError(f"{path}: other writers were first {TRIES} times")


def restore(spark: SparkSession, path: str, version: int) -> dict:
    """Make the rows of an old version the latest ones, as a new version. Batches stay committed."""
    old = manifest(spark, path, version)
    _rows(spark, path, old).limit(0).collect()  # its folders must still be there
    for _ in range(TRIES):
        latest = manifest(spark, path)
        after = {**latest, "version": latest["version"] + 1, "buckets": old["buckets"], "schema": old["schema"], "committed": time.time()}
        if _publish(spark, path, after):
            return after
    raise RuntimeError(f"{path}: other writers were first {TRIES} times")


def vacuum(spark: SparkSession, path: str, keep: int = 2, older_than: float = 3600.0) -> int:
    """Delete folders that the last ``keep`` versions don't name and that are ``older_than`` seconds old; returns their number.

    A writer that is at work has folders that no manifest names yet, so the age must exceed the longest write.
    """
    used = {f for n in versions(spark, path)[-keep:] for fs in manifest(spark, path, n)["buckets"].values() for f in fs}
    fs, root = _fs(spark, f"{path}/data")
    gone = 0
    for write in fs.listStatus(root) if fs.exists(root) else []:
        if write.getModificationTime() / 1000 > time.time() - older_than:
            continue
        name = write.getPath().getName()
        for entry in fs.listStatus(write.getPath()):
            if entry.isDirectory() and f"data/{name}/{entry.getPath().getName()}" not in used:
                gone += bool(fs.delete(entry.getPath(), True))
    return gone


def history(spark: SparkSession, path: str) -> DataFrame:
    """One row a version: number, time of the commit, buckets that it changed."""
    rows, before = [], {}
    for number in versions(spark, path):
        state = manifest(spark, path, number)
        rows.append((number, datetime.fromtimestamp(state["committed"]), sum(before.get(b) != f for b, f in state["buckets"].items())))
        before = state["buckets"]
    return spark.createDataFrame(rows, "version int, committed_at timestamp, n_changed long")


def upsert_stream(rows: DataFrame, path: str, key: str, checkpoint: str, buckets: int = 64):
    """Merge each micro-batch of an update-mode stream into the table, once however often it is repeated. Returns the query."""

    def merge_batch(batch: DataFrame, number: int) -> None:
        upsert(batch, path, key, buckets, writer=checkpoint, batch=number)

    return rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge_batch).start()
