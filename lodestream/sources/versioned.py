"""Versioned Parquet tables: each write makes a new directory, a version is read by number or as the latest.

The last step of a write is the success marker that Spark's committer leaves in the version's directory, so a version
is either whole or invisible. A write that died leaves a directory without a marker, whose number isn't used again;
``vacuum`` removes it together with old versions. Meant for one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _numbers(spark: SparkSession, path: str) -> dict[int, bool]:
    """Numbers of all versions, and whether they are whole; through Hadoop's file system, so that any store that Spark reads works."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return {}
    found = {}
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith("_v="):
            found[int(name[3:])] = bool(fs.exists(jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")))
    return found


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions."""
    return sorted(n for n, whole in _numbers(spark, path).items() if whole)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    number = version if version is not None else max(versions(spark, path))
    return spark.read.parquet(f"{path}/_v={number}")


def write(df: DataFrame, path: str) -> int:
    """Write the next version; returns its number."""
    number = max(_numbers(df.sparkSession, path), default=-1) + 1
    df.write.parquet(f"{path}/_v={number}")
    return number


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete all but the latest ``keep`` whole versions, and what broken writes left before the latest; returns their numbers."""
    numbers = _numbers(spark, path)
    kept = versions(spark, path)[-keep:]
    gone = sorted(n for n in numbers if kept and n < kept[-1] and n not in kept)
    for n in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_v={n}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return gone


def evolve(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Write a version whose columns are those of the last version and of df: new ones are null in old rows, and the reverse."""
    spark = df.sparkSession
    if not versions(spark, path):
        return write(df, path)
    old = read(spark, path)
    kept = old if mode == "append" else old.limit(0)
    return write(kept.unionByName(df, allowMissingColumns=True), path)


def compact(spark: SparkSession, path: str, cluster_by: list[str], partitions: int) -> int:
    """The latest version rewritten into fewer files, sorted by the clustering columns, as a new version with the same rows."""
    return write(read(spark, path).repartitionByRange(partitions, *cluster_by).sortWithinPartitions(*cluster_by), path)


def history(spark: SparkSession, path: str) -> DataFrame:
    """One row a version: its number, files, bytes and time of its success marker."""
    jvm = spark._jvm
    rows = []
    for number in versions(spark, path):
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/_v={number}")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        summary = fs.getContentSummary(folder)
        marker = fs.getFileStatus(jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS"))
        rows.append((number, summary.getFileCount(), summary.getLength(), marker.getModificationTime()))
    return spark.createDataFrame(rows, "version int, n_files long, n_bytes long, ms long").selectExpr("version", "n_files", "n_bytes", "timestamp_millis(ms) as written_at")
