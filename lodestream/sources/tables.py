"""Tables of the session's catalog: external and partitioned, created from a query, inserted into, overwritten by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def quoted(name: str) -> str:
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def create_as(df: DataFrame, name: str, location: str, partition_by: list[str] | None = None, properties: dict[str, str] | None = None) -> None:
    """A new external table with the rows of df. Partition columns come last, as in every later insert."""
    spark = df.sparkSession
    df.write.partitionBy(*(partition_by or [])).option("path", location).saveAsTable(name)
    if properties:
        pairs = ", ".join(f"{_text(k)} = {_text(v)}" for k, v in properties.items())
        spark.sql(f"ALTER TABLE {quoted(name)} SET TBLPROPERTIES ({pairs})")


def attach(spark: SparkSession, name: str, location: str, schema: str, partition_by: list[str] | None = None) -> None:
    """A table over files that are there already; its partitions are found in their folders."""
    by = f" PARTITIONED BY ({', '.join(map(quoted, partition_by))})" if partition_by else ""
    spark.sql(f"CREATE TABLE {quoted(name)} ({schema}) USING parquet{by} LOCATION {_text(location)}")


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _by_name(df: DataFrame, name: str) -> DataFrame:
    """df with the table's columns in the table's order, since inserts go by position; other columns are an error."""
    wanted = df.sparkSession.table(name).columns
    if sorted(df.columns) != sorted(wanted):
        raise ValueError(f"{name} has the columns {wanted}, not {df.columns}")
    return df.select(*[F.col(quoted(c)) for c in wanted])


def insert(df: DataFrame, name: str) -> None:
    """Append rows, matched by column name."""
    _by_name(df, name).write.insertInto(name)


def overwrite_partitions(df: DataFrame, name: str) -> None:
    """Replace exactly the partitions that df has rows for; other partitions stay as they are."""
    spark = df.sparkSession
    before = spark.conf.get(OVERWRITE)
    spark.conf.set(OVERWRITE, "dynamic")
    try:
        _by_name(df, name).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(OVERWRITE, before)


def partition_stats(spark: SparkSession, name: str, partition_by: list[str]) -> DataFrame:
    """Rows, files and bytes of each partition."""
    files = spark.table(name).select(*partition_by, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_bytes")).groupBy(*partition_by, "_file").agg(F.count(F.lit(1)).alias("_rows"), F.max("_bytes").alias("_bytes"))
    return files.groupBy(*partition_by).agg(F.sum("_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_files"), F.sum("_bytes").alias("n_bytes"))


def describe(spark: SparkSession, name: str) -> dict[str, str]:
    """What the catalog knows of a table: columns and their types, and its details."""
    return {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE FORMATTED {quoted(name)}").collect() if r["col_name"] and not r["col_name"].startswith("#")}


def drop(spark: SparkSession, name: str) -> None:
    """Forget a table; the files of an external one stay."""
    spark.sql(f"DROP TABLE IF EXISTS {quoted(name)}")
