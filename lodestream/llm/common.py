"""What the operators share: the shared folder, written intermediate tables, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words in the operators on word lists.
SPACE_CLASS = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only a session on one machine, as in tests, may do without that setting and gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lodestream-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str, scratch: list[str] | None = None, level: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back. ``level`` is that of its compression.

    ``by`` names columns whose values get folders of their own.

    This cuts the lineage in a way that outlives executors, and gives the planner true sizes. The table's path is added
    to ``scratch``, for ``discard`` once nothing reads the table any more; else it stays under the folder's retention.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodestream/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, scratch: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    for path in scratch:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    scratch.clear()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters keep their form."""
    return F.translate(text, UPPER, LOWER)


def space_words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space; an empty array for null or blank text."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACE_CLASS}]+"))


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name
