"""File sources, batch and stream: whole files or lines as rows, tolerant JSON, CSV, NDJSON sink, clustered writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, path: str, glob: str = "*", whole: bool = False, stream: bool = False, files_per_trigger: int = 1000) -> DataFrame:
    """value, _source_file and _ingestion_timestamp; one row a line or a file, in all sub-directories."""
    reader = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger) if stream else spark.read
    df = reader.format("text").option("wholetext", whole).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return df.select("value", F.col("_metadata.file_path").alias("_source_file"), F.current_timestamp().alias("_ingestion_timestamp"))


def tolerant_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the text of malformed ones."""
    parsed = spark.read.text(path).select("value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("j"))
    return parsed.where("j._bad is null").select("j.*").drop("_bad"), parsed.where("j._bad is not null").select(F.col("value").alias("bad_record"))


def csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", header: bool = True) -> DataFrame:
    """Delimited files. Without a schema Spark reads the files once more to infer one."""
    reader = spark.read.option("sep", sep).option("header", header)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def csv_view(spark: SparkSession, name: str, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """A temporary SQL view with typed columns over delimited files."""
    csv(spark, path, schema, sep, header).createOrReplaceTempView(name)
    return spark.table(name)


def at_path(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Files queried by their path, without a table."""
    quoted = path.replace("`", "``")
    return spark.sql(f"SELECT * FROM {kind}.`{quoted}`")


def write_ndjson(df: DataFrame, path: str, rows_per_file: int = 1000) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.option("maxRecordsPerFile", rows_per_file).text(path)


def write_clustered(df: DataFrame, path: str, cluster_by: list[str], partitions: int, partition_by: list[str] | None = None) -> None:
    """Range-partition and sort before writing, so that row groups are narrow in the clustering columns."""
    out = df.repartitionByRange(partitions, *cluster_by).sortWithinPartitions(*cluster_by).write
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A Kafka stream as strings; needs Spark's Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "latest").options(**options)
    return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"), "timestamp", "partition", "offset")


def open_stream(spark: SparkSession, kind: str, **where: str) -> DataFrame:
    if kind == "kafka":
        return kafka(spark, **where)
    if kind == "files":
        return text_files(spark, stream=True, **where)
    raise ValueError(f"unknown source {kind!r}; kafka or files")


def libsvm(spark: SparkSession, path: str, features: int | None = None) -> DataFrame:
    """Labels and sparse vectors. Without the number of features Spark scans the files once more to find it."""
    reader = spark.read.format("libsvm")
    return (reader.option("numFeatures", features) if features else reader).load(path)
