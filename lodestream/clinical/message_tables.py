"""The ten message tables, written: messages are parsed once into a raw table by type, and the others read only their part of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.clinical import hl7
from lodestream.operators.expectations import Expectations
from lodestream.operators.once import explode_present

# What each table expects of its rows.
_SIZE = "coalesce(size({}), 0) > 0"
EXPECTED = {
    "ADT": Expectations(warn={"patient_id": "patient_id is not null", "trigger_event": "trigger_event is not null"}),
    "ORM": Expectations(warn={"order_id": "order_id is not null", "order_control": "order_control is not null"}),
    "ORU": Expectations(warn={"patient_id": "patient_id is not null", "observations": _SIZE.format("observations")}),
    "SIU": Expectations(warn={"appointment": "placer_appointment_id is not null or filler_appointment_id is not null"}),
    "VXU": Expectations(warn={"patient_id": "patient_id is not null", "vaccinations": _SIZE.format("vaccinations")}),
}
FLAT = {"ORU": ("oru_observations", hl7.flatten_observations), "SIU": ("siu_resources", hl7.flatten_resources), "VXU": ("vxu_vaccinations", hl7.flatten_vaccinations)}


def parse_files(files: DataFrame, value: str = "value") -> DataFrame:
    """One row a message of each file: the file's other columns, the whole message, and all parse columns."""
    keep = [c for c in files.columns if c != value]
    split = explode_present(files, hl7.split_batch(F.col(value)), "_raw_message_full", keep)
    return hl7.parse(split, "_raw_message_full")


def write_tables(files: DataFrame, root: str, value: str = "value") -> dict[str, DataFrame]:
    """Write raw, quarantine, the five routed and three flattened tables below root; gives them as read back.

    raw is partitioned by message type, so that each routed table prunes to its own directory. Rows without a type go to
    Spark's default partition and to quarantine.
    """
    spark = files.sparkSession

    def written(name: str, df: DataFrame, *by: str) -> DataFrame:
        df.write.partitionBy(*by).parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    tagged = parse_files(files, value).withColumn("_type", F.nullif(F.col("message_type"), F.lit("")))
    raw = written("raw", tagged, "_type")
    tables = {"raw": raw.drop("_type"), "quarantine": written("quarantine", hl7.quarantined(raw).drop("_type"))}
    for kind in hl7.TABLES:
        own = raw.where(F.col("_type") == kind)
        tables[kind.lower()] = written(kind.lower(), hl7.route(own, kind))
        if kind in FLAT:
            name, flatten = FLAT[kind]
            tables[name] = written(name, flatten(tables[kind.lower()]))
    return tables


def expectation_metrics(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows seen and rows that break each expectation, by table."""
    out = None
    for kind, expected in EXPECTED.items():
        one = expected.metrics(tables[kind.lower()]).select(F.lit(kind).alias("table"), "expectation", "seen", "broken")
        out = one if out is None else out.unionByName(one)
    return out
