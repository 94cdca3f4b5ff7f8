"""The datasets of the operations dashboard, by name, over the tables of resources.

``tables`` maps bronze, quarantine and the six silver names of ``fhir.silver`` to DataFrames; without quarantine, the
invalid rows of bronze are. ``dataset`` gives one
dataset; ``totals`` and ``groups`` give all single figures and all counts by one column with one aggregate for each
table, and ``write`` stores all datasets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.clinical.flows import labelled

# The single figures. name -> (table, what is counted).
TOTALS = {
    "total_patients": ("patient", "*"),
    "active_patients": ("patient", "active"),
    "total_encounters": ("encounter", "*"),
    "finished_encounters": ("encounter", "status = 'finished'"),
    "inprogress_encounters": ("encounter", "status = 'in-progress'"),
    "total_observations": ("observation", "*"),
    "final_observations": ("observation", "status = 'final'"),
    "preliminary_observations": ("observation", "status = 'preliminary'"),
    "total_conditions": ("condition", "*"),
    "active_conditions": ("condition", "clinical_status_code = 'active'"),
    "total_medications": ("medication_request", "*"),
    "active_medications": ("medication_request", "status = 'active'"),
    "total_immunizations": ("immunization", "*"),
    "total_resources": ("bronze", "*"),
    "valid_resources": ("bronze", "is_valid"),
    "quarantined": ("quarantine", "*"),
}

# Labels that are shown for codes; other codes are shown as they are, or as stated.
GENDER = {"male": "Male", "female": "Female"}
ENCOUNTER = {"finished": "Finished", "in-progress": "In Progress", "planned": "Planned"}
OBSERVATION = {"final": "Final", "preliminary": "Preliminary", "registered": "Registered"}
MEDICATION = {"active": "Active", "completed": "Completed", "stopped": "Stopped"}
IMMUNIZATION = {"completed": "Completed", "entered-in-error": "Entered in Error", "not-done": "Not Done"}

# Counts by one column, nulls left out. name -> (table, column, most that are shown).
NAMED = {
    "encounter_class": ("encounter", "class_display", None),
    "encounter_types": ("encounter", "type_display", 10),
    "observation_categories": ("observation", "category_display", None),
    "observation_codes": ("observation", "code_display", 10),
    "condition_categories": ("condition", "category_display", None),
    "top_conditions": ("condition", "code_display", 10),
    "top_medications": ("medication_request", "medication_display", 10),
    "vaccine_types": ("immunization", "vaccine_display", None),
}

# Counts by a code, shown by its label. name -> (table, column, labels, label of all other codes).
CODED = {
    "patient_gender": ("patient", "gender", GENDER, "Other"),
    "encounter_status": ("encounter", "status", ENCOUNTER, None),
    "observation_status": ("observation", "status", OBSERVATION, None),
    "medication_status": ("medication_request", "status", MEDICATION, None),
    "immunization_status": ("immunization", "status", IMMUNIZATION, None),
}
STATUS_OF = {"Encounter": "encounter", "Observation": "observation", "Medication": "medication_request"}
Tables = dict[str, DataFrame]


def _n() -> Column:
    return F.count(F.lit(1)).alias("n")


def _count(what: str) -> Column:
    return F.count(F.lit(1)) if what == "*" else F.count_if(F.expr(what))


def _source(tables: Tables, name: str) -> tuple[str, str]:
    """Table and what is counted of a single figure. A quarantine that isn't stored is counted in bronze, in its one pass."""
    table, what = TOTALS[name]
    return ("bronze", "NOT is_valid") if table == "quarantine" and table not in tables else (table, what)


def totals(tables: Tables) -> DataFrame:
    """dataset, n for all single figures: each table is read once, whatever the number of its figures."""
    out, figures_of = None, {name: _source(tables, name) for name in TOTALS}
    for table in dict.fromkeys(t for t, _ in figures_of.values()):
        own = {name: _count(what).alias(name) for name, (t, what) in figures_of.items() if t == table}
        if table == "immunization":
            own["patients_immunized"] = F.countDistinct("patient_id").alias("patients_immunized")
        figures = tables[table].agg(*own.values()).select(F.inline(F.array(*[F.struct(F.lit(name).alias("dataset"), F.col(name).alias("n")) for name in own])))
        out = figures if out is None else out.unionByName(figures)
    return out


def _top(counted: DataFrame, label: str, limit: int | None) -> DataFrame:
    return counted if limit is None else counted.orderBy(F.desc("n"), label).limit(limit)


def named(tables: Tables, name: str) -> DataFrame:
    """label, n of one dataset of NAMED; ties at its limit go to the smaller label."""
    table, column, limit = NAMED[name]
    rows = tables[table].where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(_n())
    return _top(rows, "label", limit)


def coded(tables: Tables, name: str) -> DataFrame:
    """label, n of one dataset of CODED. It is counted by code, so several codes may show the same label; so may null."""
    table, column, labels, other = CODED[name]
    return tables[table].groupBy(column).agg(_n()).select(labelled(F.col(column), labels, other or F.col(column)).alias("label"), "n")


def resource_counts(tables: Tables) -> DataFrame:
    return tables["bronze"].where("is_valid").groupBy("resource_type").agg(_n())


def patients_by_birth_year(tables: Tables, limit: int = 20) -> DataFrame:
    """The latest years of birth."""
    return tables["patient"].where("birth_date IS NOT NULL").groupBy(F.year("birth_date").alias("birth_year")).agg(_n()).orderBy(F.desc("birth_year")).limit(limit)


def active_vs_inactive(tables: Tables) -> DataFrame:
    return tables["patient"].groupBy(F.when(F.col("active"), "Active").otherwise("Inactive").alias("status")).agg(_n())


def recent_patients(tables: Tables, limit: int = 10) -> DataFrame:
    """The patients that were ingested last, ties by id. Needs the ingestion time in bronze."""
    return tables["patient"].orderBy(F.desc("_ingestion_timestamp"), "id").limit(limit).select("id", F.col("full_name").alias("patient_name"), "gender", "birth_date")


def recent_observations(tables: Tables, limit: int = 15) -> DataFrame:
    """The named observations that were ingested last, ties by id. Needs the ingestion time in bronze."""
    last = tables["observation"].where("code_display IS NOT NULL").orderBy(F.desc("_ingestion_timestamp"), "id").limit(limit)
    return last.select(F.col("subject_id").alias("patient_ref"), F.col("code_display").alias("observation_type"), "value", "value_unit", "status")


def validation_quality(tables: Tables, limit: int = 15) -> DataFrame:
    """The types of resource that are valid least often, in per cent; ties by type, resources without one first."""
    valid = F.count_if("is_valid")
    rated = tables["bronze"].groupBy("resource_type").agg(F.count(F.lit(1)).alias("total"), valid.alias("valid"), F.round(valid * 100.0 / F.count(F.lit(1)), 2).alias("success_rate"))
    return rated.orderBy("success_rate", F.asc_nulls_first("resource_type")).limit(limit)


def encounter_patient_heatmap(tables: Tables) -> DataFrame:
    """Encounters by class and the patient's gender. Silver holds bare ids, so they are joined without a prefix; encounters
    are first counted by patient and class, so a patient with very many is one row for each class in the join. Both sides
    grow with the input and are shuffled at any size; neither goes through the driver."""
    visits = tables["encounter"].where("class_display IS NOT NULL AND subject_id IS NOT NULL").groupBy("subject_id", "class_display").agg(F.count(F.lit(1)).alias("visits"))
    joined = visits.join(tables["patient"].select("id", "gender").hint("merge"), F.col("subject_id") == F.col("id"))
    return joined.groupBy(F.col("class_display").alias("encounter_class"), "gender").agg(F.sum("visits").alias("n"))


def resource_status_heatmap(tables: Tables) -> DataFrame:
    out = None
    for kind, table in STATUS_OF.items():
        one = tables[table].groupBy("status").agg(_n()).select(F.lit(kind).alias("resource_type"), "status", "n")
        out = one if out is None else out.unionByName(one)
    return out


def condition_status_stacked(tables: Tables) -> DataFrame:
    rows = tables["condition"].where("code_display IS NOT NULL AND clinical_status_code IS NOT NULL")
    return rows.groupBy(F.col("code_display").alias("condition_type"), F.col("clinical_status_code").alias("status")).agg(_n())


OTHERS: dict[str, Callable[[Tables], DataFrame]] = {
    "resource_counts": resource_counts, "resource_types": resource_counts, "patients_by_birth_year": patients_by_birth_year, "active_vs_inactive": active_vs_inactive, "recent_patients": recent_patients,
    "recent_observations": recent_observations, "validation_quality": validation_quality, "encounter_patient_heatmap": encounter_patient_heatmap, "resource_status_heatmap": resource_status_heatmap,
    "condition_status_stacked": condition_status_stacked,
}
NAMES = [*TOTALS, "patients_immunized", *NAMED, *CODED, *OTHERS]


def dataset(tables: Tables, name: str) -> DataFrame:
    """One dataset by its name; single figures give one row with n."""
    if name in NAMED:
        return named(tables, name)
    if name in CODED:
        return coded(tables, name)
    if name in OTHERS:
        return OTHERS[name](tables)
    if name == "patients_immunized":
        return tables["immunization"].agg(F.countDistinct("patient_id").alias("n"))
    table, what = _source(tables, name)
    return tables[table].agg(_count(what).alias("n"))


def groups(tables: Tables) -> DataFrame:
    """dataset, label, n for all of CODED and NAMED: each table is read once, whatever the number of its datasets.

    A row gives one pair for each dataset of its table, and pairs are added up in each task before they are shuffled.
    Ranks are among a dataset's distinct labels, sorted (and spilled, if need be), never among rows.
    """
    columns = {name: (spec[0], spec[1]) for name, spec in (CODED | NAMED).items()}
    out = None
    for table in dict.fromkeys(t for t, _ in columns.values()):
        pairs = [F.struct(F.lit(name).alias("dataset"), F.col(column).alias("code")) for name, (t, column) in columns.items() if t == table]
        counted = tables[table].select(F.inline(F.array(*pairs))).where(F.col("code").isNotNull() | F.col("dataset").isin(list(CODED))).groupBy("dataset", "code").agg(_n())
        out = counted if out is None else out.unionByName(counted)
    label = F.col("code")
    for name, (_, _, labels, other) in CODED.items():
        label = F.when(F.col("dataset") == name, labelled(F.col("code"), labels, other or F.col("code"))).otherwise(label)
    rank = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("n"), "code"))
    limit = labelled(F.col("dataset"), {name: limit for name, (_, _, limit) in NAMED.items() if limit}, F.lit(2**31 - 1))
    shown = out.withColumn("_r", rank).where(F.col("_r") <= limit)
    return shown.select("dataset", label.alias("label"), "n")


def write(tables: Tables, root: str) -> list[str]:
    """Store the single figures in root/totals, the counts by one column in root/groups, by dataset, and every other
    dataset in a folder of its own; gives the folders' names."""
    totals(tables).write.mode("overwrite").parquet(f"{root}/totals")
    groups(tables).write.mode("overwrite").partitionBy("dataset").parquet(f"{root}/groups")
    for name in OTHERS:
        dataset(tables, name).write.mode("overwrite").parquet(f"{root}/{name}")
    return ["totals", "groups", *OTHERS]
