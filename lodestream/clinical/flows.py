"""Flow counts over the message tables and the silver tables of resources, as links between stages.

Every function takes tables as ``message_tables`` or ``fhir.silver`` give them and returns counts. Blank codes are values
of their own, as in the tables; nulls get the label stated. Limited results break ties by their labels.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of codes.
EVENTS = {"A01": "Admission", "A02": "Transfer", "A03": "Discharge", "A04": "Registration", "A08": "Update"}
RESULTS = {"H": "High", "HH": "High", "L": "Low", "LL": "Low", "N": "Normal"}
CONTROLS = {"NW": "New", "XO": "Changed", "CA": "Cancelled", "SC": "Status Changed"}
SETTINGS = {"AMB": "Ambulatory", "EMER": "Emergency", "IMP": "Inpatient", "OBSENC": "Observation", "PRENC": "Pre-Admission", "SS": "Short Stay", "HH": "Home Health", "VR": "Virtual"}
JOURNEY_SETTINGS = {"AMB": "Ambulatory", "EMER": "Emergency", "IMP": "Inpatient", "OBSENC": "Observation"}
CATEGORIES = {"vital-signs": "Vital Signs", "laboratory": "Laboratory"}
ASSESSMENTS = {"vital-signs": "Vitals Taken", "laboratory": "Labs Ordered"}
OUTCOMES = {"active": "Active Diagnosis", "resolved": "Resolved"}

# Classes by words in a name, case-sensitive; the first class that has a word in the name is taken.
CONDITIONS = {
    "Diabetes": ["Diabetes"],
    "Hypertension": ["Hypertension", "Blood Pressure"],
    "Cardiovascular": ["Heart", "Cardiac"],
    "Respiratory": ["COPD", "Asthma", "Respiratory"],
    "Infectious": ["Fever", "Infection"],
    "Musculoskeletal": ["Pain", "Arthritis"],
    "Mental Health": ["Depression", "Anxiety"],
    "Oncology": ["Cancer", "Tumor"],
}
DRUGS = {
    "Pain Relief": ["Ibuprofen", "Acetaminophen", "Naproxen"],
    "Cardiovascular": ["Amlodipine", "Lisinopril", "Metoprolol"],
    "Diabetes": ["Metformin", "Insulin", "Glipizide"],
    "Gastrointestinal": ["Omeprazole", "Pantoprazole"],
    "Antibiotics": ["Amoxicillin", "Azithromycin", "Ciprofloxacin"],
    "Respiratory": ["Albuterol", "Fluticasone"],
    "Mental Health": ["Sertraline", "Escitalopram", "Duloxetine"],
    "Cholesterol": ["Atorvastatin", "Simvastatin"],
}
TESTS = {
    "Heart Rate": ["Heart", "Pulse"],
    "Blood Pressure": ["Blood Pressure", "Systolic", "Diastolic"],
    "Temperature": ["Temperature"],
    "Respiratory Rate": ["Respiratory", "Breathing"],
    "Glucose": ["Glucose"],
    "Cholesterol": ["Cholesterol", "LDL", "HDL"],
    "Hemoglobin": ["Hemoglobin", "A1c"],
    "Kidney Function": ["Creatinine"],
    "Body Metrics": ["BMI", "Weight", "Height"],
}
MANY_LABS = 5


def labelled(code: Column, labels: dict[str, str], other: Column | str) -> Column:
    """The label of a code; other for codes without one and for null."""
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code), other if isinstance(other, Column) else F.lit(other))


def by_words(name: Column, classes: dict[str, list[str]], other: str) -> Column:
    """The first class of which a word stands in the name; other where none does and for null."""
    out = F
    for label, words in classes.items():
        out = out.when(reduce(or_, [name.contains(w) for w in words]), label)
    return out.otherwise(other)


def _links(rows: DataFrame, limit: int | None = None, **stages: Column) -> DataFrame:
    """How many rows have each combination of stages."""
    counted = rows.groupBy(*[c.alias(n) for n, c in stages.items()]).agg(F.count(F.lit(1)).alias("n"))
    return counted if limit is None else counted.orderBy(F.desc("n"), *[F.asc_nulls_first(n) for n in stages]).limit(limit)


def events_by_unit(adt: DataFrame) -> DataFrame:
    """event_name, unit, n of messages that name a unit."""
    return _links(adt.where("location_unit <> ''"), event_name=labelled(F.col("event_type_code"), EVENTS, F.col("event_type_code")), unit=F.col("location_unit"))


def tests_by_result(oru_observations: DataFrame, limit: int = 50) -> DataFrame:
    """test_type, result_status, n: the most frequent ones. No flag at all is Normal, a blank one is Other."""
    flag = F.col("abnormal_flags")
    return _links(oru_observations, limit, test_type=F.coalesce("observation_text", F.lit("Unknown Test")), result_status=F.when(flag.isNull(), "Normal").otherwise(labelled(flag, RESULTS, "Other")))


def orders_by_control(orm: DataFrame, limit: int = 30) -> DataFrame:
    """order_type, order_status, n: the most frequent ones."""
    control = F.coalesce("order_control", F.lit("Unknown"))
    return _links(orm, limit, order_type=F.coalesce("service_text", F.lit("Unknown Order")), order_status=labelled(control, CONTROLS, control))


def patient_journey(adt: DataFrame, oru_observations: DataFrame) -> DataFrame:
    """entry_type, unit, lab_activity, outcome and how many distinct patients went that way.

    Both tables are brought to one row for each patient before they meet, on the key that they are aggregated by: a
    patient's rows are no more than their distinct entries, so neither repeated messages nor repeated discharges multiply.
    Messages without a patient (null) count nobody; the blank patient is one patient.
    """
    event = F.col("event_type_code")
    entry = F.struct(F.when(event == "A01", "Emergency").otherwise("Scheduled").alias("entry_type"), F.coalesce("location_unit", F.lit("Unknown")).alias("unit"))
    stays = adt.where(event.isin("A01", "A03", "A04") & F.col("patient_id").isNotNull()).groupBy("patient_id").agg(F.collect_set(F.when(event != "A03", entry)).alias("entries"), F.max(event == "A03").alias("left"))
    labs = oru_observations.where("patient_id IS NOT NULL").groupBy("patient_id").agg(F.count(F.lit(1)).alias("labs"))
    each = stays.join(labs, "patient_id", "left").select("labs", "left", F.inline("entries"))
    activity = F.when(F.col("labs") > MANY_LABS, "High Lab Activity").when(F.col("labs") > 0, "Low Lab Activity").otherwise("No Labs")
    return _links(each, entry_type=F.col("entry_type"), unit=F.col("unit"), lab_activity=activity, outcome=F.when(F.col("left"), "Discharged").otherwise("In Hospital")).withColumnRenamed("n", "patient_count")


def journey_links(journey: DataFrame, stages: list[str], count: str = "patient_count") -> DataFrame:
    """hop (from 1), source, target, n between neighbouring stages of a journey, from one pass over its paths."""
    hops = F.inline(F.array(*[F.struct(F.lit(k).alias("hop"), F.col(a).alias("source"), F.col(b).alias("target")) for k, (a, b) in enumerate(zip(stages, stages[1:], strict=False), 1)]))
    return journey.select(count, hops).groupBy("hop", "source", "target").agg(F.sum(count).alias("n"))


def files_by_validity(bronze: DataFrame) -> DataFrame:
    """source_file (the name of an .ndjson file; blank for other paths, Unknown Source for none), resource_type, validation_status, n."""
    source = F.coalesce(F.regexp_extract("_source_file", r".*/([^/]+\.ndjson)$", 1), F.lit("Unknown Source"))
    return _links(bronze.where("resource_type IS NOT NULL"), source_file=source, resource_type=F.col("resource_type"), validation_status=F.when(F.col("is_valid"), "Valid").otherwise("Invalid"))


def _with_class(encounter: DataFrame) -> DataFrame:
    return encounter.where("class_code <> 'INVALID'")


def settings_by_status(encounter: DataFrame) -> DataFrame:
    """care_setting, encounter_status, n."""
    return _links(_with_class(encounter), care_setting=labelled(F.col("class_code"), SETTINGS, F.col("class_code")), encounter_status=F.initcap("status"))


def conditions_by_status(condition: DataFrame) -> DataFrame:
    """condition_category, clinical_status, n."""
    status = F.col("clinical_status_code")
    return _links(condition.where(status.isNotNull()), condition_category=by_words(F.col("code_display"), CONDITIONS, "Other"), clinical_status=F.initcap(status))


def drugs_by_status(medication_request: DataFrame) -> DataFrame:
    """drug_class, rx_status, n."""
    return _links(medication_request.where("status IS NOT NULL"), drug_class=by_words(F.col("medication_display"), DRUGS, "Other"), rx_status=F.initcap("status"))


def tests_by_category(observation: DataFrame) -> DataFrame:
    """test_type, category, obs_status, n."""
    return _links(observation.where("status IS NOT NULL"), test_type=by_words(F.col("code_display"), TESTS, "Other Tests"), category=labelled(F.col("category_code"), CATEGORIES, "Other"), obs_status=F.initcap("status"))


def care_journey(encounter: DataFrame, observation: DataFrame, condition: DataFrame) -> DataFrame:
    """care_setting, observation_type, diagnosis_outcome and how many distinct patients have all three.

    Each table is first brought to one row for each patient with the set of its few labels; resources without a patient
    count nobody. These rows meet where they were aggregated, at any size; none go through the driver.
    """

    def sets(rows: DataFrame, label: Column, name: str) -> DataFrame:
        return rows.where("subject_id IS NOT NULL").groupBy("subject_id").agg(F.collect_set(label).alias(name))

    settings = sets(_with_class(encounter), labelled(F.col("class_code"), JOURNEY_SETTINGS, "Other"), "settings")
    seen = sets(observation.where("category_code IS NOT NULL"), labelled(F.col("category_code"), ASSESSMENTS, "Other Assessment"), "seen")
    found = sets(condition, labelled(F.col("clinical_status_code"), OUTCOMES, "Under Monitoring"), "found")
    each = settings.join(seen.hint("merge"), "subject_id", "left").join(found.hint("merge"), "subject_id", "left").withColumn("care_setting", F.explode("settings")).withColumn("observation_type", F.explode_outer("seen")).withColumn("diagnosis_outcome", F.explode_outer("found"))
    links = _links(each, care_setting=F.col("care_setting"), observation_type=F.coalesce("observation_type", F.lit("No Observations")), diagnosis_outcome=F.coalesce("diagnosis_outcome", F.lit("No Diagnosis")))
    return links.withColumnRenamed("n", "patient_count")
