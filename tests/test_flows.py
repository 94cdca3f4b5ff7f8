"""Flows and dashboard datasets by hand-written rows."""

from pyspark.sql import functions as F

from lodestream.clinical import dashboard, flows


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_codes_and_words(spark):
    df = spark.createDataFrame([("A01", "Heart failure with Diabetes"), ("A77", "hypertension"), (None, None), ("", "")], "code string, name string")
    got = df.select(flows.labelled(F.col("code"), flows.EVENTS, F.col("code")), flows.by_words(F.col("name"), flows.CONDITIONS, "Other")).collect()
    assert [tuple(r) for r in got] == [("Admission", "Diabetes"), ("A77", "Other"), (None, "Other"), ("", "Other")]


def test_tests_without_flags(spark):
    given = spark.createDataFrame([("Na", None), ("Na", "N"), ("Na", ""), (None, "HH"), (None, "H")], "observation_text string, abnormal_flags string")
    assert rows(flows.tests_by_result(given)) == [("Na", "Normal", 2), ("Na", "Other", 1), ("Unknown Test", "High", 2)]
    assert flows.tests_by_result(given, limit=2).orderBy("test_type").collect()[0]["result_status"] == "Normal"


def test_journey_counts_patients_once(spark):
    adt = spark.createDataFrame([("1", "A01", "U"), ("1", "A01", "U"), ("1", "A04", None), ("1", "A04", "Unknown"), ("1", "A03", "U"), ("1", "A03", "U"), ("2", "A04", ""), (None, "A01", "U"), ("3", "A03", "U"), ("4", None, "U")], "patient_id string, event_type_code string, location_unit string")
    labs = spark.createDataFrame([("1",)] * 6 + [("2",), (None,), ("9",)], "patient_id string")
    journey = flows.patient_journey(adt, labs)
    assert rows(journey) == [("Emergency", "U", "High Lab Activity", "Discharged", 1), ("Scheduled", "", "Low Lab Activity", "In Hospital", 1), ("Scheduled", "Unknown", "High Lab Activity", "Discharged", 1)]
    links = flows.journey_links(journey, ["entry_type", "unit", "lab_activity", "outcome"])
    assert rows(links.where("hop = 3")) == [(3, "High Lab Activity", "Discharged", 2), (3, "Low Lab Activity", "In Hospital", 1)]
    assert rows(flows.patient_journey(adt.limit(0), labs)) == []


def test_journey_shuffles_each_table_once(spark):
    """No exchange but by the patient for each table and one for the counts."""
    adt = spark.range(100).select(F.col("id").cast("string").alias("patient_id"), F.lit("A01").alias("event_type_code"), F.lit("U").alias("location_unit"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = flows.patient_journey(adt, adt.select("patient_id"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 3


def test_care_journey(spark):
    encounter = spark.createDataFrame([("1", "AMB"), ("1", "AMB"), ("1", "SS"), ("2", "INVALID"), ("3", None), (None, "AMB"), ("4", "IMP")], "subject_id string, class_code string")
    observation = spark.createDataFrame([("1", "laboratory"), ("1", "laboratory"), ("1", "x"), ("4", None)], "subject_id string, category_code string")
    condition = spark.createDataFrame([("1", None), ("1", "remission"), (None, "active")], "subject_id string, clinical_status_code string")
    got = rows(flows.care_journey(encounter, observation, condition))
    assert got == [(c, o, d, 1) for c, o, d in [("Ambulatory", "Labs Ordered", "Under Monitoring"), ("Ambulatory", "Other Assessment", "Under Monitoring"), ("Inpatient", "No Observations", "No Diagnosis"), ("Other", "Labs Ordered", "Under Monitoring"), ("Other", "Other Assessment", "Under Monitoring")]]


def small(spark):
    make = spark.createDataFrame
    return {
        "patient": make([("1", True, "male", "A"), ("2", False, None, "B"), ("3", True, "other", "C")], "id string, active boolean, gender string, full_name string").selectExpr("*", "DATE '1990-01-01' AS birth_date", "timestamp_seconds(CAST(id AS INT)) AS _ingestion_timestamp"),
        "encounter": make([("1", "finished", "in"), ("1", "odd", "in"), ("9", "finished", None), (None, "odd", "in")], "subject_id string, status string, class_display string").withColumn("type_display", F.lit("t")),
        "observation": make([("o1", "1", "final", "c", "k"), ("o2", "1", "registered", None, None)], "id string, subject_id string, status string, code_display string, category_display string").selectExpr("*", "'v' AS value", "'u' AS value_unit", "timestamp_seconds(0) AS _ingestion_timestamp"),
        "condition": make([("active", "c"), (None, "c")], "clinical_status_code string, code_display string").withColumn("category_display", F.lit("k")),
        "medication_request": make([("active", "m")] * 2, "status string, medication_display string"),
        "immunization": make([("1", "not-done", "v"), ("1", "completed", "v"), (None, None, "w")], "patient_id string, status string, vaccine_display string"),
        "bronze": make([("Patient", True), ("Patient", False), (None, False)], "resource_type string, is_valid boolean"),
        "quarantine": make([("x",), ("y",)], "raw_resource string"),
    }


def test_datasets(spark, tmp_path):
    given = small(spark)
    figures = {r["dataset"]: r["n"] for r in dashboard.totals(given).collect()}
    assert figures == {name: dashboard.dataset(given, name).first()["n"] for name in (*dashboard.TOTALS, "patients_immunized")}
    assert (figures["active_patients"], figures["finished_encounters"], figures["patients_immunized"], figures["valid_resources"], figures["quarantined"], figures["active_conditions"]) == (2, 2, 1, 1, 2, 1)
    assert rows(dashboard.dataset(given, "patient_gender")) == [("Male", 1), ("Other", 1), ("Other", 1)]
    assert rows(dashboard.dataset(given, "immunization_status")) == [("Completed", 1), ("Not Done", 1), (None, 1)]
    assert rows(dashboard.dataset(given, "encounter_patient_heatmap")) == [("in", "male", 2)]
    assert [r["id"] for r in dashboard.recent_patients(given, 2).collect()] == ["3", "2"]
    assert [tuple(r) for r in dashboard.validation_quality(given).collect()] == [(None, 1, 0, 0.0), ("Patient", 2, 1, 50.0)]
    assert len(dashboard.NAMES) == 40
    assert set(dashboard.write(given, str(tmp_path))) == {"totals", "groups", *dashboard.OTHERS}
    for name in ("totals", "groups", *dashboard.OTHERS):
        again = {"totals": dashboard.totals, "groups": dashboard.groups}.get(name, lambda t, n=name: dashboard.dataset(t, n))(given)
        assert rows(spark.read.parquet(f"{tmp_path}/{name}").select(again.columns)) == rows(again), name


def test_groups_are_the_single_datasets(spark, monkeypatch):
    monkeypatch.setitem(dashboard.NAMED, "encounter_types", ("encounter", "type_display", 1))
    given = small(spark)
    given["encounter"] = given["encounter"].withColumn("type_display", F.coalesce("status", F.lit("t")))
    found = dashboard.groups(given).collect()
    for name in (*dashboard.NAMED, *dashboard.CODED):
        assert sorted([(r["label"], r["n"]) for r in found if r["dataset"] == name], key=str) == rows(dashboard.dataset(given, name)), name
    assert len([r for r in found if r["dataset"] == "encounter_types"]) == 1


def test_empty_tables(spark):
    given = {name: df.limit(0) for name, df in small(spark).items()}
    assert {r["n"] for r in dashboard.totals(given).collect()} == {0} and dashboard.groups(given).count() == 0
    for name in (*dashboard.NAMED, *dashboard.CODED, *dashboard.OTHERS):
        assert dashboard.dataset(given, name).count() == 0
