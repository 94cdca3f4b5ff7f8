"""Flows and dashboard datasets on message tables and silver resources that are made from the driver's tables.

The makers vary codes by the remainders of keys, so that the SQL can state the same rows without parsing anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.clinical import dashboard, fhir, flows, hl7
from lodestream.operators.once import spread
from lodestream.plans import relational
from lodestream.plans.clinical_fhir import _cc, _json, _meta, _ref, _s
from lodestream.plans.clinical_hl7 import _header, _parsed, _seg, _text

QUERIES, ORACLES = {}, {}


def query(sql):
    def register(plan):
        names = plan.__code__.co_varnames[: plan.__code__.co_argcount]
        QUERIES[plan.__name__] = lambda spark, sf_dir: plan(*[relational.table(spark, sf_dir, n) for n in names])
        ORACLES[plan.__name__] = sql
        return plan

    return register


def _pick(key: str, values: list[str | None]) -> Column:
    """The value at the remainder of a key; null for None."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.col(key) % len(values))


def _case(key: str, values: list[str | None]) -> str:
    """The same in SQL."""
    arms = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {arms} END"


EVENTS = ["A01", "A02", "A03", "A04", "A08", "A11"]
FLAGS = ["H", "HH", "L", "LL", "N", "", "A"]
CONTROLS = ["NW", "XO", "CA", "SC", "RE"]
PATIENT = "'P' || o_custkey"


def _patient() -> Column:
    return _seg("PID", "1", "", F.concat(F.lit("P"), _text("o_custkey"), F.lit("^^^HOSP^MR")), "", "Fam^Given")


def adt(orders: DataFrame) -> DataFrame:
    """One message an order; every tenth has no place, every fourth customer a blank unit."""
    event = _pick("o_orderkey", EVENTS)
    unit = F.when(F.col("o_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("U"), (F.col("o_custkey") % 5).cast("string")))
    place = F.when(F.col("o_orderkey") % 10 != 9, _seg("PV1", "1", "I", F.concat(unit, F.lit("^r^b^f"))))
    header = _seg("MSH", "^~\\&", "APP", "FAC", "RAPP", "RFAC", "20240101", "", F.concat(F.lit("ADT^"), event), _text("o_orderkey"), "P", "2.5")
    return hl7.route(_parsed(orders.select(F.concat_ws("\n", header, F.concat(F.lit("EVN|"), event), _patient(), place).alias("file"))), "ADT")


_ADT = f"adt AS (SELECT {_case('o_orderkey', EVENTS)} AS event, {PATIENT} AS patient, CASE WHEN o_orderkey % 10 <> 9 THEN CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'U' || (o_custkey % 5) END END AS unit FROM orders)"


def results(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One message an order with an observation a line; every seventh customer has none."""
    test = F.concat(F.lit("c^test "), F.col("l_returnflag"))
    lines = lineitem.select("l_orderkey", "l_linenumber", _seg("OBX", _text("l_linenumber"), "NM", test, "", "1", "u", "", _pick("l_linenumber", FLAGS)).alias("obx"))
    grouped = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "obx"))).alias("x"))
    joined = orders.where("o_custkey % 7 <> 0").join(grouped, F.col("o_orderkey") == F.col("l_orderkey"))
    files = joined.select(F.concat_ws("\r", _header("ORU", "R01", _text("o_orderkey")), _patient(), _seg("OBR", "1", "p", "f", "s^svc"), F.array_join(F.transform("x", lambda s: s["obx"]), "\r")).alias("file"))
    return hl7.flatten_observations(hl7.route(_parsed(files), "ORU"))


_LABS = f"labs AS (SELECT {PATIENT} AS patient, 'test ' || l_returnflag AS test, {_case('l_linenumber', FLAGS)} AS flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 7 <> 0)"


@query(f"""WITH {_ADT} SELECT CASE event WHEN 'A01' THEN 'Admission' WHEN 'A02' THEN 'Transfer' WHEN 'A03' THEN 'Discharge' WHEN 'A04' THEN 'Registration' WHEN 'A08' THEN 'Update' ELSE event END AS event_name, unit, count(*) AS n
  FROM adt WHERE unit IS NOT NULL AND unit <> '' GROUP BY 1, 2""")
def flow_events_by_unit(orders):
    return flows.events_by_unit(adt(orders))


@query(f"""WITH {_LABS} SELECT test AS test_type, CASE WHEN flag IN ('H', 'HH') THEN 'High' WHEN flag IN ('L', 'LL') THEN 'Low' WHEN flag = 'N' THEN 'Normal' ELSE 'Other' END AS result_status, count(*) AS n
  FROM labs GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 50""")
def flow_tests_by_result(orders, lineitem):
    return flows.tests_by_result(results(orders, lineitem))


@query(f"""SELECT CASE WHEN o_orderkey % 8 <> 0 THEN o_orderpriority ELSE 'Unknown Order' END AS order_type,
  CASE WHEN o_orderkey % 9 = 0 THEN 'Unknown' ELSE CASE {_case('o_orderkey', CONTROLS)} WHEN 'NW' THEN 'New' WHEN 'XO' THEN 'Changed' WHEN 'CA' THEN 'Cancelled' WHEN 'SC' THEN 'Status Changed' ELSE 'RE' END END AS order_status, count(*) AS n
  FROM orders GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 30""")
def flow_orders_by_control(orders):
    """Orders of which some lack the control segment and some the request."""
    control = F.when(F.col("o_orderkey") % 9 != 0, _seg("ORC", _pick("o_orderkey", CONTROLS), _text("o_orderkey")))
    request = F.when(F.col("o_orderkey") % 8 != 0, _seg("OBR", "1", "x", "", F.concat(F.lit("c^"), F.col("o_orderpriority"))))
    files = orders.select(F.concat_ws("\n", _header("ORM", "O01", _text("o_orderkey")), _patient(), control, request).alias("file"))
    return flows.orders_by_control(hl7.route(_parsed(files), "ORM"))


_JOURNEY = f"""WITH {_ADT}, {_LABS}, counted AS (SELECT patient, count(*) AS k FROM labs GROUP BY 1),
  j AS (SELECT CASE a.event WHEN 'A01' THEN 'Emergency' ELSE 'Scheduled' END AS entry_type, coalesce(a.unit, 'Unknown') AS unit, CASE WHEN k > 5 THEN 'High Lab Activity' WHEN k > 0 THEN 'Low Lab Activity' ELSE 'No Labs' END AS lab_activity,
  CASE WHEN EXISTS (SELECT 1 FROM adt d WHERE d.event = 'A03' AND d.patient = a.patient) THEN 'Discharged' ELSE 'In Hospital' END AS outcome, count(DISTINCT a.patient) AS patient_count
  FROM adt a LEFT JOIN counted c ON c.patient = a.patient WHERE a.event IN ('A01', 'A04') GROUP BY 1, 2, 3, 4) """


@query(_JOURNEY + "SELECT * FROM j")
def flow_patient_journey(orders, lineitem):
    return flows.patient_journey(adt(orders), results(orders, lineitem))


@query(_JOURNEY + """SELECT CAST(1 AS INTEGER) AS hop, entry_type AS source, unit AS target, CAST(sum(patient_count) AS BIGINT) AS n FROM j GROUP BY 2, 3 UNION ALL SELECT 2, unit, lab_activity, CAST(sum(patient_count) AS BIGINT) FROM j GROUP BY 2, 3
  UNION ALL SELECT 3, lab_activity, outcome, CAST(sum(patient_count) AS BIGINT) FROM j GROUP BY 2, 3""")
def flow_patient_journey_links(orders, lineitem):
    return flows.journey_links(flow_patient_journey(orders, lineitem), ["entry_type", "unit", "lab_activity", "outcome"])


# Resources. Each maker gives one text a row; bronze and silver are built from them. Rows are dealt to the tasks before
# they become texts, which are many times as wide.

CLASSES = ["AMB", "EMER", "IMP", "OBSENC", "HH", "VR", "FLD", "INVALID"]
ENCOUNTER = ["finished", "in-progress", "planned", "cancelled"]
OBSERVATION = ["final", "preliminary", "registered", "amended"]
CATEGORIES = ["vital-signs", "laboratory", "survey", None]
TESTS = ["Heart rate", "Pulse oximetry", "Systolic pressure", "Body Temperature", "Glucose in blood", "LDL direct", "Hemoglobin A1c", "Creatinine", "Body Weight", "respiratory", "Blood Pressure by Heart probe"]
TEST_CLASSES = ["Heart Rate", "Heart Rate", "Blood Pressure", "Temperature", "Glucose", "Cholesterol", "Hemoglobin", "Kidney Function", "Body Metrics", "Other Tests", "Heart Rate"]
CONDITIONS = ["Diabetes type 2", "Blood Pressure high", "Cardiac arrest", "Asthma", "Hay Fever", "Arthritis", "Anxiety", "Tumor of lung", "Sprain", "Heart failure with Diabetes"]
CONDITION_CLASSES = ["Diabetes", "Hypertension", "Cardiovascular", "Respiratory", "Infectious", "Musculoskeletal", "Mental Health", "Oncology", "Other", "Diabetes"]
CLINICAL = ["active", "resolved", "remission"]
DRUGS = ["Ibuprofen 200", "Lisinopril 10", "Insulin", "Omeprazole", "Amoxicillin", "Albuterol", "Sertraline", "Simvastatin", "Aspirin"]
DRUG_CLASSES = ["Pain Relief", "Cardiovascular", "Diabetes", "Gastrointestinal", "Antibiotics", "Respiratory", "Mental Health", "Cholesterol", "Other"]
PRESCRIBED = ["active", "completed", "stopped", "on-hold"]
IMMUNIZED = ["completed", "entered-in-error", "not-done"]
GENDERS = ["male", "female", "unknown", None]


def _initial(sql: str) -> str:
    return f"upper({sql}[1]) || {sql}[2:]"


def _named(c: Column) -> Column:
    return _cc(c, c)


def encounter_texts(orders: DataFrame) -> DataFrame:
    klass = F.struct(_pick("o_orderkey", CLASSES).alias("code"), F.concat(F.lit("class "), _pick("o_orderkey", CLASSES)).alias("display")).alias("class")
    return spread(orders.select("o_orderkey", "o_custkey", "o_orderpriority")).select(_json("Encounter", _s("o_orderkey"), _meta(), _pick("o_custkey", ENCOUNTER).alias("status"), klass, F.array(_named(F.col("o_orderpriority"))).alias("type"), _ref("Patient", "o_custkey").alias("subject")).alias("value"))


def observation_texts(lineitem: DataFrame) -> DataFrame:
    """Ids by all keys of a line; the subject is the supplier's key."""
    ident = F.concat_ws("-", *[_s(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    category = F.array(_cc(_pick("l_suppkey", CATEGORIES), _pick("l_suppkey", CATEGORIES))).alias("category")
    return spread(lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus")).select(_json("Observation", ident, _meta(), _pick("l_linenumber", OBSERVATION).alias("status"), category, _named(_pick("l_partkey", TESTS)).alias("code"), _ref("Patient", "l_suppkey").alias("subject"), F.col("l_linestatus").alias("valueString")).alias("value"))


def condition_texts(part: DataFrame) -> DataFrame:
    status = _named(_pick("p_partkey", CLINICAL)).alias("clinicalStatus")
    return spread(part.select("p_partkey", "p_brand", "p_size")).select(_json("Condition", _s("p_partkey"), _meta(), status, F.array(_named(F.col("p_brand"))).alias("category"), _named(_pick("p_partkey", CONDITIONS)).alias("code"), _ref("Patient", "p_size").alias("subject")).alias("value"))


def medication_texts(part: DataFrame) -> DataFrame:
    return spread(part.select("p_partkey", "p_size")).select(_json("MedicationRequest", _s("p_partkey"), _meta(), _pick("p_size", PRESCRIBED).alias("status"), F.lit("order").alias("intent"), _named(_pick("p_partkey", DRUGS)).alias("medicationCodeableConcept"), _ref("Patient", "p_size").alias("subject")).alias("value"))


def immunization_texts(customer: DataFrame) -> DataFrame:
    return spread(customer.select("c_custkey", "c_mktsegment", "c_nationkey")).select(_json("Immunization", _s("c_custkey"), _meta(), _pick("c_custkey", IMMUNIZED).alias("status"), _named(F.col("c_mktsegment")).alias("vaccineCode"), _ref("Patient", "c_nationkey").alias("patient"), F.lit("2024-05-06").alias("occurrenceDateTime")).alias("value"))


def patient_texts(customer: DataFrame) -> DataFrame:
    born = F.when(F.col("c_custkey") % 6 != 0, F.concat((F.col("c_custkey") % 40 + 1950).cast("string"), F.lit("-02-03"))).alias("birthDate")
    name = F.array(F.struct(F.col("c_name").alias("family"))).alias("name")
    return spread(customer.select("c_custkey", "c_name")).select(_json("Patient", _s("c_custkey"), _meta(), (F.col("c_custkey") % 3 > 0).alias("active"), _pick("c_custkey", GENDERS).alias("gender"), born, name).alias("value"))


def _silver(texts: DataFrame, name: str) -> DataFrame:
    return fhir.silver(fhir.bronze(texts, dealt=True), name)


_E = f"e AS (SELECT {_case('o_orderkey', CLASSES)} AS class, {_case('o_custkey', ENCOUNTER)} AS status, o_orderpriority AS type, CAST(o_custkey AS VARCHAR) AS subject FROM orders)"
_O = f"o AS (SELECT {_case('l_suppkey', CATEGORIES)} AS category, {_case('l_linenumber', OBSERVATION)} AS status, {_case('l_partkey', TESTS)} AS code, {_case('l_partkey', TEST_CLASSES)} AS class, CAST(l_suppkey AS VARCHAR) AS subject FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem))"
_C = f"c AS (SELECT {_case('p_partkey', CLINICAL)} AS status, {_case('p_partkey', CONDITIONS)} AS code, {_case('p_partkey', CONDITION_CLASSES)} AS class, p_brand AS category, CAST(p_size AS VARCHAR) AS subject FROM part)"
_M = f"m AS (SELECT {_case('p_size', PRESCRIBED)} AS status, {_case('p_partkey', DRUGS)} AS code, {_case('p_partkey', DRUG_CLASSES)} AS class FROM part)"
_I = f"i AS (SELECT {_case('c_custkey', IMMUNIZED)} AS status, c_mktsegment AS code, c_nationkey AS subject FROM customer)"
_P = f"p AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey % 3 > 0 AS active, {_case('c_custkey', GENDERS)} AS gender, CASE WHEN c_custkey % 6 <> 0 THEN 1950 + c_custkey % 40 END AS born, c_name AS name FROM customer)"


@query(f"""WITH {_E} SELECT CASE class WHEN 'AMB' THEN 'Ambulatory' WHEN 'EMER' THEN 'Emergency' WHEN 'IMP' THEN 'Inpatient' WHEN 'OBSENC' THEN 'Observation' WHEN 'HH' THEN 'Home Health' WHEN 'VR' THEN 'Virtual' ELSE class END AS care_setting,
  {_initial('status')} AS encounter_status, count(*) AS n FROM e WHERE class <> 'INVALID' GROUP BY 1, 2""")
def flow_settings_by_status(orders):
    return flows.settings_by_status(_silver(encounter_texts(orders), "encounter"))


@query(f"WITH {_C} SELECT class AS condition_category, {_initial('status')} AS clinical_status, count(*) AS n FROM c GROUP BY 1, 2")
def flow_conditions_by_status(part):
    return flows.conditions_by_status(_silver(condition_texts(part), "condition"))


@query(f"WITH {_M} SELECT class AS drug_class, {_initial('status')} AS rx_status, count(*) AS n FROM m GROUP BY 1, 2")
def flow_drugs_by_status(part):
    return flows.drugs_by_status(_silver(medication_texts(part), "medication_request"))


@query(f"""WITH {_O} SELECT class AS test_type, CASE category WHEN 'vital-signs' THEN 'Vital Signs' WHEN 'laboratory' THEN 'Laboratory' ELSE 'Other' END AS category, {_initial('status')} AS obs_status, count(*) AS n FROM o GROUP BY 1, 2, 3""")
def flow_tests_by_category(lineitem):
    return flows.tests_by_category(_silver(observation_texts(lineitem), "observation"))


@query(f"""WITH {_E}, {_O}, {_C} SELECT CASE e.class WHEN 'AMB' THEN 'Ambulatory' WHEN 'EMER' THEN 'Emergency' WHEN 'IMP' THEN 'Inpatient' WHEN 'OBSENC' THEN 'Observation' ELSE 'Other' END AS care_setting,
  coalesce(ob.kind, 'No Observations') AS observation_type, coalesce(co.kind, 'No Diagnosis') AS diagnosis_outcome, count(DISTINCT e.subject) AS patient_count FROM e
  LEFT JOIN (SELECT DISTINCT subject, CASE category WHEN 'vital-signs' THEN 'Vitals Taken' WHEN 'laboratory' THEN 'Labs Ordered' ELSE 'Other Assessment' END AS kind FROM o WHERE category IS NOT NULL) ob ON ob.subject = e.subject
  LEFT JOIN (SELECT DISTINCT subject, CASE status WHEN 'active' THEN 'Active Diagnosis' WHEN 'resolved' THEN 'Resolved' ELSE 'Under Monitoring' END AS kind FROM c) co ON co.subject = e.subject
  WHERE e.class <> 'INVALID' GROUP BY 1, 2, 3""")
def flow_care_journey(orders, lineitem, part):
    made = (encounter_texts(orders), observation_texts(lineitem), condition_texts(part))
    return flows.care_journey(*[_silver(texts, name) for texts, name in zip(made, ("encounter", "observation", "condition"), strict=True)])


@query("""SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'Unknown Source' WHEN o_orderkey % 4 = 1 THEN '' ELSE o_orderpriority || '.ndjson' END AS source_file, 'Encounter' AS resource_type, CASE WHEN o_orderkey % 11 <> 0 THEN 'Valid' ELSE 'Invalid' END AS validation_status, count(*) AS n FROM orders GROUP BY 1, 3""")
def flow_files_by_validity(orders):
    """Encounters without a class are invalid; files are named, of another kind, or unknown."""
    source = F.when(F.col("o_orderkey") % 4 == 1, "/in/all.json").when(F.col("o_orderkey") % 4 > 1, F.concat(F.lit("/in/"), F.col("o_orderpriority"), F.lit(".ndjson")))
    klass = F.when(F.col("o_orderkey") % 11 != 0, F.struct(F.lit("AMB").alias("code"))).alias("class")
    made = orders.select(source.alias("_source_file"), _json("Encounter", _s("o_orderkey"), F.lit("finished").alias("status"), klass).alias("value"))
    return flows.files_by_validity(fhir.bronze(made))


def tables(orders: DataFrame, lineitem: DataFrame, part: DataFrame, customer: DataFrame) -> dashboard.Tables:
    """All tables of the dashboard. Encounters of every eleventh order come without a status, and so are quarantined too; the
    quarantine is counted in bronze."""
    broken = spread(orders.select("o_orderkey").where("o_orderkey % 11 = 0")).select(_json("Encounter", _s("o_orderkey"), F.struct(F.lit("AMB").alias("code")).alias("class")).alias("value"))
    made = {
        "patient": patient_texts(customer).withColumn("_ingestion_timestamp", F.timestamp_seconds(F.get_json_object("value", "$.id").cast("long") % 100)), "encounter": encounter_texts(orders), "observation": observation_texts(lineitem),
        "condition": condition_texts(part), "medication_request": medication_texts(part), "immunization": immunization_texts(customer),
    }
    every = broken
    for texts in made.values():
        every = every.unionByName(texts.select("value"))
    return {name: _silver(texts, name) for name, texts in made.items()} | {"bronze": fhir.bronze(every, dealt=True)}


_BRONZE = "(SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) + 2 * (SELECT count(*) FROM part) + 2 * (SELECT count(*) FROM customer)"
_BROKEN = "(SELECT count(*) FROM orders WHERE o_orderkey % 11 = 0)"
_TOTALS = {
    "total_patients": "p", "active_patients": "p WHERE active", "total_encounters": "e", "finished_encounters": "e WHERE status = 'finished'", "inprogress_encounters": "e WHERE status = 'in-progress'", "total_observations": "o",
    "final_observations": "o WHERE status = 'final'", "preliminary_observations": "o WHERE status = 'preliminary'", "total_conditions": "c", "active_conditions": "c WHERE status = 'active'", "total_medications": "m",
    "active_medications": "m WHERE status = 'active'", "total_immunizations": "i",
}


@query(f"WITH {_E}, {_O}, {_C}, {_M}, {_I}, {_P} " + " UNION ALL ".join(f"SELECT '{name}' AS dataset, count(*) AS n FROM {source}" for name, source in _TOTALS.items())
       + f" UNION ALL SELECT 'patients_immunized', count(DISTINCT subject) FROM i UNION ALL SELECT 'total_resources', {_BRONZE} + {_BROKEN} UNION ALL SELECT 'valid_resources', {_BRONZE} UNION ALL SELECT 'quarantined', {_BROKEN}")
def dashboard_clinical_totals(orders, lineitem, part, customer):
    """All seventeen single figures."""
    return dashboard.totals(tables(orders, lineitem, part, customer))


def _shown(name: str, sql: str) -> str:
    return f"SELECT '{name}' AS dataset, label, n FROM ({sql})"


def _coded(name: str, source: str, labels: dict[str, str], column: str = "status", other: str | None = None) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items())
    return _shown(name, f"SELECT CASE {column} {arms} ELSE {repr(other) if other else column} END AS label, count(*) AS n FROM {source} GROUP BY {column}")


def _by(name: str, source: str, column: str, limit: int | None = None) -> str:
    end = f" ORDER BY n DESC, label LIMIT {limit}" if limit else ""
    return _shown(name, f"SELECT {column} AS label, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1{end}")


@query(f"WITH {_E}, {_O}, {_C}, {_M}, {_I}, {_P} " + " UNION ALL ".join([
    _coded("patient_gender", "p", dashboard.GENDER, "gender", "Other"), _coded("encounter_status", "e", dashboard.ENCOUNTER), _coded("observation_status", "o", dashboard.OBSERVATION), _coded("medication_status", "m", dashboard.MEDICATION), _coded("immunization_status", "i", dashboard.IMMUNIZATION),
    _by("encounter_class", "e", "'class ' || class"), _by("encounter_types", "e", "type", 10), _by("observation_categories", "o", "category"), _by("observation_codes", "o", "code", 10), _by("condition_categories", "c", "category"), _by("top_conditions", "c", "code", 10), _by("top_medications", "m", "code", 10), _by("vaccine_types", "i", "code"),
]))
def dashboard_clinical_groups(orders, lineitem, part, customer):
    """All thirteen datasets that are counts by one column."""
    return dashboard.groups(tables(orders, lineitem, part, customer))


@query("""SELECT CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN 'Observation' ELSE 'Condition' END AS resource_type, count(*) AS total, CAST(sum(CASE WHEN p_partkey % 4 = 0 OR p_partkey % 8 = 1 OR p_partkey % 12 = 2 THEN 0 ELSE 1 END) AS BIGINT) AS valid,
  CAST(round(sum(CASE WHEN p_partkey % 4 = 0 OR p_partkey % 8 = 1 OR p_partkey % 12 = 2 THEN 0 ELSE 1 END) * 100.0 / count(*), 2) AS DOUBLE) AS success_rate FROM part GROUP BY 1""")
def dashboard_clinical_quality(part):
    k = F.col("p_partkey")
    observed = F.to_json(F.struct(F.lit("Observation").alias("resourceType"), F.lit("final").alias("status"), F.when(k % 8 != 1, _named(F.col("p_name"))).alias("code")))
    condition = F.to_json(F.struct(F.lit("Condition").alias("resourceType"), F.when(k % 12 != 2, _ref("Patient", "p_size")).alias("subject")))
    made = part.select(F.when(k % 4 == 0, "{broken").when(k % 4 == 1, observed).otherwise(condition).alias("value"))
    return dashboard.validation_quality({"bronze": fhir.bronze(made)}).withColumn("success_rate", F.col("success_rate").cast("double"))


@query(f"WITH {_E}, {_P} SELECT 'class ' || class AS encounter_class, gender, count(*) AS n FROM e JOIN p ON e.subject = p.id GROUP BY 1, 2")
def dashboard_clinical_heat_map(orders, customer):
    return dashboard.encounter_patient_heatmap({"encounter": _silver(encounter_texts(orders), "encounter"), "patient": _silver(patient_texts(customer), "patient")})


@query(f"""WITH {_E}, {_O}, {_M}, {_C} SELECT 'Encounter' AS resource_type, status, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'Observation', status, count(*) FROM o GROUP BY 2 UNION ALL SELECT 'Medication', status, count(*) FROM m GROUP BY 2
  UNION ALL SELECT code, status, count(*) FROM c GROUP BY 1, 2""")
def dashboard_clinical_statuses(orders, lineitem, part):
    """Resources by type and status, and conditions by name and status."""
    made = {"encounter": encounter_texts(orders), "observation": observation_texts(lineitem), "medication_request": medication_texts(part), "condition": condition_texts(part)}
    given = {name: _silver(texts, name) for name, texts in made.items()}
    return dashboard.resource_status_heatmap(given).union(dashboard.condition_status_stacked(given))


@query(f"""WITH {_P} SELECT * FROM (SELECT 'recent' AS dataset, id || ' ' || name AS label, born AS n FROM p ORDER BY CAST(id AS BIGINT) % 100 DESC, id LIMIT 10)
  UNION ALL SELECT * FROM (SELECT 'birth_year', CAST(born AS VARCHAR), count(*) FROM p WHERE born IS NOT NULL GROUP BY born ORDER BY born DESC LIMIT 20) UNION ALL SELECT 'active', CASE WHEN active THEN 'Active' ELSE 'Inactive' END, count(*) FROM p GROUP BY 2""")
def dashboard_clinical_patients(customer):
    """The patients ingested last, the latest years of birth, and how many are active."""
    stamped = patient_texts(customer).withColumn("_ingestion_timestamp", F.timestamp_seconds(F.get_json_object("value", "$.id").cast("long") % 100))
    given = {"patient": _silver(stamped, "patient")}
    recent = dashboard.recent_patients(given).select(F.lit("recent").alias("dataset"), F.concat_ws(" ", "id", F.trim("patient_name")).alias("label"), F.year("birth_date").cast("long").alias("n"))
    years = dashboard.patients_by_birth_year(given).select(F.lit("birth_year"), F.col("birth_year").cast("string"), "n")
    return recent.union(years).union(dashboard.active_vs_inactive(given).select(F.lit("active"), "status", "n"))
