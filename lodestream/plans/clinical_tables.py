"""Queries for the strict resource view, bundles, reports, quarantine records and written message tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.clinical import fhir, records, rich
from lodestream.plans import relational
from lodestream.plans.clinical_fhir import _cc, _json, _meta, _ref, _s, patients

QUERIES, ORACLES = {}, {}


def query(sql):
    def register(plan):
        names = plan.__code__.co_varnames[: plan.__code__.co_argcount]
        QUERIES[plan.__name__] = lambda spark, sf_dir: plan(*[relational.table(spark, sf_dir, n) for n in names])
        ORACLES[plan.__name__] = sql
        return plan

    return register


@query("""SELECT CASE p_partkey % 5 WHEN 0 THEN 'Observation: invalid status odd' WHEN 1 THEN 'unknown type Mystery' WHEN 2 THEN 'id is null' WHEN 3 THEN 'Observation: missing required field code' ELSE 'none' END AS error, p_partkey % 2 = 0 AND p_partkey % 5 IN (0, 2, 3, 4) AS date_warning, count(*) AS n FROM part GROUP BY 1, 2""")
def fhir_strict_validation(part):
    k = F.col("p_partkey") % 5
    when = F.when(F.col("p_partkey") % 2 == 0, "last year").otherwise("2024-02").alias("effectiveDateTime")
    body = F.to_json(F.struct(F.when(k == 1, "Mystery").otherwise("Observation").alias("resourceType"), F.when(k == 0, "odd").otherwise("final").alias("status"), F.when(k != 3, _cc(_s("p_partkey"), F.col("p_name"))).alias("code"), when))
    made = part.select(F.when(k == 2, F.regexp_replace(body, r"^\{", '{"id":null,')).otherwise(body).alias("raw_resource"))
    checked = records.validate_strict(made)
    return checked.groupBy(F.coalesce(F.get("strict_errors", F.lit(0)), F.lit("none")).alias("error"), (F.size("strict_warnings") > 0).alias("date_warning")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'batch' AS bundle_type, CAST(entry AS INTEGER) AS entry_index, count(*) AS n FROM customer, (VALUES (0), (1)) t(entry) GROUP BY 1, 2")
def fhir_bundle_index(customer):
    return records.bundle_index(patients(customer)).groupBy("bundle_type", "entry_index").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS code, CAST(o_custkey AS VARCHAR) AS subject_id, 'r' || o_orderkey AS second_result, CAST(o_orderdate AS DATE) AS day FROM orders""")
def fhir_diagnostic_report(orders):
    results = F.array(F.struct(F.lit("Observation/x").alias("reference")), F.struct(F.concat(F.lit("Observation/r"), _s("o_orderkey")).alias("reference"))).alias("result")
    made = orders.select(_json("DiagnosticReport", _s("o_orderkey"), _meta(), F.lit("final").alias("status"), _cc(F.col("o_orderpriority"), F.lit("d")).alias("code"), _ref("Patient", "o_custkey").alias("subject"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("effectiveDateTime"), results).alias("value"))
    report = records.diagnostic_reports(fhir.bronze(made).where("is_valid"))
    return report.select("id", "code", "subject_id", F.get("result_ids", F.lit(1)).alias("second_result"), F.to_date("effective_datetime").alias("day"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, 'MR' || c_custkey AS identifier_mrn, c_name AS name_family, 'A' AS name_given, 'home ' || c_nationkey AS address_city, c_mktsegment AS email FROM customer")
def fhir_people(customer):
    """Official names and home addresses win over the first ones; identifiers are found by type code."""
    name = F.array(F.struct(F.lit("usual").alias("use"), F.lit("x").alias("family"), F.array(F.lit("y")).alias("given")), F.struct(F.lit("official").alias("use"), F.col("c_name").alias("family"), F.array(F.lit("A"), F.lit("B")).alias("given")))
    address = F.array(F.struct(F.lit("work").alias("use"), F.lit("w").alias("city")), F.struct(F.lit("home").alias("use"), F.concat(F.lit("home "), _s("c_nationkey")).alias("city")))
    identifier = lambda code: F.struct(F.concat(F.lit(code), _s("c_custkey")).alias("value"), F.struct(F.array(F.struct(F.lit(code).alias("code"))).alias("coding")).alias("type"))
    telecom = F.array(F.struct(F.lit("phone").alias("system"), F.lit("1").alias("value")), F.struct(F.lit("email").alias("system"), F.col("c_mktsegment").alias("value")))
    made = customer.select(_json("Patient", _s("c_custkey"), name.alias("name"), address.alias("address"), F.array(identifier("SS"), identifier("MR")).alias("identifier"), telecom.alias("telecom")).alias("raw_resource"))
    return records.people(made).select("id", "identifier_mrn", "name_family", "name_given", "address_city", "email")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderkey % 500 AS BIGINT) AS length_minutes FROM orders""")
def fhir_encounter_length(orders):
    start = F.date_trunc("day", "o_orderdate")
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    end = start + F.make_dt_interval(mins=(F.col("o_orderkey") % 500).cast("int"))
    period = F.struct(stamp(start).alias("start"), stamp(end).alias("end")).alias("period")
    made = orders.select(_json("Encounter", _s("o_orderkey"), _meta(), F.lit("finished").alias("status"), F.struct(F.lit("AMB").alias("code")).alias("class"), period).alias("value"))
    return records.stay_minutes(fhir.silver(fhir.bronze(made), "encounter")).select("id", "length_minutes")


@query("""SELECT CASE WHEN p_partkey % 3 = 0 THEN 'PARSE' ELSE 'SCHEMA' END AS error_type, CAST(1 AS INTEGER) AS attempts, false AS is_resolved, count(*) AS n FROM part WHERE p_partkey % 3 < 2 GROUP BY 1""")
def fhir_quarantine_records(part):
    k = F.col("p_partkey") % 3
    made = part.select(F.when(k == 0, F.concat(F.lit("{bad"), _s("p_partkey"))).when(k == 1, F.concat(F.lit('{"id":"'), _s("p_partkey"), F.lit('"}'))).otherwise('{"resourceType":"Device"}').alias("value"))
    kept = records.quarantine_records(fhir.bronze(made)).dropDuplicates(["quarantine_id"])
    again = records.reprocessed(kept, F.lit("2024-01-01").cast("timestamp"))
    return again.groupBy("error_type", F.col("reprocess_attempts").alias("attempts"), "is_resolved").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey || '-' || l_linenumber AS id, 'final' AS status, 'vital' AS category_code, l_returnflag AS code_code, 'flag ' || l_returnflag AS code_display, 'L' AS code_system, CAST(NULL AS VARCHAR) AS code_text, 'Patient/' || l_suppkey AS subject_ref,
  CAST(l_suppkey AS VARCHAR) AS patient_id, CAST(l_orderkey AS VARCHAR) AS encounter_id, date_trunc('day', l_shipdate) AS effective, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity END AS value_quantity, CASE WHEN l_linenumber % 3 = 0 THEN 'mg' END AS value_unit,
  CASE l_linenumber % 3 WHEN 1 THEN l_linestatus WHEN 2 THEN CASE WHEN l_quantity > 25 THEN 'True' ELSE 'False' END END AS value_string, 'H' AS interpretation_code, l_discount AS reference_range_low, l_tax AS reference_range_high, l_quantity AS systolic, CAST(l_partkey AS VARCHAR) AS performer_id FROM lineitem""")
def fhir_rich_observation(lineitem):
    """Values of three kinds, a component, a range and an interpretation."""
    k, line = F.col("l_linenumber") % 3, F.concat(_s("l_orderkey"), F.lit("-"), _s("l_linenumber"))
    quantity = lambda c: F.struct(F.col(c).alias("value"), F.lit("mg").alias("unit"))
    made = lineitem.select(
        _json(
            "Observation", line, F.lit("final").alias("status"), F.array(_cc(F.lit("vital"), F.lit("Vital"))).alias("category"), _cc(F.col("l_returnflag"), F.concat(F.lit("flag "), F.col("l_returnflag"))).alias("code"),
            _ref("Patient", "l_suppkey").alias("subject"), _ref("Encounter", "l_orderkey").alias("encounter"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("effectiveDateTime"), F.when(k == 0, quantity("l_quantity")).alias("valueQuantity"),
            F.when(k == 1, F.col("l_linestatus")).alias("valueString"), F.when(k == 2, F.col("l_quantity") > 25).alias("valueBoolean"), F.array(_cc(F.lit("H"), F.lit("High"))).alias("interpretation"),
            F.array(F.struct(quantity("l_discount").alias("low"), quantity("l_tax").alias("high"))).alias("referenceRange"), F.array(F.struct(_cc(F.lit("8480-6"), F.lit("Systolic")).alias("code"), quantity("l_quantity").alias("valueQuantity"))).alias("component"),
            F.array(_ref("Practitioner", "l_partkey")).alias("performer"),
        ).alias("raw_resource"),
        F.lit("Observation").alias("resource_type"),
    )
    names = "id status category_code code_code code_display code_system code_text subject_ref patient_id encounter_id value_quantity value_unit value_string interpretation_code reference_range_low reference_range_high performer_id".split()
    rich_rows = rich.observations(made)
    return rich_rows.select(*names, F.col("effective_datetime").cast("timestamp_ntz").alias("effective"), F.get("components", F.lit(0))["value"].alias("systolic"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, 'finished' AS status, 'AMB' AS class_code, 'A' AS class_system, o_orderpriority AS type_display, 'P' || o_orderstatus AS priority_code, CAST(o_custkey AS VARCHAR) AS patient_id, CAST(o_orderkey % 500 AS BIGINT) AS length_minutes, 'r' AS reason_code_code,
  'emd' AS admit_source_code, 'home' AS discharge_disposition_code, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END AS location_id, 'Practitioner/' || o_orderkey AS attending_practitioner_ref, CAST(o_orderkey AS VARCHAR) AS attending_practitioner_id, CAST(2 AS INTEGER) AS n_participants, '1' AS service_provider_id FROM orders""")
def fhir_rich_encounter(orders):
    """Encounters with two participants, of whom the second attends."""
    start = F.date_trunc("day", "o_orderdate")
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    period = F.struct(stamp(start).alias("start"), stamp(start + F.make_dt_interval(mins=(F.col("o_orderkey") % 500).cast("int"))).alias("end"))
    person = lambda role, c: F.struct(F.array(_cc(F.lit(role), F.lit(role))).alias("type"), _ref("Practitioner", c).alias("individual"))
    made = orders.select(
        _json(
            "Encounter", _s("o_orderkey"), F.lit("finished").alias("status"), F.struct(F.lit("A").alias("system"), F.lit("AMB").alias("code")).alias("class"), F.array(_cc(F.lit("t"), F.col("o_orderpriority"))).alias("type"), _cc(F.concat(F.lit("P"), F.col("o_orderstatus")), F.lit("p")).alias("priority"),
            _ref("Patient", "o_custkey").alias("subject"), period.alias("period"), F.array(_cc(F.lit("r"), F.lit("Reason"))).alias("reasonCode"), F.struct(_cc(F.lit("emd"), F.lit("e")).alias("admitSource"), _cc(F.lit("home"), F.lit("h")).alias("dischargeDisposition")).alias("hospitalization"),
            F.when(F.col("o_orderkey") % 2 == 0, F.array(F.struct(_ref("Location", "o_custkey").alias("location")))).alias("location"), F.array(person("PPRF", "o_custkey"), person("ATND", "o_orderkey")).alias("participant"), F.struct(F.lit("Organization/1").alias("reference")).alias("serviceProvider"),
        ).alias("raw_resource"),
        F.lit("Encounter").alias("resource_type"),
    )
    names = "id status class_code class_system type_display priority_code patient_id length_minutes reason_code_code admit_source_code discharge_disposition_code location_id attending_practitioner_ref attending_practitioner_id service_provider_id".split()
    return rich.encounters(made).select(*names, F.size("participants").alias("n_participants"))


@query("""SELECT l_orderkey || '-' || l_linenumber AS id, 'active' AS status, 'order' AS intent, CASE WHEN l_linenumber % 2 = 0 THEN 'm' || l_suppkey END AS medication_code, CASE WHEN l_linenumber % 2 = 0 THEN 'L' END AS medication_system, CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_partkey AS VARCHAR) END AS medication_id,
  CAST(l_suppkey AS VARCHAR) AS patient_id, 'Encounter/' || l_orderkey AS encounter_ref, CAST(l_partkey AS VARCHAR) AS requester_id, date_trunc('day', l_shipdate) AS authored, 'take ' || l_linenumber AS dosage_text, 'r' || l_linestatus AS dosage_route_code, l_quantity AS dose_value, 'mg' AS dose_unit,
  CAST(2 AS INTEGER) AS n_dosages, l_tax AS second_dose, l_returnflag AS reason_code FROM lineitem""")
def fhir_rich_medication_request(lineitem):
    """Medications as concepts and as references, with two dosages."""
    even, line = F.col("l_linenumber") % 2 == 0, F.concat(_s("l_orderkey"), F.lit("-"), _s("l_linenumber"))
    dosage = lambda text, dose: F.struct(text.alias("text"), _cc(F.concat(F.lit("r"), F.col("l_linestatus")), F.lit("route")).alias("route"), F.array(F.struct(F.struct(F.col(dose).alias("value"), F.lit("mg").alias("unit")).alias("doseQuantity"))).alias("doseAndRate"))
    made = lineitem.select(
        _json(
            "MedicationRequest", line, F.lit("active").alias("status"), F.lit("order").alias("intent"), F.when(even, _cc(F.concat(F.lit("m"), _s("l_suppkey")), F.lit("drug"))).alias("medicationCodeableConcept"), F.when(~even, _ref("Medication", "l_partkey")).alias("medicationReference"),
            _ref("Patient", "l_suppkey").alias("subject"), _ref("Encounter", "l_orderkey").alias("encounter"), _ref("Practitioner", "l_partkey").alias("requester"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("authoredOn"),
            F.array(dosage(F.concat(F.lit("take "), _s("l_linenumber")), "l_quantity"), dosage(F.lit("then"), "l_tax")).alias("dosageInstruction"), F.array(_cc(F.col("l_returnflag"), F.lit("flag"))).alias("reasonCode"),
        ).alias("raw_resource"),
        F.lit("MedicationRequest").alias("resource_type"),
    )
    names = "id status intent medication_code medication_system medication_id patient_id encounter_ref requester_id dosage_text dosage_route_code dose_value dose_unit reason_code".split()
    return rich.medication_requests(made).select(*names, F.col("authored_on").cast("timestamp_ntz").alias("authored"), F.size("dosages").alias("n_dosages"), F.get("dosages", F.lit(1))["value"].alias("second_dose"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, 'completed' AS status, 'own' || o_orderstatus AS vaccine_code, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'own' || o_orderstatus END AS vaccine_cvx_code, CAST(o_custkey AS VARCHAR) AS patient_id, CASE WHEN o_orderkey % 3 > 0 THEN date_trunc('day', o_orderdate) END AS occurrence,
  CASE WHEN o_orderkey % 3 = 0 THEN 'long ago' END AS occurrence_string, o_orderkey % 5 = 0 AS primary_source, 'maker ' || o_custkey AS manufacturer, 'lot' || o_custkey AS lot_number, CAST(o_orderdate AS DATE) AS expiration_date, 'LA' AS site_code, 'IM' AS route_code, o_totalprice AS dose_quantity, 'mL' AS dose_unit,
  CAST(o_orderkey AS VARCHAR) AS performer_id, CAST(o_orderkey % 4 + 1 AS INTEGER) AS dose_number, 'first' AS series FROM orders""")
def fhir_rich_immunization(orders):
    """Vaccines with and without a CVX coding behind the first coding, at a known time or at none."""
    k = F.col("o_orderkey")
    own = F.struct(F.lit("own").alias("system"), F.concat(F.lit("own"), F.col("o_orderstatus")).alias("code"))
    codings = F.when(k % 2 == 0, F.array(own, F.struct(F.lit(rich.CVX).alias("system"), F.col("o_orderpriority").alias("code")))).otherwise(F.array(own))
    made = orders.select(
        _json(
            "Immunization", _s("o_orderkey"), F.lit("completed").alias("status"), F.struct(codings.alias("coding")).alias("vaccineCode"), _ref("Patient", "o_custkey").alias("patient"), F.when(k % 3 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("occurrenceDateTime"),
            F.when(k % 3 == 0, F.lit("long ago")).alias("occurrenceString"), (k % 5 == 0).alias("primarySource"), F.struct(F.concat(F.lit("maker "), _s("o_custkey")).alias("display")).alias("manufacturer"), F.concat(F.lit("lot"), _s("o_custkey")).alias("lotNumber"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("expirationDate"), _cc(F.lit("LA"), F.lit("left arm")).alias("site"), _cc(F.lit("IM"), F.lit("intramuscular")).alias("route"), F.struct(F.col("o_totalprice").alias("value"), F.lit("mL").alias("unit")).alias("doseQuantity"),
            F.array(F.struct(_ref("Practitioner", "o_orderkey").alias("actor"))).alias("performer"), F.array(F.struct(F.lit("first").alias("series"), (k % 4 + 1).alias("doseNumberPositiveInt"))).alias("protocolApplied"),
        ).alias("raw_resource"),
        F.lit("Immunization").alias("resource_type"),
    )
    names = "id status vaccine_code vaccine_cvx_code patient_id occurrence_string primary_source manufacturer lot_number expiration_date site_code route_code dose_quantity dose_unit dose_number series".split()
    return rich.immunizations(made).select(*names, F.col("occurrence_datetime").cast("timestamp_ntz").alias("occurrence"), F.get("performers", F.lit(0))["id"].alias("performer_id"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'resolved' END AS clinical_status, 'confirmed' AS verification_status, 'problem' AS category_code, CAST(2 AS INTEGER) AS n_categories, o_orderpriority AS severity_display, 'c' || o_custkey % 50 AS code_code, 'L' AS code_system,
  CASE WHEN o_orderkey % 2 = 0 THEN 'arm' END AS body_site_code, CAST(o_custkey AS VARCHAR) AS patient_id, CASE WHEN o_orderkey % 3 = 0 THEN date_trunc('day', o_orderdate) END AS onset, CASE WHEN o_orderkey % 3 = 1 THEN 'childhood' END AS onset_string, CASE WHEN o_orderkey % 3 = 2 THEN date_trunc('day', o_orderdate) END AS period_start,
  date_trunc('day', o_orderdate) AS recorded, CAST(o_orderkey AS VARCHAR) AS recorder_id, 'Patient/' || o_custkey AS asserter_ref, 'e' || o_orderstatus AS evidence_code, 'Observation/' || o_orderkey AS evidence_detail FROM orders""")
def fhir_rich_condition(orders):
    """Onsets of three forms, two categories, a body site in every second one, and evidence."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    made = orders.select(
        _json(
            "Condition", _s("o_orderkey"), _cc(F.when(F.col("o_orderstatus") == "O", "active").otherwise("resolved"), F.lit("shown")).alias("clinicalStatus"), _cc(F.lit("confirmed"), F.lit("Confirmed")).alias("verificationStatus"),
            F.array(_cc(F.lit("problem"), F.lit("Problem")), _cc(F.lit("visit"), F.lit("Visit"))).alias("category"), _cc(F.lit("s"), F.col("o_orderpriority")).alias("severity"), _cc(F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")), F.lit("code")).alias("code"),
            F.when(k % 2 == 0, F.array(_cc(F.lit("arm"), F.lit("Arm")))).alias("bodySite"), _ref("Patient", "o_custkey").alias("subject"), F.when(k % 3 == 0, day).alias("onsetDateTime"), F.when(k % 3 == 1, F.lit("childhood")).alias("onsetString"), F.when(k % 3 == 2, F.struct(day.alias("start"))).alias("onsetPeriod"),
            day.alias("recordedDate"), _ref("Practitioner", "o_orderkey").alias("recorder"), _ref("Patient", "o_custkey").alias("asserter"), F.array(F.struct(F.array(_cc(F.concat(F.lit("e"), F.col("o_orderstatus")), F.lit("Evidence"))).alias("code"), F.array(_ref("Observation", "o_orderkey")).alias("detail"))).alias("evidence"),
        ).alias("raw_resource"),
        F.lit("Condition").alias("resource_type"),
    )
    names = "id clinical_status verification_status category_code severity_display code_code code_system body_site_code patient_id onset_string recorder_id asserter_ref".split()
    times = {"onset": "onset_datetime", "period_start": "onset_period_start", "recorded": "recorded_date"}
    evidence = F.get("evidence", F.lit(0))
    return rich.conditions(made).select(*names, *[F.col(c).cast("timestamp_ntz").alias(n) for n, c in times.items()], F.size("categories").alias("n_categories"), evidence["code"]["code"].alias("evidence_code"), F.get(evidence["details"], F.lit(0)).alias("evidence_detail"))


@query("""SELECT CASE WHEN p_partkey % 3 = 0 THEN 'Bundle entry[1]: Observation: missing required field code' WHEN p_partkey % 3 = 1 THEN 'Bundle entry[0]: unknown type Mystery' ELSE 'none' END AS warning, count(*) AS n FROM part GROUP BY 1""")
def fhir_bundle_warnings(part):
    """Bundles of two resources, one of which may be invalid."""
    k = F.col("p_partkey") % 3
    first = F.struct(F.when(k == 1, "Mystery").otherwise("Organization").alias("resourceType"), _s("p_partkey").alias("id"))
    second = F.struct(F.lit("Observation").alias("resourceType"), F.lit("final").alias("status"), F.when(k != 0, F.struct(F.col("p_name").alias("text"))).alias("code"))
    made = part.select(F.concat(F.lit('{"resourceType":"Bundle","type":"batch","entry":[{"resource":'), F.to_json(first), F.lit('},{"resource":'), F.to_json(second), F.lit("}]}")).alias("value"))
    return made.select(F.coalesce(F.get(rich.bundle_warnings(F.col("value")), F.lit(0)), F.lit("none")).alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("n"))
