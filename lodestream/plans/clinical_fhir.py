"""FHIR queries: resources are made from the driver's tables as JSON, parsed again, and must equal plain joins of these."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.clinical import fhir
from lodestream.operators.once import spread
from lodestream.plans import relational

QUERIES, ORACLES = {}, {}


def query(sql):
    def register(plan):
        names = plan.__code__.co_varnames[: plan.__code__.co_argcount]
        QUERIES[plan.__name__] = lambda spark, sf_dir: plan(*[relational.table(spark, sf_dir, n) for n in names])
        ORACLES[plan.__name__] = sql
        return plan

    return register


def _s(c):
    return F.col(c).cast("string")


def _meta(version="1", day="2024-01-01"):
    return F.struct(F.lit(version).alias("versionId"), F.lit(f"{day}T00:00:00Z").alias("lastUpdated")).alias("meta")


def _cc(code, display):
    return F.struct(F.array(F.struct(F.lit("L").alias("system"), code.alias("code"), display.alias("display"))).alias("coding"))


def _json(kind, ident, *fields):
    return F.to_json(F.struct(F.lit(kind).alias("resourceType"), ident.alias("id"), *fields))


def _ref(kind, c):
    return F.struct(F.concat(F.lit(f"{kind}/"), _s(c)).alias("reference"))


def patients(customer):
    """Two versions of each customer, in one bundle; customers divisible by 7 lack an id and go in silver."""
    ident = F.when(F.col("c_custkey") % 7 != 0, _s("c_custkey"))
    one = lambda v, day, family: _json("Patient", ident, _meta(v, day), F.lit("female").alias("gender"), F.lit("1970-02-03").alias("birthDate"), F.array(F.struct(family.alias("family"), F.array(F.lit("A"), F.lit("B")).alias("given"))).alias("name"), F.array(F.struct(F.lit(fhir.MRN_SYSTEM).alias("system"), F.concat(F.lit("M"), _s("c_custkey")).alias("value"))).alias("identifier"))
    bundle = F.concat(F.lit('{"resourceType":"Bundle","type":"batch","entry":[{"resource":'), one("2", "2024-02-01", F.col("c_name")), F.lit('},{"resource":'), one("1", "2024-01-01", F.lit("old")), F.lit("}]}"))
    return customer.select(bundle.alias("value"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, '2' AS meta_version_id, c_name AS family_name, 'A B' AS given_name, 'A B ' || c_name AS full_name, 'M' || c_custkey AS mrn, true AS active, DATE '1970-02-03' AS birth_date FROM customer WHERE c_custkey % 7 <> 0""")
def fhir_patient(customer):
    return fhir.silver(fhir.bronze(patients(customer)), "patient").select("id", "meta_version_id", "family_name", "given_name", "full_name", "mrn", "active", "birth_date")


def observations(lineitem):
    """One a line; value[x] by line number; lines with status R have a status outside the domain."""
    ident = F.concat_ws("-", *[_s(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.date_format("l_shipdate", "yyyyMMddHHmmss"))
    k = F.col("l_linenumber") % 3
    quantity = F.when(k == 0, F.struct(F.col("l_quantity").cast("int").alias("value"), F.lit("mg").alias("unit"))).alias("valueQuantity")
    text = F.when(k == 1, F.col("l_linestatus")).alias("valueString")
    flag = F.when(k == 2, F.col("l_quantity") > 25).alias("valueBoolean")
    status = F.when(F.col("l_returnflag") == "R", "bad").otherwise("final").alias("status")
    dealt = spread(lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_linestatus", "l_returnflag"))
    return dealt.select(_json("Observation", ident, _meta(), status, _cc(_s("l_partkey"), F.lit("part")).alias("code"), _ref("Patient", "l_suppkey").alias("subject"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("effectiveDateTime"), quantity, text, flag).alias("value"))


@query("""SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d%H%M%S') AS observation_id, CAST(l_suppkey AS VARCHAR) AS patient_id, CAST(l_partkey AS VARCHAR) AS code,
  CASE l_linenumber % 3 WHEN 0 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) WHEN 1 THEN l_linestatus ELSE CASE WHEN l_quantity > 25 THEN 'true' ELSE 'false' END END AS value,
  CASE WHEN l_linenumber % 3 = 0 THEN 'mg' END AS value_unit, date_trunc('second', l_shipdate) AS effective FROM lineitem WHERE l_returnflag <> 'R'""")
def fhir_observation(lineitem):
    gold = fhir.gold_observations(fhir.silver(fhir.bronze(observations(lineitem), dealt=True), "observation"))
    return gold.select("observation_id", "patient_id", "code", "value", "value_unit", F.col("effective_datetime").cast("timestamp_ntz").alias("effective"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'in-progress' END AS status, o_orderpriority AS class_code, CAST(o_custkey AS VARCHAR) AS subject_id, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 11 <> 0""")
def fhir_encounter(orders):
    status = F.when(F.col("o_orderstatus") == "F", "finished").otherwise("in-progress").alias("status")
    klass = F.when(F.col("o_orderkey") % 11 != 0, F.struct(F.col("o_orderpriority").alias("code"))).alias("class")
    made = orders.select(_json("Encounter", _s("o_orderkey"), _meta(), status, klass, _ref("Patient", "o_custkey").alias("subject"), F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("start")).alias("period")).alias("value"))
    return fhir.silver(fhir.bronze(made), "encounter").select("id", "status", "class_code", "subject_id", F.to_date("period_start").alias("day"))


@query("""SELECT CASE WHEN p_partkey % 5 = 0 THEN 'PARSE' WHEN p_partkey % 5 = 1 THEN 'SCHEMA' ELSE 'VALIDATION' END AS kind, count(*) AS n FROM part WHERE p_partkey % 5 < 3 GROUP BY 1""")
def fhir_quarantine(part):
    k = F.col("p_partkey") % 5
    made = part.select(F.when(k == 0, "{bad").when(k == 1, '{"id":"x"}').when(k == 2, '{"resourceType":"Condition","id":"x"}').when(k == 3, '{"resourceType":"Condition","id":"x","subject":{"reference":"Patient/1"}}').otherwise('{"resourceType":"Mystery"}').alias("value"))
    return fhir.quarantine(fhir.bronze(made)).groupBy(fhir.error_class(F.get("validation_errors", F.lit(0))).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_brand AS code, p_type AS display, CAST(p_size AS DOUBLE) AS dose, count(*) AS n FROM part GROUP BY 1, 2, 3""")
def fhir_medication(part):
    dose = F.array(F.struct(F.array(F.struct(F.struct(F.col("p_size").alias("value"), F.lit("mg").alias("unit")).alias("doseQuantity"))).alias("doseAndRate"))).alias("dosageInstruction")
    made = part.select(_json("MedicationRequest", _s("p_partkey"), _meta(), F.lit("active").alias("status"), F.lit("order").alias("intent"), _cc(F.col("p_brand"), F.col("p_type")).alias("medicationCodeableConcept"), _ref("Patient", "p_partkey").alias("subject"), dose).alias("value"))
    return fhir.silver(fhir.bronze(made), "medication_request").groupBy(F.col("medication_code").alias("code"), F.col("medication_display").alias("display"), F.col("dose_value").alias("dose")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS patient_id, s_name AS vaccine_display, '2' AS dose_number, DATE '2024-05-06' AS day FROM supplier""")
def fhir_immunization(supplier):
    made = supplier.select(_json("Immunization", _s("s_suppkey"), _meta(), F.lit("completed").alias("status"), _cc(F.lit("03"), F.col("s_name")).alias("vaccineCode"), _ref("Patient", "s_suppkey").alias("patient"), F.lit("2024-05-06").alias("occurrenceDateTime"), F.array(F.struct(F.lit(2).alias("doseNumberPositiveInt"))).alias("protocolApplied")).alias("value"))
    return fhir.silver(fhir.bronze(made), "immunization").select("patient_id", "vaccine_display", "dose_number", F.to_date("occurrence_datetime").alias("day"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS code_display, CAST(s_nationkey AS VARCHAR) AS subject_id, 'active' AS clinical_status_code, CASE WHEN s_acctbal > 0 THEN DATE '2020-01-02' END AS recorded_date FROM supplier""")
def fhir_condition(supplier):
    recorded = F.when(F.col("s_acctbal") > 0, "2020-01-02").otherwise("not a date").alias("recordedDate")
    made = supplier.select(_json("Condition", _s("s_suppkey"), _meta(), F.struct(F.col("s_name").alias("text")).alias("code"), _cc(F.lit("active"), F.lit("Active")).alias("clinicalStatus"), _ref("Patient", "s_nationkey").alias("subject"), recorded).alias("value"))
    return fhir.silver(fhir.bronze(made), "condition").select("id", "code_display", "subject_id", "clinical_status_code", "recorded_date")


@query("""SELECT date_trunc('hour', o_orderdate) AS window_start, 'Encounter' AS resource_type, o_orderkey % 11 <> 0 AS is_valid, count(*) AS record_count, count(DISTINCT o_custkey) AS unique_resources, count(DISTINCT o_orderpriority) AS source_files
  FROM orders GROUP BY ALL""")
def fhir_hourly_stats(orders):
    """Encounters without a class are invalid; ids are those of customers and files those of priorities, so that both repeat."""
    klass = F.when(F.col("o_orderkey") % 11 != 0, F.struct(F.lit("AMB").alias("code"))).alias("class")
    made = orders.select(F.col("o_orderdate").cast("timestamp").alias("_ingestion_timestamp"), F.col("o_orderpriority").alias("_source_file"), _json("Encounter", _s("o_custkey"), F.lit("finished").alias("status"), klass).alias("value"))
    return fhir.hourly_stats(fhir.bronze(made)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH m AS (SELECT event_type, CAST(floor(epoch(TIMESTAMP '2030-01-01') - epoch(max(ts))) AS BIGINT) // 60 AS minutes FROM events GROUP BY 1)
  SELECT event_type, minutes, CASE WHEN minutes <= 60 THEN 'FRESH' WHEN minutes <= 360 THEN 'STALE' ELSE 'VERY_STALE' END AS freshness FROM m""")
def fhir_freshness(events):
    as_of = F.lit("2030-01-01").cast("timestamp_ntz")
    m = events.groupBy("event_type").agg(F.floor(F.timestamp_diff("SECOND", F.max("ts"), as_of) / 60).alias("minutes"))
    return m.select("event_type", "minutes", fhir.freshness(F.col("minutes")).alias("freshness"))
