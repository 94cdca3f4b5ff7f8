"""FHIR R4 resources as columns: bundles, validation, six silver tables, gold views and monitoring.

Validation reads the JSON as a variant, which tells malformed JSON from missing fields; silver tables are projections
of ``from_json`` structs. Nothing here leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.once import explode_present, spread, with_columns_once

# Known types, required fields, alternatives of a choice, and value domains.
KNOWN_TYPES = ["Patient", "Observation", "Encounter", "MedicationRequest", "DiagnosticReport", "Immunization", "Procedure", "Condition", "AllergyIntolerance", "Bundle", "Practitioner", "Organization", "Location", "Medication", "ServiceRequest", "CarePlan"]
REQUIRED = {
    "Observation": ["status", "code"],
    "Encounter": ["status", "class"],
    "MedicationRequest": ["status", "intent", "subject"],
    "Immunization": ["status", "vaccineCode", "patient"],
    "DiagnosticReport": ["status", "code"],
    "Condition": ["subject"],
    "Bundle": ["type"],
}
CHOICES = {"MedicationRequest": ["medicationCodeableConcept", "medicationReference"], "Immunization": ["occurrenceDateTime", "occurrenceString"]}
STATUS = {
    "observation": ["registered", "preliminary", "final", "amended", "corrected", "cancelled", "entered-in-error", "unknown"],
    "encounter": ["planned", "arrived", "triaged", "in-progress", "onleave", "finished", "cancelled", "entered-in-error", "unknown"],
    "medication_request": ["active", "on-hold", "cancelled", "completed", "entered-in-error", "stopped", "draft", "unknown"],
    "immunization": ["completed", "entered-in-error", "not-done"],
}
INTENTS = ["proposal", "plan", "order", "original-order", "reflex-order", "filler-order", "instance-order", "option"]
MRN_SYSTEM, SSN_SYSTEM = "http://hospital.org/mrn", "http://hl7.org/fhir/sid/us-ssn"

_CODING = "array<struct<system:string,code:string,display:string>>"
_CC = f"struct<coding:{_CODING},text:string>"
_REF = "struct<reference:string,display:string>"
_PERIOD = "struct<start:string,end:string>"
_QTY = "struct<value:string,unit:string,code:string>"
_COMMON = "id string, meta struct<versionId:string,lastUpdated:string>"
SCHEMAS = {
    "patient": f"{_COMMON}, active boolean, gender string, birthDate string, deceasedBoolean boolean, deceasedDateTime string, name array<struct<family:string,given:array<string>>>, identifier array<struct<system:string,value:string>>, address array<struct<line:array<string>,city:string,state:string,postalCode:string,country:string>>, telecom array<struct<system:string,value:string,use:string>>, maritalStatus {_CC}",
    "observation": f"{_COMMON}, status string, code {_CC}, category array<{_CC}>, subject {_REF}, encounter {_REF}, effectiveDateTime string, effectivePeriod {_PERIOD}, issued string, valueQuantity {_QTY}, valueString string, valueCodeableConcept {_CC}, valueBoolean boolean, valueInteger int, valueDateTime string, referenceRange array<struct<low:{_QTY},high:{_QTY}>>, interpretation array<{_CC}>, dataAbsentReason {_CC}, component array<struct<code:{_CC},valueQuantity:{_QTY}>>",
    "encounter": f"{_COMMON}, status string, class struct<code:string,display:string>, type array<{_CC}>, subject {_REF}, period {_PERIOD}, hospitalization struct<admitSource:{_CC},dischargeDisposition:{_CC}>, serviceProvider {_REF}, location array<struct<location:{_REF}>>, reasonCode array<{_CC}>",
    "condition": f"{_COMMON}, code {_CC}, category array<{_CC}>, clinicalStatus {_CC}, verificationStatus {_CC}, severity {_CC}, bodySite array<{_CC}>, subject {_REF}, encounter {_REF}, onsetDateTime string, onsetAge {_QTY}, onsetPeriod {_PERIOD}, abatementDateTime string, abatementAge {_QTY}, recordedDate string, recorder {_REF}, asserter {_REF}",
    "medication_request": f"{_COMMON}, status string, intent string, priority string, medicationCodeableConcept {_CC}, medicationReference {_REF}, subject {_REF}, encounter {_REF}, authoredOn string, requester {_REF}, dosageInstruction array<struct<timing:struct<repeat:struct<frequency:int,period:double,periodUnit:string>>,route:{_CC},doseAndRate:array<struct<doseQuantity:{_QTY}>>>>, dispenseRequest struct<quantity:{_QTY},numberOfRepeatsAllowed:int>",
    "immunization": f"{_COMMON}, status string, vaccineCode {_CC}, patient {_REF}, encounter {_REF}, occurrenceDateTime string, occurrenceString string, recorded string, primarySource boolean, lotNumber string, expirationDate string, site {_CC}, route {_CC}, doseQuantity {_QTY}, performer array<struct<actor:{_REF}>>, reasonCode array<{_CC}>, protocolApplied array<struct<doseNumberPositiveInt:int,doseNumberString:string,seriesDosesPositiveInt:int,seriesDosesString:string>>",
}
TYPE_OF = {"patient": "Patient", "observation": "Observation", "encounter": "Encounter", "condition": "Condition", "medication_request": "MedicationRequest", "immunization": "Immunization"}


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body applied to a value that is evaluated once, however often body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bundle_entries(json: Column) -> Column:
    """The resources of a bundle; [] for a blank text; the text itself if it is no bundle or has no usable entry.

    Only texts that mention a bundle are parsed.
    """

    def resources(v: Column) -> Column:
        entries = F.try_variant_get(v, "$.entry", "array<variant>")
        found = F.filter(F.transform(entries, lambda e: F.to_json(F.try_variant_get(e, "$.resource", "variant"))), lambda r: r.isNotNull() & (r != "null"))
        return F.when(F.try_variant_get(v, "$.resourceType", "string") == "Bundle", found)

    def usable(found: Column) -> Column:
        return F.when(F.size(found) > 0, found).otherwise(F.array(json))

    unpacked = _bind(_bind(F.try_parse_json(json), resources), usable)
    return F.when(F.coalesce(F.trim(json), F.lit("")) == "", F.array().cast("array<string>")).when(json.contains("Bundle") | json.contains("\\u00"), unpacked).otherwise(F.array(json))


def _missing(v: Column, name: str) -> Column:
    """Absent, null, or empty in JSON."""
    text = F.to_json(F.try_variant_get(v, f"$.{name}", "variant"))
    return F.coalesce(text.isin("null", '""', "[]", "{}", "false", "0"), F.lit(True))


def validated(rows: DataFrame, raw: str = "raw_resource") -> DataFrame:
    """Add is_valid, resource_type, resource_id, meta_version_id, meta_last_updated, validation_errors and warnings.

    Each text is parsed once, its type is read once, and a type's fields are looked up once, as bits; messages are made of
    the bits only where they are asked for. A filter on the type is applied before the fields are checked.
    """
    v = F.col("_v")

    def checks(kind: str) -> list[tuple[str, Column]]:
        out = [(f"{kind}: missing required field {f}", _missing(v, f)) for f in REQUIRED[kind]]
        if kind in CHOICES:
            a, b = CHOICES[kind]
            out.append((f"{kind}: missing {a} or {b}", _missing(v, a) & _missing(v, b)))
        return out

    def checked(kind: Column) -> Column:
        blank = F.coalesce(F.trim(F.col(raw)), F.lit("")) == ""
        basic = F.when(kind.isin(KNOWN_TYPES), None).when(blank, "empty resource").when(v.isNull(), "malformed JSON").when(_missing(v, "resourceType"), "missing resourceType")
        bits = F
        for t in REQUIRED:
            bits = bits.when(kind == t, reduce(add, [F.when(missing, 1 << i).otherwise(0) for i, (_, missing) in enumerate(checks(t))]))
        return F.struct(kind.alias("resource_type"), basic.alias("_basic"), bits.otherwise(0).alias("_bits"))

    parsed = with_columns_once(rows, {"_v": F.try_parse_json(F.col(raw))})
    found = parsed.select("*", F.inline(F.transform(F.array(F.try_variant_get(v, "$.resourceType", "string")), checked)))
    kind, basic, bits = F.col("resource_type"), F.col("_basic"), F.col("_bits")
    errors = F.when(basic.isNotNull(), F.array(basic))
    for t in REQUIRED:
        errors = errors.when(kind == t, F.array_compact(F.array(*[F.when(bits.bitwiseAND(1 << i) != 0, message) for i, (message, _) in enumerate(checks(t))])))
    return found.select(
        *rows.columns, (basic.isNull() & (bits == 0)).alias("is_valid"), "resource_type", F.try_variant_get(v, "$.id", "string").alias("resource_id"), F.try_variant_get(v, "$.meta.versionId", "string").alias("meta_version_id"),
        F.try_to_timestamp(F.try_variant_get(v, "$.meta.lastUpdated", "string")).alias("meta_last_updated"), errors.otherwise(F.array().cast("array<string>")).alias("validation_errors"), F.array_compact(F.array(F.when(~kind.isin(KNOWN_TYPES), F.concat(F.lit("unknown type "), kind)))).alias("warnings"),
    )


def bronze(lines: DataFrame, value: str = "value", dealt: bool = False) -> DataFrame:
    """One row per resource, valid or not. Other columns, such as the source file, are kept.

    ``dealt`` says that the lines are on enough tasks already, so that their texts need not be shuffled.
    """
    keep = [c for c in lines.columns if c != value]
    return validated(explode_present(lines if dealt else spread(lines), bundle_entries(F.col(value)), "raw_resource", keep))


def quarantine(rows: DataFrame) -> DataFrame:
    return rows.where("not is_valid")


def error_class(message: Column) -> Column:
    """PARSE, SCHEMA, VALIDATION or TRANSFORM by keywords, in this order."""
    m = F.lower(message)
    return F.when(m.contains("json") | m.contains("empty"), "PARSE").when(m.contains("resourcetype") | m.contains("schema"), "SCHEMA").when(m.contains("required") | m.contains("missing"), "VALIDATION").otherwise("TRANSFORM")


# What the silver tables take from a parsed struct p


def ref_id(r: Column) -> Column:
    return F.regexp_extract(r["reference"], "([^/]*)$", 1)


def _code(cc: Column, name: str, system: bool = False) -> dict[str, Column]:
    first = F.get(cc["coding"], F.lit(0))
    out = {f"{name}_code" if name != "code" else "code": first["code"]}
    if system:
        out["code_system" if name == "code" else f"{name}_system"] = first["system"]
    out[f"{name}_display"] = F.coalesce(first["display"], F.when(F.coalesce(F.size(cc["coding"]), F.lit(0)) <= 0, cc["text"]))
    return out


def _ts(c: Column) -> Column:
    return F.try_to_timestamp(c)


def _at(a: Column, i: int = 0) -> Column:
    return F.get(a, F.lit(i))


def _patient(p: Column) -> dict[str, Column]:
    name, address = _at(p["name"]), _at(p["address"])
    by_system = lambda s: F.coalesce(_at(F.filter(p["identifier"], lambda i: i["system"] == s))["value"], _at(p["identifier"])["value"])
    given = F.array_join(name["given"], " ")
    return {
        "active": F.coalesce(p["active"], F.lit(True)), "gender": p["gender"], "birth_date": F.try_to_date(p["birthDate"]), "deceased_boolean": p["deceasedBoolean"], "deceased_datetime": _ts(p["deceasedDateTime"]),
        "family_name": name["family"], "given_name": given, "full_name": F.concat_ws(" ", given, name["family"]), "mrn": by_system(MRN_SYSTEM), "ssn": by_system(SSN_SYSTEM),
        "address_line": F.array_join(address["line"], " "), "address_city": address["city"], "address_state": address["state"], "address_postal_code": address["postalCode"], "address_country": address["country"],
        "marital_status_code": _at(p["maritalStatus"]["coding"])["code"], "names": F.to_json(p["name"]), "identifiers": F.to_json(p["identifier"]), "addresses": F.to_json(p["address"]), "telecoms": F.to_json(p["telecom"]),
    }


def _observation(p: Column) -> dict[str, Column]:
    q, cc = p["valueQuantity"], p["valueCodeableConcept"]
    concept = F.coalesce(_at(cc["coding"])["display"], _at(cc["coding"])["code"], cc["text"])
    kinds = [("Quantity", q["value"]), ("String", p["valueString"]), ("CodeableConcept", concept), ("Boolean", p["valueBoolean"].cast("string")), ("Integer", p["valueInteger"].cast("string")), ("DateTime", p["valueDateTime"])]
    limits = _at(p["referenceRange"])
    return {
        "status": p["status"], **_code(p["code"], "code", system=True), **_code(_at(p["category"]), "category"), "subject_id": ref_id(p["subject"]), "encounter_id": ref_id(p["encounter"]),
        "effective_datetime": _ts(p["effectiveDateTime"]), "effective_period_start": _ts(p["effectivePeriod"]["start"]), "effective_period_end": _ts(p["effectivePeriod"]["end"]), "issued": _ts(p["issued"]),
        "value": F.coalesce(*[v for _, v in kinds]), "value_type": F.coalesce(*[F.when(v.isNotNull(), k) for k, v in kinds]), "value_unit": F.coalesce(q["unit"], q["code"]),
        "reference_range_low": limits["low"]["value"].try_cast("double"), "reference_range_high": limits["high"]["value"].try_cast("double"), "interpretation_code": _at(_at(p["interpretation"])["coding"])["code"],
        "data_absent_reason": _at(p["dataAbsentReason"]["coding"])["code"], "components": F.to_json(p["component"]),
    }


def _encounter(p: Column) -> dict[str, Column]:
    h = p["hospitalization"]
    return {
        "status": p["status"], "class_code": p["class"]["code"], "class_display": p["class"]["display"], **_code(_at(p["type"]), "type"), "subject_id": ref_id(p["subject"]), "period_start": _ts(p["period"]["start"]), "period_end": _ts(p["period"]["end"]),
        **_code(h["admitSource"], "admit_source"), **_code(h["dischargeDisposition"], "discharge_disposition"), "service_provider_id": ref_id(p["serviceProvider"]), "location_id": ref_id(_at(p["location"])["location"]), **_code(_at(p["reasonCode"]), "reason"),
    }


def _condition(p: Column) -> dict[str, Column]:
    one = lambda cc: _at(cc["coding"])["code"]
    return {
        **_code(p["code"], "code", system=True), **_code(_at(p["category"]), "category"), "clinical_status_code": one(p["clinicalStatus"]), "verification_status_code": one(p["verificationStatus"]), **_code(p["severity"], "severity"), **_code(_at(p["bodySite"]), "body_site"),
        "subject_id": ref_id(p["subject"]), "encounter_id": ref_id(p["encounter"]), "onset_datetime": _ts(p["onsetDateTime"]), "onset_age": p["onsetAge"]["value"], "onset_period_start": _ts(p["onsetPeriod"]["start"]),
        "abatement_datetime": _ts(p["abatementDateTime"]), "abatement_age": p["abatementAge"]["value"], "recorded_date": F.try_to_date(F.substring(p["recordedDate"], 1, 10)), "recorder_id": ref_id(p["recorder"]), "asserter_id": ref_id(p["asserter"]),
    }


def _medication_request(p: Column) -> dict[str, Column]:
    dose = _at(p["dosageInstruction"])
    repeat, quantity = dose["timing"]["repeat"], _at(dose["doseAndRate"])["doseQuantity"]
    return {
        "status": p["status"], "intent": p["intent"], "priority": p["priority"], **_code(p["medicationCodeableConcept"], "medication", system=True), "medication_reference_id": ref_id(p["medicationReference"]),
        "subject_id": ref_id(p["subject"]), "encounter_id": ref_id(p["encounter"]), "authored_on": _ts(p["authoredOn"]), "requester_id": ref_id(p["requester"]), "dose_value": quantity["value"].try_cast("double"), "dose_unit": quantity["unit"],
        "frequency": repeat["frequency"], "period": repeat["period"], "period_unit": repeat["periodUnit"], **_code(dose["route"], "route"), "dispense_quantity_value": p["dispenseRequest"]["quantity"]["value"].try_cast("double"),
        "dispense_quantity_unit": p["dispenseRequest"]["quantity"]["unit"], "number_of_repeats": p["dispenseRequest"]["numberOfRepeatsAllowed"],
    }


def _immunization(p: Column) -> dict[str, Column]:
    protocol = _at(p["protocolApplied"])
    either = lambda n: F.coalesce(protocol[f"{n}PositiveInt"].cast("string"), protocol[f"{n}String"])
    return {
        "status": p["status"], **_code(p["vaccineCode"], "vaccine", system=True), "patient_id": ref_id(p["patient"]), "encounter_id": ref_id(p["encounter"]), "occurrence_datetime": _ts(p["occurrenceDateTime"]), "occurrence_string": p["occurrenceString"],
        "recorded": _ts(p["recorded"]), "primary_source": p["primarySource"], "lot_number": p["lotNumber"], "expiration_date": F.try_to_date(p["expirationDate"]), **_code(p["site"], "site"), **_code(p["route"], "route"),
        "dose_value": p["doseQuantity"]["value"].try_cast("double"), "dose_unit": p["doseQuantity"]["unit"], "performer_id": ref_id(_at(p["performer"])["actor"]), **_code(_at(p["reasonCode"]), "reason"), "dose_number": either("doseNumber"), "series_doses": either("seriesDoses"),
    }


EXTRACT = {"patient": _patient, "observation": _observation, "encounter": _encounter, "condition": _condition, "medication_request": _medication_request, "immunization": _immunization}


def silver(rows: DataFrame, name: str) -> DataFrame:
    """The latest version of each resource of one type. Ties go to the higher version id, then to the greater hash of the text,
    so that the text itself is shuffled only where it is asked for. The ingestion time is kept where bronze has it."""
    p = F.col("_p")
    kept = [c for c in rows.columns if c == "_ingestion_timestamp"]
    typed = with_columns_once(rows.where(F.col("is_valid") & (F.col("resource_type") == TYPE_OF[name])).select(*kept, "raw_resource"), {"_p": F.from_json("raw_resource", SCHEMAS[name])})
    out = typed.select(*kept, p["id"].alias("id"), p["meta"]["versionId"].alias("meta_version_id"), _ts(p["meta"]["lastUpdated"]).alias("meta_last_updated"), *[c.alias(n) for n, c in EXTRACT[name](p).items()], "raw_resource", F.xxhash64("raw_resource").alias("_h"))
    keep = F.coalesce(F.col("id"), F.lit("")) != ""
    if name in STATUS:
        keep &= F.col("status").isin(STATUS[name])
    if name == "medication_request":
        keep &= F.col("intent").isin(INTENTS)
    latest = Window.partitionBy("id").orderBy(F.desc_nulls_last("meta_last_updated"), F.desc_nulls_last("meta_version_id"), F.desc("_h"))
    return out.where(F.coalesce(keep, F.lit(False))).withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r", "_h")


def gold_demographics(patient: DataFrame) -> DataFrame:
    return patient.where("active").select(F.col("id").alias("patient_id"), "gender", F.year("birth_date").alias("birth_year"), "address_state", "address_postal_code", "marital_status_code", F.col("meta_last_updated").alias("last_updated"))


def gold_observations(observation: DataFrame) -> DataFrame:
    final = observation.where(F.col("status").isin("final", "amended", "corrected"))
    return final.select(F.col("id").alias("observation_id"), F.col("subject_id").alias("patient_id"), "encounter_id", "code", "code_display", "category_code", "value", "value_unit", "effective_datetime", "interpretation_code")


def hourly_stats(rows: DataFrame, time: str = "_ingestion_timestamp", source: str = "_source_file") -> DataFrame:
    """Resources by hour, type and validity: how many, how many distinct ids, and of how many files."""
    by = rows.groupBy(F.window(time, "1 hour").alias("w"), "resource_type", "is_valid")
    counted = by.agg(F.count(F.lit(1)).alias("record_count"), F.countDistinct("resource_id").alias("unique_resources"), F.countDistinct(source).alias("source_files"))
    return counted.select(F.col("w.start").alias("window_start"), "resource_type", "is_valid", "record_count", "unique_resources", "source_files")


def freshness(minutes: Column) -> Column:
    return F.when(minutes <= 60, "FRESH").when(minutes <= 360, "STALE").otherwise("VERY_STALE")
