"""The rich view of observations, encounters, medication requests, immunizations and conditions as typed columns, and the validation of what bundles hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.clinical import fhir, records
from lodestream.operators.once import with_columns_once

_CC, _REF = "struct<coding:array<struct<system:string,code:string,display:string>>,text:string>", "struct<reference:string,display:string>"
_PERIOD, _QTY = "struct<start:string,end:string>", "struct<value:double,unit:string>"
OBSERVATION = f"id string, status string, category array<{_CC}>, code {_CC}, subject {_REF}, encounter {_REF}, effectiveDateTime string, effectivePeriod {_PERIOD}, issued string, valueQuantity {_QTY}, valueString string, valueCodeableConcept {_CC}, valueBoolean boolean, interpretation array<{_CC}>, referenceRange array<struct<low:{_QTY},high:{_QTY},text:string>>, component array<struct<code:{_CC},valueQuantity:{_QTY},valueString:string,valueCodeableConcept:{_CC}>>, performer array<{_REF}>"
ENCOUNTER = f"id string, status string, class struct<system:string,code:string,display:string>, type array<{_CC}>, priority {_CC}, subject {_REF}, period {_PERIOD}, reasonCode array<{_CC}>, hospitalization struct<admitSource:{_CC},dischargeDisposition:{_CC}>, location array<struct<location:{_REF}>>, participant array<struct<type:array<{_CC}>,individual:{_REF}>>, serviceProvider {_REF}"
MEDICATION_REQUEST = f"id string, status string, intent string, medicationCodeableConcept {_CC}, medicationReference {_REF}, subject {_REF}, encounter {_REF}, requester {_REF}, authoredOn string, dosageInstruction array<struct<text:string,route:{_CC},doseAndRate:array<struct<doseQuantity:{_QTY}>>>>, reasonCode array<{_CC}>"
IMMUNIZATION = f"id string, status string, vaccineCode {_CC}, patient {_REF}, encounter {_REF}, occurrenceDateTime string, occurrenceString string, primarySource boolean, location {_REF}, manufacturer {_REF}, lotNumber string, expirationDate string, site {_CC}, route {_CC}, doseQuantity {_QTY}, performer array<struct<function:{_CC},actor:{_REF}>>, protocolApplied array<struct<series:string,doseNumberPositiveInt:int>>"
CONDITION = f"id string, clinicalStatus {_CC}, verificationStatus {_CC}, category array<{_CC}>, severity {_CC}, code {_CC}, bodySite array<{_CC}>, subject {_REF}, encounter {_REF}, onsetDateTime string, onsetString string, onsetPeriod {_PERIOD}, abatementDateTime string, abatementString string, recordedDate string, recorder {_REF}, asserter {_REF}, evidence array<struct<code:array<{_CC}>,detail:array<{_REF}>>>"
ATTENDING = "ATND"
#: Fixed value: the system of vaccine codes.
CVX = "http://hl7.org/fhir/sid/cvx"


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _coded(concept: Column, name: str, *parts: str) -> dict[str, Column]:
    """The asked parts (code, display, system) of a concept's first coding, or its text."""
    coding = _first(concept["coding"])
    return {f"{name}_{p}": concept["text"] if p == "text" else coding[p] for p in parts}


def _id(reference: Column) -> Column:
    """The id in a reference of the form type/id; null for other forms."""
    return F.get(F.split(reference["reference"], "/"), F.lit(1))


def _referred(reference: Column, name: str, who: str) -> dict[str, Column]:
    return {f"{name}_ref": reference["reference"], f"{who}_id": _id(reference)}


def _short(concept: Column) -> Column:
    """Code and display of a concept's first coding."""
    return F.struct(_first(concept["coding"])["code"].alias("code"), _first(concept["coding"])["display"].alias("display"))


def _typed(rows: DataFrame, kind: str, schema: str, raw: str, columns, head: tuple[str, ...] = ("id", "status")) -> DataFrame:
    parsed = with_columns_once(rows.where(F.col("resource_type") == kind), {"_p": F.from_json(raw, schema)})
    p = F.col("_p")
    return parsed.select(*[c.alias(n) for n, c in {**{h: p[h] for h in head}, **columns(p)}.items()])


def observations(rows: DataFrame, raw: str = "raw_resource") -> DataFrame:
    """One row an observation. Of the kinds of value a quantity goes first, then a text, a concept, a boolean; components are typed."""

    def columns(p: Column) -> dict[str, Column]:
        shown = lambda c: F.coalesce(F.nullif(_first(c["coding"])["display"], F.lit("")), _first(c["coding"])["code"])
        quantity, limits = p["valueQuantity"], _first(p["referenceRange"])
        text = F.coalesce(p["valueString"], shown(p["valueCodeableConcept"]), F.initcap(p["valueBoolean"].cast("string")))
        part = lambda c: F.struct(
            _first(c["code"]["coding"])["code"].alias("code"), F.coalesce(_first(c["code"]["coding"])["display"], c["code"]["text"]).alias("display"), c["valueQuantity"]["value"].alias("value"), c["valueQuantity"]["unit"].alias("unit"),
            F.coalesce(c["valueString"], shown(c["valueCodeableConcept"])).alias("text"),
        )
        return {
            **_coded(_first(p["category"]), "category", "code", "display"), **_coded(p["code"], "code", "code", "display", "system", "text"), **_referred(p["subject"], "subject", "patient"), **_referred(p["encounter"], "encounter", "encounter"),
            "effective_datetime": F.try_to_timestamp(p["effectiveDateTime"]), "effective_period_start": F.try_to_timestamp(p["effectivePeriod"]["start"]), "effective_period_end": F.try_to_timestamp(p["effectivePeriod"]["end"]), "issued": F.try_to_timestamp(p["issued"]),
            "value_quantity": quantity["value"], "value_unit": quantity["unit"], "value_string": F.when(quantity.isNull(), text), **_coded(_first(p["interpretation"]), "interpretation", "code", "display"),
            "reference_range_low": limits["low"]["value"], "reference_range_high": limits["high"]["value"], "reference_range_text": limits["text"], "components": F.transform(p["component"], part), **_referred(_first(p["performer"]), "performer", "performer"),
        }

    return _typed(rows, "Observation", OBSERVATION, raw, columns)


def encounters(rows: DataFrame, raw: str = "raw_resource") -> DataFrame:
    """One row an encounter, with its length in whole minutes, its first place, and the attending participant (the last that is one)."""

    def columns(p: Column) -> dict[str, Column]:
        start, end = F.try_to_timestamp(p["period"]["start"]), F.try_to_timestamp(p["period"]["end"])
        attends = lambda x: F.exists(x["type"], lambda t: _first(t["coding"])["code"] == ATTENDING)
        attending = F.try_element_at(F.filter(p["participant"], attends), F.lit(-1))["individual"]
        place, stay = _first(p["location"])["location"], p["hospitalization"]
        return {
            "class_code": p["class"]["code"], "class_display": p["class"]["display"], "class_system": p["class"]["system"], **_coded(_first(p["type"]), "type", "code", "display"), **_coded(p["priority"], "priority", "code", "display"),
            **_referred(p["subject"], "subject", "patient"), "period_start": start, "period_end": end, "length_minutes": F.timestamp_diff("MINUTE", start, end), **_coded(_first(p["reasonCode"]), "reason_code", "code", "display"),
            **_coded(stay["admitSource"], "admit_source", "code", "display"), **_coded(stay["dischargeDisposition"], "discharge_disposition", "code", "display"), **_referred(place, "location", "location"), "location_display": place["display"],
            "participants": F.transform(p["participant"], lambda x: F.struct(_first(_first(x["type"])["coding"])["code"].alias("role"), _id(x["individual"]).alias("id"))), **_referred(attending, "attending_practitioner", "attending_practitioner"),
            **_referred(p["serviceProvider"], "service_provider", "service_provider"),
        }

    return _typed(rows, "Encounter", ENCOUNTER, raw, columns)


def medication_requests(rows: DataFrame, raw: str = "raw_resource") -> DataFrame:
    """One row a request. The medication is a concept or else a reference; all dosages are typed, the first one also has columns of its own."""

    def columns(p: Column) -> dict[str, Column]:
        quantity = lambda d: _first(d["doseAndRate"])["doseQuantity"]
        dosage = lambda d: F.struct(d["text"].alias("text"), _short(d["route"]).alias("route"), quantity(d)["value"].alias("value"), quantity(d)["unit"].alias("unit"))
        first, concept = _first(p["dosageInstruction"]), p["medicationCodeableConcept"]
        referred = _referred(p["medicationReference"], "medication", "medication")
        return {
            "intent": p["intent"], **_coded(concept, "medication", "code", "display", "system"), **{n: F.when(concept.isNull(), c) for n, c in referred.items()}, **_referred(p["subject"], "subject", "patient"),
            **_referred(p["encounter"], "encounter", "encounter"), **_referred(p["requester"], "requester", "requester"), "authored_on": F.try_to_timestamp(p["authoredOn"]), "dosages": F.transform(p["dosageInstruction"], dosage),
            "dosage_text": first["text"], **_coded(first["route"], "dosage_route", "code", "display"), "dose_value": quantity(first)["value"], "dose_unit": quantity(first)["unit"], **_coded(_first(p["reasonCode"]), "reason", "code", "display"),
        }

    return _typed(rows, "MedicationRequest", MEDICATION_REQUEST, raw, columns)


def immunizations(rows: DataFrame, raw: str = "raw_resource") -> DataFrame:
    """One row an immunization. The CVX code is that of the first coding in this system; without one, of the first coding."""

    def columns(p: Column) -> dict[str, Column]:
        codings, quantity, protocol = p["vaccineCode"]["coding"], p["doseQuantity"], _first(p["protocolApplied"])
        cvx = F.filter(codings, lambda c: c["system"] == CVX)
        return {
            **_coded(p["vaccineCode"], "vaccine", "code", "display", "system"), "vaccine_cvx_code": F.when(F.size(cvx) > 0, _first(cvx)["code"]).otherwise(_first(codings)["code"]), **_referred(p["patient"], "patient", "patient"),
            **_referred(p["encounter"], "encounter", "encounter"), "occurrence_datetime": F.try_to_timestamp(p["occurrenceDateTime"]), "occurrence_string": p["occurrenceString"], "primary_source": p["primarySource"],
            **_referred(p["location"], "location", "location"), "manufacturer": p["manufacturer"]["display"], "lot_number": p["lotNumber"], "expiration_date": F.try_to_timestamp(p["expirationDate"]).cast("date"),
            **_coded(p["site"], "site", "code", "display"), **_coded(p["route"], "route", "code", "display"), "dose_quantity": quantity["value"], "dose_unit": quantity["unit"],
            "performers": F.transform(p["performer"], lambda x: F.struct(_first(x["function"]["coding"])["code"].alias("function"), _id(x["actor"]).alias("id"))), "dose_number": protocol["doseNumberPositiveInt"], "series": protocol["series"],
            "protocols": F.transform(p["protocolApplied"], lambda x: F.struct(x["series"].alias("series"), x["doseNumberPositiveInt"].alias("dose_number"))),
        }

    return _typed(rows, "Immunization", IMMUNIZATION, raw, columns)


def conditions(rows: DataFrame, raw: str = "raw_resource") -> DataFrame:
    """One row a condition, with all categories, body sites and evidence typed; the first category and body site have columns of their own."""

    def columns(p: Column) -> dict[str, Column]:
        clinical, verification = _short(p["clinicalStatus"]), _short(p["verificationStatus"])
        evidence = lambda x: F.struct(_short(_first(x["code"])).alias("code"), F.transform(x["detail"], lambda d: d["reference"]).alias("details"))
        return {
            "clinical_status": clinical["code"], "clinical_status_display": clinical["display"], "verification_status": verification["code"], "verification_status_display": verification["display"],
            **_coded(_first(p["category"]), "category", "code", "display"), "categories": F.transform(p["category"], _short), **_coded(p["severity"], "severity", "code", "display"), **_coded(p["code"], "code", "code", "display", "system", "text"),
            **_coded(_first(p["bodySite"]), "body_site", "code", "display"), "body_sites": F.transform(p["bodySite"], _short), **_referred(p["subject"], "subject", "patient"), **_referred(p["encounter"], "encounter", "encounter"),
            "onset_datetime": F.try_to_timestamp(p["onsetDateTime"]), "onset_string": p["onsetString"], "onset_period_start": F.try_to_timestamp(p["onsetPeriod"]["start"]), "abatement_datetime": F.try_to_timestamp(p["abatementDateTime"]), "abatement_string": p["abatementString"],
            "recorded_date": F.try_to_timestamp(p["recordedDate"]), **_referred(p["recorder"], "recorder", "recorder"), **_referred(p["asserter"], "asserter", "asserter"), "evidence": F.transform(p["evidence"], evidence),
        }

    return _typed(rows, "Condition", CONDITION, raw, columns, head=("id",))


def bundle_warnings(json: Column) -> Column:
    """What is wrong with the resources of a bundle, as texts with the entry's number from 0; none for other resources.

    A bundle inside a bundle is validated as a resource; what is wrong inside it is a warning of its own.
    """

    def of_entry(entry: Column, number: Column) -> Column:
        resource = F.to_json(F.try_variant_get(entry, "$.resource", "variant"))
        errors = fhir._bind(F.when(~resource.isin("null", "{}"), resource), lambda r: F.when(r.isNotNull(), records.strict_errors(r)[0]))
        return F.transform(F.coalesce(errors, F.array().cast("array<string>")), lambda e: F.concat(F.lit("Bundle entry["), number.cast("string"), F.lit("]: "), e))

    def of_bundle(v: Column) -> Column:
        entries = F.try_variant_get(v, "$.entry", "array<variant>")
        return F.when(F.try_variant_get(v, "$.resourceType", "string") == "Bundle", F.flatten(F.transform(entries, of_entry)))

    return F.coalesce(F.when(json.contains("Bundle"), fhir._bind(F.try_parse_json(json), of_bundle)), F.array().cast("array<string>"))
