"""The richer view of FHIR resources: strict validation, diagnostic reports, lengths of stay, and quarantine records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.clinical import fhir

# Types, required fields and value domains of the strict view, beyond those of the live one.
STRICT_TYPES = [*fhir.KNOWN_TYPES, "CareTeam", "Goal", "Device", "DocumentReference", "Composition", "Coverage", "Claim", "ExplanationOfBenefit"]
STRICT_REQUIRED = {**fhir.REQUIRED, "Procedure": ["status", "subject"], "AllergyIntolerance": ["patient"]}
DOMAINS = {
    ("Patient", "gender"): ["male", "female", "other", "unknown"],
    ("Observation", "status"): fhir.STATUS["observation"],
    ("Encounter", "status"): fhir.STATUS["encounter"],
    ("MedicationRequest", "status"): fhir.STATUS["medication_request"],
    ("MedicationRequest", "intent"): fhir.INTENTS,
    ("Immunization", "status"): fhir.STATUS["immunization"],
    ("DiagnosticReport", "status"): ["registered", "partial", "preliminary", "final", "amended", "corrected", "appended", "cancelled", "entered-in-error", "unknown"],
    ("Bundle", "type"): ["document", "message", "transaction", "transaction-response", "batch", "batch-response", "history", "searchset", "collection"],
}
DATES = {"Patient": ["birthDate"], "Observation": ["effectiveDateTime", "issued"], "MedicationRequest": ["authoredOn"], "Immunization": ["occurrenceDateTime"], "Condition": ["onsetDateTime", "recordedDate"]}
DATE_FORMAT = r"^[0-9]{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12][0-9]|3[01])(T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?)?)?$"

_CC, _REF = "struct<coding:array<struct<system:string,code:string,display:string>>,text:string>", "struct<reference:string,display:string>"
REPORT = f"id string, status string, category array<{_CC}>, code {_CC}, subject {_REF}, encounter {_REF}, effectiveDateTime string, effectivePeriod struct<start:string,end:string>, issued string, performer array<{_REF}>, result array<{_REF}>, conclusion string, presentedForm array<struct<contentType:string,title:string,url:string>>"


def strict_errors(json: Column) -> tuple[Column, Column]:
    """Errors and warnings of the strict view, as arrays of texts. An unknown type and a null id are errors here, a malformed date warns."""

    def read(v: Column, field: str) -> Column:
        return F.try_variant_get(v, f"$.{field}", "string")

    def by_type(kind: Column, checks: dict[str, list[Column]]) -> Column:
        out = F.array().cast("array<string>")
        for t, own in checks.items():
            out = F.when(kind == t, F.array(*own)).otherwise(out)
        return out

    def errors(v: Column) -> Column:
        def of(kind: Column) -> Column:
            checks: dict[str, list[Column]] = {}
            for t, fields in STRICT_REQUIRED.items():
                checks.setdefault(t, []).extend(F.when(fhir._missing(v, f), f"{t}: missing required field {f}") for f in fields)
            for t, (a, b) in fhir.CHOICES.items():
                checks.setdefault(t, []).append(F.when(fhir._missing(v, a) & fhir._missing(v, b), f"{t}: missing {a} or {b}"))
            for (t, f), allowed in DOMAINS.items():
                checks.setdefault(t, []).append(F.when(~read(v, f).isin(allowed), F.concat(F.lit(f"{t}: invalid {f} "), read(v, f))))
            basic = F.when(v.isNull(), "malformed JSON").when(fhir._missing(v, "resourceType"), "missing resourceType").when(~kind.isin(STRICT_TYPES), F.concat(F.lit("unknown type "), kind))
            null_id = F.when(F.to_json(F.try_variant_get(v, "$.id", "variant")) == "null", "id is null")
            return F.array_compact(F.concat(F.array(basic, null_id), by_type(kind, checks)))

        return fhir._bind(read(v, "resourceType"), of)

    def warnings(v: Column) -> Column:
        checks = {t: [F.when(~read(v, f).rlike(DATE_FORMAT), F.concat(F.lit(f"{t}: malformed {f} "), read(v, f))) for f in fields] for t, fields in DATES.items()}
        return fhir._bind(read(v, "resourceType"), lambda kind: F.array_compact(by_type(kind, checks)))

    return fhir._bind(F.try_parse_json(json), errors), fhir._bind(F.try_parse_json(json), warnings)


def validate_strict(rows: DataFrame, raw: str = "raw_resource") -> DataFrame:
    """Add strict_errors and strict_warnings."""
    errors, warnings = strict_errors(F.col(raw))
    return rows.withColumns({"strict_errors": errors, "strict_warnings": warnings})


def bundle_index(lines: DataFrame, value: str = "value") -> DataFrame:
    """Resources of bundles with their place: raw_resource, bundle_id, bundle_type, entry_index (null outside a bundle)."""
    keep = [c for c in lines.columns if c != value]
    unpacked = lines.select(*keep, F.try_parse_json(F.col(value)).alias("_v"), F.posexplode(fhir.bundle_entries(F.col(value))).alias("_at", "raw_resource"))
    inside = F.try_variant_get("_v", "$.resourceType", "string") == "Bundle"
    of_bundle = lambda f: F.when(inside, F.try_variant_get("_v", f"$.{f}", "string"))
    return unpacked.select(*keep, "raw_resource", of_bundle("id").alias("bundle_id"), of_bundle("type").alias("bundle_type"), F.when(inside, F.col("_at")).alias("entry_index"))


def preferred(items: Column, field: str, value: str) -> Column:
    """The first item whose field has that value, else the first item."""
    return F.coalesce(F.get(F.filter(items, lambda x: x[field] == value), F.lit(0)), F.get(items, F.lit(0)))


def people(rows: DataFrame, raw: str = "raw_resource") -> DataFrame:
    """The rich view of patients: official name, home address, identifiers by type code, telephone and mail."""
    schema = "id string, gender string, birthDate string, name array<struct<use:string,family:string,given:array<string>,prefix:array<string>,suffix:array<string>>>, identifier array<struct<system:string,value:string,type:struct<coding:array<struct<code:string>>>>>, address array<struct<use:string,line:array<string>,city:string,state:string,postalCode:string,country:string>>, telecom array<struct<system:string,value:string,use:string>>"
    p = F.col("_p")
    typed = rows.withColumn("_p", F.from_json(raw, schema))
    by_code = lambda code: F.get(F.filter(p["identifier"], lambda i: F.exists(i["type"]["coding"], lambda c: c["code"] == code)), F.lit(0))["value"]
    contact = lambda system: F.get(F.filter(p["telecom"], lambda t: t["system"] == system), F.lit(0))["value"]
    name, home = preferred(p["name"], "use", "official"), preferred(p["address"], "use", "home")
    return typed.select(
        p["id"].alias("id"), p["gender"].alias("gender"), F.try_to_date(p["birthDate"]).alias("birth_date"), by_code("MR").alias("identifier_mrn"), by_code("SS").alias("identifier_ssn"),
        name["family"].alias("name_family"), F.get(name["given"], F.lit(0)).alias("name_given"), F.get(name["prefix"], F.lit(0)).alias("name_prefix"), F.get(name["suffix"], F.lit(0)).alias("name_suffix"),
        F.get(home["line"], F.lit(0)).alias("address_line"), home["city"].alias("address_city"), home["state"].alias("address_state"), home["postalCode"].alias("address_postal_code"), home["country"].alias("address_country"),
        contact("phone").alias("phone"), contact("email").alias("email"),
    )


def diagnostic_reports(rows: DataFrame, raw: str = "raw_resource") -> DataFrame:
    """One row a report, with the ids of its results."""
    p = F.col("_p")
    typed = rows.where("resource_type = 'DiagnosticReport'").withColumn("_p", F.from_json(raw, REPORT))
    first = lambda cc: F.get(cc["coding"], F.lit(0))
    return typed.select(
        p["id"].alias("id"), p["status"].alias("status"), first(F.get(p["category"], F.lit(0)))["code"].alias("category_code"), first(p["code"])["code"].alias("code"), F.coalesce(first(p["code"])["display"], p["code"]["text"]).alias("code_display"),
        fhir.ref_id(p["subject"]).alias("subject_id"), fhir.ref_id(p["encounter"]).alias("encounter_id"), F.try_to_timestamp(F.coalesce(p["effectiveDateTime"], p["effectivePeriod"]["start"])).alias("effective_datetime"), F.try_to_timestamp(p["issued"]).alias("issued"),
        F.transform(p["result"], fhir.ref_id).alias("result_ids"), fhir.ref_id(F.get(p["performer"], F.lit(0))).alias("performer_id"), p["conclusion"].alias("conclusion"), F.to_json(p["presentedForm"]).alias("presented_forms"),
    )


def stay_minutes(encounter: DataFrame) -> DataFrame:
    """Add length_minutes to the silver encounters: whole minutes between start and end."""
    return encounter.withColumn("length_minutes", F.timestamp_diff("MINUTE", F.col("period_start"), F.col("period_end")))


def quarantine_records(rows: DataFrame, errors: str = "validation_errors") -> DataFrame:
    """What goes to the quarantine table: an id that is the same for the same resource, class of its first error, counters of reprocessing."""
    first = F.get(errors, F.lit(0))
    return rows.where(F.size(errors) > 0).select(
        F.concat(F.lit("Q-"), F.substring(F.sha2(F.coalesce("raw_resource", F.lit("")), 256), 1, 24)).alias("quarantine_id"), "raw_resource", fhir.error_class(first).alias("error_type"), F.array_join(errors, "; ").alias("error_message"),
        F.lit(0).alias("reprocess_attempts"), F.lit(None).cast("timestamp").alias("last_reprocess"), F.lit(False).alias("is_resolved"),
    )


def reprocessed(records: DataFrame, at: Column) -> DataFrame:
    """The records after another try: one attempt more, resolved where the resource is valid now."""
    again = ~F.col("is_resolved")
    return fhir.validated(records).select(*records.columns, "is_valid").withColumns({
        "reprocess_attempts": F.col("reprocess_attempts") + again.cast("int"), "last_reprocess": F.when(again, at).otherwise(F.col("last_reprocess")), "is_resolved": F.col("is_resolved") | F.col("is_valid"),
    }).drop("is_valid")
