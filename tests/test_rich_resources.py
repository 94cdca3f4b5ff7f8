"""The rich view of resources, by hand-written documents and rows."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from lodestream.clinical import rich


def frame(spark, kind, *resources):
    return spark.createDataFrame([(kind, r if isinstance(r, str) else json.dumps(r)) for r in resources], "resource_type string, raw_resource string")


def concept(code, display=None, text=None):
    return {"coding": [{"system": "s", "code": code, **({"display": display} if display else {})}], **({"text": text} if text else {})}


def test_observations(spark):
    pressure = {
        "id": "bp", "status": "final", "category": [concept("vital-signs", "Vital Signs")], "code": concept("85354-9", "Blood pressure", "BP"), "subject": {"reference": "Patient/7", "display": "x"}, "encounter": {"reference": "no slash"},
        "effectivePeriod": {"start": "2024-01-02T03:04:05Z", "end": "2024-01-02"}, "issued": "bad", "interpretation": [concept("N", "Normal")], "referenceRange": [{"low": {"value": 90}, "high": {"value": 120.5, "unit": "mm"}, "text": "usual"}],
        "component": [{"code": concept("8480-6", "Systolic"), "valueQuantity": {"value": 120, "unit": "mmHg"}}, {"code": {"text": "note"}, "valueString": "ok"}, {"code": concept("c"), "valueCodeableConcept": concept("v", "shown")}], "performer": [{"reference": "Practitioner/9"}],
    }
    values = [{"valueQuantity": {"value": 5.5, "unit": "mg"}, "valueString": "unused"}, {"valueString": "text"}, {"valueCodeableConcept": concept("c", "Shown")}, {"valueCodeableConcept": concept("c")}, {"valueBoolean": False}, {"valueBoolean": True}, {}]
    rows = rich.observations(frame(spark, "Observation", pressure, *[{"id": f"v{k}", **v} for k, v in enumerate(values)], "{broken", "{}")).collect()
    got = {r["id"]: r for r in rows}
    b = got["bp"]
    assert (b["category_code"], b["category_display"], b["code_code"], b["code_display"], b["code_system"], b["code_text"]) == ("vital-signs", "Vital Signs", "85354-9", "Blood pressure", "s", "BP")
    assert (b["subject_ref"], b["patient_id"], b["encounter_ref"], b["encounter_id"], b["performer_id"]) == ("Patient/7", "7", "no slash", None, "9")
    assert (b["effective_datetime"], b["effective_period_start"], b["effective_period_end"], b["issued"]) == (None, datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2), None)
    assert (b["interpretation_code"], b["interpretation_display"], b["reference_range_low"], b["reference_range_high"], b["reference_range_text"]) == ("N", "Normal", 90.0, 120.5, "usual")
    assert [tuple(c) for c in b["components"]] == [("8480-6", "Systolic", 120.0, "mmHg", None), (None, "note", None, None, "ok"), ("c", None, None, None, "shown")]
    assert [(got[f"v{k}"]["value_quantity"], got[f"v{k}"]["value_unit"], got[f"v{k}"]["value_string"]) for k in range(7)] == [(5.5, "mg", None), (None, None, "text"), (None, None, "Shown"), (None, None, "c"), (None, None, "False"), (None, None, "True"), (None, None, None)]
    assert len(rows) == 10 and rich.observations(frame(spark, "Patient", {"id": "p"})).count() == 0


def test_encounters(spark):
    whole = {
        "id": "e", "status": "finished", "class": {"system": "s", "code": "IMP", "display": "inpatient"}, "type": [concept("t", "Type"), concept("u")], "priority": concept("EM", "emergency"), "subject": {"reference": "Patient/1"}, "period": {"start": "2024-01-01T10:00:00Z", "end": "2024-01-01T11:30:59+00:00"},
        "reasonCode": [concept("r", "Reason")], "hospitalization": {"admitSource": concept("a", "Admit"), "dischargeDisposition": concept("d", "Home")}, "location": [{"location": {"reference": "Location/2", "display": "Ward"}}, {"location": {"reference": "Location/3"}}],
        "participant": [{"type": [concept("ATND")], "individual": {"reference": "Practitioner/4"}}, {"type": [concept("x"), concept("ATND")], "individual": {"reference": "Practitioner/5"}}, {"type": [concept("PPRF")], "individual": {"reference": "Practitioner/6"}}, {}], "serviceProvider": {"reference": "Organization/8"},
    }
    got = {r["id"]: r for r in rich.encounters(frame(spark, "Encounter", whole, {"id": "bare"})).collect()}
    e = got["e"]
    assert (e["class_code"], e["class_display"], e["class_system"], e["type_code"], e["type_display"], e["priority_code"], e["priority_display"]) == ("IMP", "inpatient", "s", "t", "Type", "EM", "emergency")
    assert (e["length_minutes"], e["reason_code_code"], e["reason_code_display"], e["admit_source_code"], e["discharge_disposition_display"]) == (90, "r", "Reason", "a", "Home")
    assert (e["location_ref"], e["location_id"], e["location_display"], e["service_provider_id"], e["patient_id"]) == ("Location/2", "2", "Ward", "8", "1")
    assert (e["attending_practitioner_ref"], e["attending_practitioner_id"]) == ("Practitioner/5", "5") and [tuple(p) for p in e["participants"]] == [("ATND", "4"), ("x", "5"), ("PPRF", "6"), (None, None)]
    assert all(v is None for n, v in got["bare"].asDict().items() if n != "id")


def test_medication_requests(spark):
    whole = {
        "id": "m", "status": "active", "intent": "order", "medicationCodeableConcept": concept("860975", "metformin"), "medicationReference": {"reference": "Medication/9"}, "subject": {"reference": "Patient/1"}, "encounter": {"reference": "Encounter/2"}, "requester": {"reference": "Practitioner/3"}, "authoredOn": "2024-03-04",
        "dosageInstruction": [{"text": "twice a day", "route": concept("PO", "oral"), "doseAndRate": [{"doseQuantity": {"value": 500, "unit": "mg"}}, {"doseQuantity": {"value": 1}}]}, {"text": "as needed"}], "reasonCode": [concept("E11", "diabetes"), concept("x")],
    }
    got = {r["id"]: r for r in rich.medication_requests(frame(spark, "MedicationRequest", whole, {"id": "ref", "medicationReference": {"reference": "Medication/9"}, "dosageInstruction": []}, {"id": "bare"}, "{broken")).collect()}
    m = got["m"]
    assert (m["intent"], m["medication_code"], m["medication_display"], m["medication_system"], m["medication_ref"], m["medication_id"]) == ("order", "860975", "metformin", "s", None, None)
    assert (m["patient_id"], m["encounter_id"], m["requester_id"], m["authored_on"]) == ("1", "2", "3", datetime(2024, 3, 4)) and (m["reason_code"], m["reason_display"]) == ("E11", "diabetes")
    assert (m["dosage_text"], m["dosage_route_code"], m["dosage_route_display"], m["dose_value"], m["dose_unit"]) == ("twice a day", "PO", "oral", 500.0, "mg")
    assert [(d["text"], tuple(d["route"]), d["value"], d["unit"]) for d in m["dosages"]] == [("twice a day", ("PO", "oral"), 500.0, "mg"), ("as needed", (None, None), None, None)]
    assert (got["ref"]["medication_code"], got["ref"]["medication_ref"], got["ref"]["medication_id"], got["ref"]["dosages"]) == (None, "Medication/9", "9", [])
    assert all(v is None for n, v in got["bare"].asDict().items() if n != "id") and len(got) == 4


def test_immunizations(spark):
    whole = {
        "id": "i", "status": "completed", "vaccineCode": {"coding": [{"system": "s", "code": "own", "display": "Own"}, {"system": rich.CVX, "code": "207"}, {"system": rich.CVX, "code": "208"}]}, "patient": {"reference": "Patient/1"}, "encounter": {"reference": "Encounter/2"}, "occurrenceDateTime": "2024-01-02T03:04:05Z",
        "primarySource": True, "location": {"reference": "Location/3"}, "manufacturer": {"display": "Maker"}, "lotNumber": "L1", "expirationDate": "2025-06-07", "site": concept("LA", "left arm"), "route": concept("IM", "muscle"), "doseQuantity": {"value": 0.5, "unit": "mL"},
        "performer": [{"function": concept("AP"), "actor": {"reference": "Practitioner/4"}}, {"actor": {"reference": "Organization/5"}}], "protocolApplied": [{"series": "basic", "doseNumberPositiveInt": 2}, {"series": "next"}],
    }
    empty_code = {"id": "none", "vaccineCode": {"coding": [{"system": "s", "code": "first"}, {"system": rich.CVX}]}, "occurrenceString": "long ago", "expirationDate": "bad"}
    got = {r["id"]: r for r in rich.immunizations(frame(spark, "Immunization", whole, {"id": "first", "vaccineCode": concept("x", "X")}, empty_code, {"id": "bare"})).collect()}
    i = got["i"]
    assert (i["vaccine_code"], i["vaccine_display"], i["vaccine_system"], i["vaccine_cvx_code"], got["first"]["vaccine_cvx_code"], got["none"]["vaccine_cvx_code"]) == ("own", "Own", "s", "207", "x", None)
    assert (i["patient_ref"], i["patient_id"], i["encounter_id"], i["location_id"], i["occurrence_datetime"], i["occurrence_string"]) == ("Patient/1", "1", "2", "3", datetime(2024, 1, 2, 3, 4, 5), None)
    assert (i["primary_source"], i["manufacturer"], i["lot_number"], i["expiration_date"].isoformat(), i["site_code"], i["route_display"], i["dose_quantity"], i["dose_unit"]) == (True, "Maker", "L1", "2025-06-07", "LA", "muscle", 0.5, "mL")
    assert [tuple(x) for x in i["performers"]] == [("AP", "4"), (None, "5")] and (i["dose_number"], i["series"]) == (2, "basic") and [tuple(x) for x in i["protocols"]] == [("basic", 2), ("next", None)]
    assert (got["none"]["occurrence_string"], got["none"]["expiration_date"]) == ("long ago", None) and all(v is None for n, v in got["bare"].asDict().items() if n != "id")


def test_conditions(spark):
    whole = {
        "id": "c", "clinicalStatus": concept("active", "Active"), "verificationStatus": concept("confirmed", "Confirmed"), "category": [concept("problem", "Problem"), concept("visit")], "severity": concept("24484000", "Severe"), "code": concept("44054006", "Diabetes", "DM"), "bodySite": [concept("arm", "Arm"), concept("leg")],
        "subject": {"reference": "Patient/1"}, "encounter": {"reference": "Encounter/2"}, "onsetPeriod": {"start": "2023-02-01"}, "abatementDateTime": "2024-02-01", "recordedDate": "2023-02-02", "recorder": {"reference": "Practitioner/3"}, "asserter": {"reference": "Patient/1"},
        "evidence": [{"code": [concept("e", "Evidence"), concept("f")], "detail": [{"reference": "Observation/7"}, {"reference": "Observation/8"}]}, {}],
    }
    got = {r["id"]: r for r in rich.conditions(frame(spark, "Condition", whole, {"id": "s", "onsetString": "childhood", "abatementString": "adult", "onsetDateTime": "2020"}, {"id": "bare"})).collect()}
    c = got["c"]
    assert (c["clinical_status"], c["clinical_status_display"], c["verification_status"], c["verification_status_display"], c["severity_code"], c["severity_display"]) == ("active", "Active", "confirmed", "Confirmed", "24484000", "Severe")
    assert (c["category_code"], c["category_display"], c["code_code"], c["code_display"], c["code_system"], c["code_text"], c["body_site_code"], c["body_site_display"]) == ("problem", "Problem", "44054006", "Diabetes", "s", "DM", "arm", "Arm")
    assert [tuple(x) for x in c["categories"]] == [("problem", "Problem"), ("visit", None)] and [tuple(x) for x in c["body_sites"]] == [("arm", "Arm"), ("leg", None)]
    assert (c["patient_id"], c["encounter_id"], c["recorder_id"], c["asserter_ref"], c["asserter_id"]) == ("1", "2", "3", "Patient/1", "1")
    assert (c["onset_datetime"], c["onset_period_start"], c["abatement_datetime"], c["recorded_date"]) == (None, datetime(2023, 2, 1), datetime(2024, 2, 1), datetime(2023, 2, 2))
    assert [(tuple(x["code"]), x["details"]) for x in c["evidence"]] == [(("e", "Evidence"), ["Observation/7", "Observation/8"]), ((None, None), None)]
    assert (got["s"]["onset_string"], got["s"]["abatement_string"], got["s"]["onset_datetime"]) == ("childhood", "adult", datetime(2020, 1, 1))
    assert "status" not in c.asDict() and all(v is None for n, v in got["bare"].asDict().items() if n != "id")


def test_bundle_warnings(spark):
    nested = {"resourceType": "Bundle", "type": "batch", "entry": [{"resource": {"resourceType": "Odd"}}]}
    documents = [
        {"resourceType": "Bundle", "type": "batch", "entry": [{"resource": {"resourceType": "Observation", "status": "odd", "code": {"text": "x"}}}, {}, {"resource": None}, {"resource": nested}, {"resource": {"resourceType": "Patient", "gender": "m"}}]},
        {"resourceType": "Bundle", "type": "batch"}, {"resourceType": "Patient", "text": "Bundle"}, {"resourceType": "Bundle", "type": "batch", "entry": [{"resource": {**nested, "type": "strange"}}]},
    ]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(documents)] + [(4, None), (5, "Bundle {broken"), (6, "")], "k int, v string")
    got = {r["k"]: r["w"] for r in df.select("k", rich.bundle_warnings(F.col("v")).alias("w")).collect()}
    assert got == {0: ["Bundle entry[0]: Observation: invalid status odd", "Bundle entry[4]: Patient: invalid gender m"], 1: [], 2: [], 3: ["Bundle entry[0]: Bundle: invalid type strange"], 4: [], 5: [], 6: []}
