"""HL7v2 messages as columns. A field that its segment doesn't reach is the empty text; an absent segment gives nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.once import explode_present, with_columns_once

# For each segment, field index -> {column: component index, or None for the whole field}. In MSH the
# index counts from the segment's name, so it is one less than HL7's field number.
MSH = {
    2: {"sending_application": None}, 3: {"sending_facility": None}, 4: {"receiving_application": None}, 5: {"receiving_facility": None}, 6: {"message_datetime": None},
    8: {"message_type": 0, "trigger_event": 1}, 9: {"message_control_id": None}, 10: {"processing_id": None}, 11: {"version_id": None},
}
PID = {
    3: {"patient_id": 0, "patient_id_assigning_authority": 3, "patient_id_type": 4},
    5: {"patient_name_family": 0, "patient_name_given": 1, "patient_name_middle": 2, "patient_name_suffix": 3, "patient_name_prefix": 4},
    7: {"date_of_birth": None}, 8: {"gender": None},
    11: {"patient_address_street": 0, "patient_address_city": 2, "patient_address_state": 3, "patient_address_zip": 4, "patient_address_country": 5},
}
EVN = {1: {"event_type_code": None}, 2: {"event_datetime": None}, 4: {"event_reason_code": None}}
PV1 = {
    2: {"patient_class": None},
    3: {"assigned_location": None, "location_unit": 0, "location_room": 1, "location_bed": 2, "location_facility": 3, "location_building": 6, "location_floor": 7},
    4: {"admission_type": None}, 5: {"preadmit_number": None},
    6: {"prior_location_unit": 0, "prior_location_room": 1, "prior_location_bed": 2},
    7: {"attending_doctor_id": 0, "attending_doctor_family": 1, "attending_doctor_given": 2},
    8: {"referring_doctor_id": 0, "referring_doctor_family": 1, "referring_doctor_given": 2},
    10: {"hospital_service": None}, 14: {"admit_source": None}, 18: {"patient_type": None}, 19: {"visit_number": None},
    36: {"discharge_disposition": None}, 44: {"admit_datetime": None}, 45: {"discharge_datetime": None},
}
ORC = {
    1: {"order_control": None}, 2: {"order_id": None}, 3: {"filler_order_number": None}, 5: {"order_status": None}, 9: {"order_datetime": None},
    12: {"ordering_provider_id": 0, "ordering_provider_family": 1, "ordering_provider_given": 2},
}
OBR = {
    2: {"placer_order_number": None}, 4: {"universal_service_id": None, "service_code": 0, "service_text": 1, "service_coding_system": 2},
    7: {"observation_datetime": None}, 14: {"specimen_received_datetime": None}, 25: {"result_status": None},
}
OBX = {
    1: {"set_id": None}, 2: {"value_type": None}, 3: {"observation_id": None, "observation_code": 0, "observation_text": 1, "observation_coding_system": 2},
    5: {"observation_value": None}, 6: {"units": None, "units_code": 0, "units_text": 1}, 7: {"reference_range": None}, 8: {"abnormal_flags": None},
    11: {"observation_result_status": None}, 14: {"observation_datetime": None},
}
SCH = {
    1: {"placer_appointment_id": None}, 2: {"filler_appointment_id": None}, 7: {"appointment_reason": None, "appointment_reason_code": 0, "appointment_reason_text": 1},
    8: {"appointment_type": None, "appointment_type_code": 0, "appointment_type_text": 1}, 9: {"appointment_duration": None}, 10: {"appointment_duration_units": None},
    11: {"appointment_start_datetime": 3, "appointment_end_datetime": 4}, 25: {"filler_status_code": None},
}
RESOURCES = {
    "AIS": ("service", {1: {"set_id": None}, 3: {"service_code": 0, "service_text": 1}, 4: {"start_datetime": None}, 7: {"duration": None}, 10: {"filler_status_code": None}}),
    "AIP": ("personnel", {1: {"set_id": None}, 3: {"personnel_id": 0, "personnel_family": 1, "personnel_given": 2}, 4: {"resource_role": None}, 6: {"start_datetime": None}, 8: {"duration": None}}),
    "AIL": ("location", {1: {"set_id": None}, 3: {"location_unit": 0, "location_room": 1, "location_bed": 2, "location_facility": 3}, 4: {"location_type": None}, 6: {"start_datetime": None}, 8: {"duration": None}}),
}
VACCINE_ORC = {1: {"order_control": None}, 2: {"placer_order_number": None}, 3: {"filler_order_number": None}}
RXA = {
    3: {"administration_start_datetime": None}, 4: {"administration_end_datetime": None}, 5: {"vaccine_code": 0, "vaccine_name": 1, "vaccine_coding_system": 2}, 6: {"administered_amount": None},
    7: {"administered_units": None}, 15: {"lot_number": None}, 16: {"expiration_date": None}, 17: {"manufacturer_code": 0, "manufacturer_name": 1}, 20: {"completion_status": None}, 21: {"action_code": None},
}
RXR = {1: {"route_code": 0, "route_name": 1}, 2: {"site_code": 0, "site_name": 1}}
RAW_CHARS = 500

# Columns of the routed tables after the message header.
_HEADER = ["message_control_id", "message_type", "trigger_event", "sending_application", "sending_facility", "message_datetime", "patient_id", "patient_id_assigning_authority", "patient_name_family", "patient_name_given"]


def _names(*specs: dict) -> list[str]:
    return [n for spec in specs for field in spec.values() for n in field]


TABLES = {
    "ADT": ["message_control_id", "message_type", "trigger_event", *[n for n in _names(MSH) if n not in _HEADER[:3]], *_names(PID, EVN, PV1)],
    "ORM": [*_HEADER, *_names(ORC, OBR)],
    "ORU": [*_HEADER, "date_of_birth", "gender", "placer_order_number", "filler_order_number", *_names({k: OBR[k] for k in (4, 7, 25)}), "observations"],
    "SIU": [*_HEADER, *_names(SCH), "resources"],
    "VXU": [*_HEADER, "date_of_birth", "gender", "vaccinations", "observations"],
}


def split_batch(text: Column) -> Column:
    """The messages of a file: array of texts of trimmed, non-empty lines joined by a line feed; lines before the first
    MSH are a message of their own."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n"), lambda x: F.trim(x, F.lit(" \t\v\f"))), lambda x: x != "")
    return F.filter(F.split(F.array_join(lines, "\n"), "\n(?=MSH)"), lambda m: m != "")


def parse_segment(fields: Column, spec: dict) -> dict[str, Column]:
    """Columns of one segment, given as the array of its fields; null where the segment is null."""
    out = {}
    for index, columns in spec.items():
        whole = F.coalesce(F.get(fields, F.lit(index)), F.lit(""))
        for name, component in columns.items():
            value = whole if component is None else F.coalesce(F.get(F.split(whole, r"\^"), F.lit(component)), F.lit(""))
            out[name] = F.when(fields.isNotNull(), value)
    return out


def _struct(segment: Column, spec: dict, **more: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in {**more, **parse_segment(segment, spec)}.items()])


def _is(fields: Column, name: str) -> Column:
    return F.get(fields, F.lit(0)).startswith(name)


def _segments(name: str, source: str = "_segments") -> Column:
    return F.filter(F.col(source), lambda s: _is(s, name))


def _resource(s: Column) -> Column:
    names = list(dict.fromkeys(n for _, spec in RESOURCES.values() for n in _names(spec)))
    parsed = {seg: parse_segment(s, spec) for seg, (_, spec) in RESOURCES.items()}
    pick = lambda f: F.coalesce(*[F.when(_is(s, seg), f(seg)) for seg in RESOURCES])
    null = F.lit(None).cast("string")
    return F.struct(pick(lambda seg: F.lit(RESOURCES[seg][0])).alias("resource_type"), *[pick(lambda seg, n=n: parsed[seg].get(n, null)).alias(n) for n in names])


def _vaccinations() -> Column:
    """ORC opens a record, RXA fills the open one (or opens one), a second RXA replaces the first, RXR needs an open one."""
    kind = "array<struct<orc:array<string>,rxa:array<string>,rxr:array<string>>>"
    null = F.lit(None).cast("array<string>")
    record = lambda orc, rxa, rxr: F.array(F.struct(orc.alias("orc"), rxa.alias("rxa"), rxr.alias("rxr")))

    def step(acc: Column, s: Column) -> Column:
        last, head = F.try_element_at(acc, F.lit(-1)), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return (
            F.when(_is(s, "ORC"), F.concat(acc, record(s, null, null)))
            .when(_is(s, "RXA"), F.concat(head, record(last["orc"], s, last["rxr"])))
            .when(_is(s, "RXR") & (F.size(acc) > 0), F.concat(head, record(last["orc"], last["rxa"], s)))
            .otherwise(acc)
        )

    folded = F.aggregate("_segments", F.array().cast(kind), step)
    return F.transform(folded, lambda r: F.struct(*[c.alias(n) for seg, spec in (("orc", VACCINE_ORC), ("rxa", RXA), ("rxr", RXR)) for n, c in parse_segment(r[seg], spec).items()]))


def parse(messages: DataFrame, message: str = "message") -> DataFrame:
    """Add every parse column to rows with one message each. A message that doesn't begin with MSH gets a parse error."""
    m = F.col(message)
    valid = F.coalesce(F.ltrim(m).startswith("MSH"), F.lit(False))
    out = with_columns_once(messages, {"_segments": F.when(valid, F.transform(F.split(m, "\n"), lambda s: F.split(s, r"\|")))})
    first = lambda name: F.get(_segments(name), F.lit(0))
    last = lambda name: F.try_element_at(_segments(name), F.lit(-1))
    out = out.withColumns({f"_{n}": c for n, c in {"MSH": first("MSH"), "PID": first("PID"), "EVN": last("EVN"), "PV1": last("PV1"), "ORC": last("ORC"), "OBR": last("OBR"), "SCH": last("SCH")}.items()})
    columns: dict[str, Column] = {}
    for name, spec in (("MSH", MSH), ("PID", PID), ("EVN", EVN), ("PV1", PV1), ("ORC", ORC), ("OBR", OBR), ("SCH", SCH)):
        columns |= parse_segment(F.col(f"_{name}"), spec)
    result_filler = F.coalesce(F.get("_OBR", F.lit(3)), F.lit(""))
    columns["filler_order_number"] = F.when((columns["message_type"] == "ORU") & F.col("_OBR").isNotNull(), result_filler).otherwise(columns["filler_order_number"])
    columns["observations"] = F.transform(_segments("OBX"), lambda s: _struct(s, OBX))
    columns["resources"] = F.transform(F.filter("_segments", lambda s: F.substring(F.get(s, F.lit(0)), 1, 3).isin(list(RESOURCES))), _resource)
    columns["vaccinations"] = F.when(columns["message_type"] == "VXU", _vaccinations())
    columns["_raw_message"] = F.substring(m, 1, RAW_CHARS)
    columns["_parse_error"] = F.when(~valid, "message does not begin with MSH")
    return out.select(*messages.columns, *[c.alias(n) for n, c in columns.items()])


def quarantined(parsed: DataFrame) -> DataFrame:
    """Messages without control id or type, or with a parse error."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return parsed.where(blank("message_control_id") | blank("message_type") | F.col("_parse_error").isNotNull())


def route(parsed: DataFrame, kind: str) -> DataFrame:
    """The table of one message type."""
    ok = (F.col("message_type") == kind) & F.col("_parse_error").isNull() & (F.coalesce("message_control_id", F.lit("")) != "")
    return parsed.where(ok).select(*TABLES[kind])


def flatten_observations(oru: DataFrame) -> DataFrame:
    keys = ["message_control_id", "message_datetime", "patient_id", "patient_name_family", "patient_name_given", "placer_order_number", "filler_order_number", "service_code", "service_text"]
    return explode_present(oru, F.col("observations"), "o", keys).select(*keys, "o.*")


def flatten_resources(siu: DataFrame) -> DataFrame:
    keys = ["message_control_id", "message_datetime", "patient_id", "patient_name_family", "patient_name_given", "placer_appointment_id", "filler_appointment_id"]
    flat = explode_present(siu, F.col("resources"), "r", keys).select(*keys, "r.*")
    return flat.withColumnsRenamed({"start_datetime": "resource_start_datetime", "duration": "resource_duration", "filler_status_code": "resource_filler_status"})


def flatten_vaccinations(vxu: DataFrame) -> DataFrame:
    keys = ["message_control_id", "message_datetime", "patient_id", "patient_name_family", "patient_name_given", "date_of_birth", "gender"]
    flat = explode_present(vxu, F.col("vaccinations"), "v", keys).select(*keys, "v.*").drop("order_control", "placer_order_number", "filler_order_number", "administration_end_datetime")
    return flat.withColumnsRenamed({"administration_start_datetime": "administration_datetime", "vaccine_code": "cvx_code", "vaccine_coding_system": "coding_system", "administered_amount": "dose_amount", "administered_units": "dose_units", "manufacturer_code": "mvx_code"})
