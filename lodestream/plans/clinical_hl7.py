"""HL7v2 queries: messages are made from the driver's tables, parsed again, and must equal plain joins of these."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.clinical import hl7
from lodestream.operators.once import explode_present
from lodestream.plans import relational

QUERIES, ORACLES = {}, {}


def query(sql):
    def register(plan):
        names = plan.__code__.co_varnames[: plan.__code__.co_argcount]
        QUERIES[plan.__name__] = lambda spark, sf_dir: plan(*[relational.table(spark, sf_dir, n) for n in names])
        ORACLES[plan.__name__] = sql
        return plan

    return register


def _seg(*fields):
    return F.concat_ws("|", *[f if not isinstance(f, str) else F.lit(f) for f in fields])


def _text(c):
    return F.col(c).cast("string")


def _header(kind, event, control):
    return _seg("MSH", "^~\\&", "APP", "FAC", "RAPP", "RFAC", "20240101", "", f"{kind}^{event}", control, "P", "2.5")


def _pid():
    return _seg("PID", "1", "", F.concat(_text("c_custkey"), F.lit("^^^HOSP^MR")), "", F.concat(F.lit("Fam"), _text("c_custkey"), F.lit("^"), F.col("c_mktsegment")), "", "19700101", "F")


def oru_messages(orders, lineitem, customer):
    """One message an order, one OBX a line; orders divisible by 97 have no MSH."""
    lines = lineitem.select("l_orderkey", "l_linenumber", _seg("OBX", _text("l_linenumber"), "NM", F.concat(_text("l_partkey"), F.lit("^part^L")), "", F.col("l_quantity").cast("long").cast("string"), "u", "1-9", F.col("l_returnflag"), "", "", "F").alias("obx"))
    grouped = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "obx"))).alias("x"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(grouped, F.col("o_orderkey") == F.col("l_orderkey"))
    msh = F.when(F.col("o_orderkey") % 97 != 0, F.concat(_header("ORU", "R01", _text("o_orderkey")), F.lit("\r")))
    obr = _seg("OBR", "1", F.concat(F.lit("P"), _text("o_orderkey")), F.concat(F.lit("F"), _text("o_orderkey")), F.concat(F.col("o_orderpriority"), F.lit("^svc^L")), "", "", "20240102")
    body = F.concat(_pid(), F.lit("\r"), obr, F.lit("\r\n"), F.array_join(F.transform("x", lambda s: s["obx"]), "\r"))
    return joined.select(F.concat(F.coalesce(msh, F.lit("")), body).alias("file"))


def _parsed(files):
    return hl7.parse(explode_present(files, hl7.split_batch(F.col("file")), "message", []))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS message_control_id, CAST(c_custkey AS VARCHAR) AS patient_id, c_mktsegment AS patient_name_given, 'F' || o_orderkey AS filler_order_number, o_orderpriority AS service_code,
  CAST(l_linenumber AS VARCHAR) AS set_id, CAST(l_partkey AS VARCHAR) AS observation_code, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS observation_value, l_returnflag AS abnormal_flags, '' AS observation_datetime
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 97 <> 0""")
def hl7_oru_observations(orders, lineitem, customer):
    flat = hl7.flatten_observations(hl7.route(_parsed(oru_messages(orders, lineitem, customer)), "ORU"))
    return flat.select("message_control_id", "patient_id", "patient_name_given", "filler_order_number", "service_code", "set_id", "observation_code", "observation_value", "abnormal_flags", "observation_datetime")


@query("SELECT count(*) AS n FROM orders WHERE o_orderkey % 97 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def hl7_quarantine(orders, lineitem, customer):
    return hl7.quarantined(_parsed(oru_messages(orders, lineitem, customer))).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS patient_id, 'A01' AS trigger_event, CAST(c_nationkey AS VARCHAR) AS location_unit, '' AS location_floor, c_mktsegment AS attending_doctor_family, CASE WHEN c_custkey % 2 = 0 THEN 'A01' END AS event_type_code FROM customer""")
def hl7_adt(customer):
    pv1 = _seg("PV1", "1", "I", F.concat(_text("c_nationkey"), F.lit("^r^b^f")), "E", "", "", F.concat(F.lit("7^"), F.col("c_mktsegment"), F.lit("^G")))
    evn = F.when(F.col("c_custkey") % 2 == 0, _seg("EVN", "A01", "20240101"))
    files = customer.select(F.concat_ws("\n", _header("ADT", "A01", _text("c_custkey")), evn, _pid(), pv1).alias("file"))
    return hl7.route(_parsed(files), "ADT").select("patient_id", "trigger_event", "location_unit", "location_floor", "attending_doctor_family", "event_type_code")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderstatus AS order_status, o_orderpriority AS service_code, CAST(o_custkey AS VARCHAR) AS patient_id FROM orders JOIN customer ON o_custkey = c_custkey""")
def hl7_orm(orders, customer):
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    orc = _seg("ORC", "NW", _text("o_orderkey"), "", "", F.col("o_orderstatus"))
    obr = _seg("OBR", "1", "x", "", F.concat(F.col("o_orderpriority"), F.lit("^t^L")))
    files = joined.select(F.concat_ws("\r\n", _header("ORM", "O01", _text("o_orderkey")), _pid(), orc, obr).alias("file"))
    return hl7.route(_parsed(files), "ORM").select("order_id", "order_status", "service_code", "patient_id")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS placer_appointment_id, t.kind AS resource_type, CASE WHEN t.kind = 'service' THEN c_mktsegment END AS service_code, CASE WHEN t.kind = 'location' THEN CAST(c_nationkey AS VARCHAR) END AS location_unit
  FROM customer, (VALUES ('service'), ('location')) t(kind) WHERE c_custkey % 2 = 0 OR t.kind = 'service'""")
def hl7_siu_resources(customer):
    ais = _seg("AIS", "1", "A", F.concat(F.col("c_mktsegment"), F.lit("^s")), "20240101")
    ail = F.when(F.col("c_custkey") % 2 == 0, _seg("AIL", "2", "A", F.concat(_text("c_nationkey"), F.lit("^r^b^f"))))
    files = customer.select(F.concat_ws("\r", _header("SIU", "S12", _text("c_custkey")), _seg("SCH", _text("c_custkey"), "f"), _pid(), ais, ail).alias("file"))
    return hl7.flatten_resources(hl7.route(_parsed(files), "SIU")).select("placer_appointment_id", "resource_type", "service_code", "location_unit")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS patient_id, t.cvx AS cvx_code, t.route AS route_code FROM customer, (VALUES ('03', 'IM'), ('08', NULL)) t(cvx, route)""")
def hl7_vxu_vaccinations(customer):
    body = ["ORC|RE|1", "RXA|0|1|20240101|20240101|99^old", "RXA|0|1|20240101|20240101|03^MMR^CVX|0.5|mL", "RXR|IM^x|LA", "ORC|RE|2", "RXA|0|1|20240101|20240101|08^HepB^CVX"]
    files = customer.select(F.concat_ws("\r", _header("VXU", "V04", _text("c_custkey")), _pid(), *map(F.lit, body)).alias("file"))
    return hl7.flatten_vaccinations(hl7.route(_parsed(files), "VXU")).select("patient_id", "cvx_code", "route_code")
