"""Queries that run streams and writes: stream-stream joins with restarts, upserts by bucket, observed expectations, registered schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import observed, schema_registry
from lodestream.operators.expectations import Expectations
from lodestream.plans import relational
from lodestream.sources import bucketed, tables
from lodestream.sources.shared import new_folder
from lodestream.streaming import alerts, joins

QUERIES, ORACLES = {}, {}
WITHIN = "2 hours"


def query(sql):
    def register(plan):
        names = plan.__code__.co_varnames[: plan.__code__.co_argcount]
        QUERIES[plan.__name__] = lambda spark, sf_dir: plan(*[relational.table(spark, sf_dir, n) for n in names])
        ORACLES[plan.__name__] = sql
        return plan

    return register


def _views_and_clicks(events):
    side = lambda kind, n: events.where(F.col("event_type") == kind).select(F.col("event_id").alias(f"{kind}_id"), F.col("user_id").alias(f"u{n}"), F.col("ts").alias(f"t{n}"))
    return side("view", 1), side("click", 2)


def _pairs(how):
    return f"SELECT v.event_id AS view_id, c.event_id AS click_id FROM events v {how} JOIN events c ON v.user_id = c.user_id AND c.event_type = 'click' AND c.ts >= v.ts AND c.ts <= v.ts + INTERVAL 2 HOUR WHERE v.event_type = 'view'"


@query(_pairs("INNER"))
def stream_interval_join(events):
    """Views and clicks as two streams, restarted three times; state is bounded by watermarks on both sides."""
    return joins.replayed_join(*_views_and_clicks(events), ("u1", "u2"), ("t1", "t2"), WITHIN).select("view_id", "click_id")


@query(_pairs("LEFT"))
def stream_interval_left_join(events):
    """As before, with the views that no click follows: given out when the watermark has passed their interval."""
    return joins.replayed_join(*_views_and_clicks(events), ("u1", "u2"), ("t1", "t2"), WITHIN, "left_outer").select("view_id", "click_id")


@query("SELECT o_orderkey, o_custkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def stream_unbounded_join(orders, lineitem):
    """Orders and their lines as two streams without a bound in time: the state keeps both sides."""
    left, right = orders.select("o_orderkey", "o_custkey", "o_orderdate"), lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    return joins.replayed_join(left, right, ("o_orderkey", "l_orderkey"), ("o_orderdate", "l_shipdate"), parts=2).select("o_orderkey", "o_custkey", "l_linenumber", "l_quantity")


@query("SELECT user_id, count(*) AS n, max(value) AS most FROM events GROUP BY user_id")
def stream_bucketed_upsert(events):
    """Running counts of a stream, merged batch by batch into a table of hash buckets, with a restart after each part."""
    spark, folder = events.sparkSession, new_folder(events.sparkSession, "bucketed-counts")
    cuts = joins.time_cuts([(events, "ts")], 3)
    for number in range(len(cuts) + 1):
        joins.part_of(events, "ts", cuts, number).write.mode("append").parquet(f"{folder}/events")
        arrived = spark.readStream.schema(events.schema).parquet(f"{folder}/events")
        counts = arrived.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))
        bucketed.upsert_stream(counts, f"{folder}/table", "user_id", f"{folder}/checkpoint", buckets=16).awaitTermination()
    return bucketed.read(spark, f"{folder}/table")


@query("""SELECT 0 AS version, c_custkey, 'old' AS state FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT 1, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0
  UNION ALL SELECT 2, c_custkey, 'old' FROM customer WHERE c_custkey % 2 = 0""")
def table_versions(customer):
    """A table before and after an upsert, read by version, and restored to what it was."""
    spark, path = customer.sparkSession, new_folder(customer.sparkSession, "versions")
    rows = lambda by, state: customer.where(F.col("c_custkey") % by == 0).select("c_custkey", F.lit(state).alias("state"))
    bucketed.upsert(rows(2, "old"), path, "c_custkey", buckets=8)
    bucketed.upsert(rows(3, "new"), path, "c_custkey")
    bucketed.restore(spark, path, 0)
    read = [bucketed.read(spark, path, n).select(F.lit(n).alias("version"), "c_custkey", "state") for n in range(3)]
    return read[0].unionAll(read[1]).unionAll(read[2])


RULES = Expectations(warn={"positive": "c_acctbal > 0"}, drop={"segment": "c_mktsegment <> 'BUILDING'"}, quarantine={"nation": "c_nationkey > 4"})
_BROKEN = "\n  UNION ALL ".join(f"SELECT count(*) AS seen, '{name}' AS expectation, CAST(sum(CASE WHEN {c} THEN 0 ELSE 1 END) AS BIGINT) AS broken FROM customer" for name, c in RULES.all().items())


@query(_BROKEN)
def observed_expectations(customer):
    """Expectations counted by the job that writes the table."""
    spark = customer.sparkSession
    return observed.write(customer, RULES, new_folder(spark, "observed")).metrics(spark)


@query(_BROKEN)
def stream_observed_expectations(customer):
    """The same by the jobs of a stream's batches."""
    spark, folder = customer.sparkSession, new_folder(customer.sparkSession, "observed-stream")
    customer.repartition(3, "c_custkey").write.parquet(f"{folder}/in")
    arrived = spark.readStream.schema(customer.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return observed.write_stream(arrived, RULES, f"{folder}/out", f"{folder}/checkpoint").metrics(spark)


@query("""SELECT * FROM (SELECT c_custkey, c_name, true AS good FROM customer WHERE c_nationkey > 4 UNION ALL SELECT c_custkey, c_name, false FROM customer WHERE c_nationkey <= 4 OR c_nationkey IS NULL)
  WHERE c_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def quarantine_in_one_write(customer):
    """Good rows and rows in quarantine, from one write."""
    spark, path = customer.sparkSession, new_folder(customer.sparkSession, "quarantined")
    observed.write(customer, RULES, path)
    read = lambda good: observed.read(spark, path, good).select("c_custkey", "c_name", F.lit(good).alias("good"))
    return read(True).unionAll(read(False))


_DOCUMENTS = """SELECT 'order' AS kind, to_json(o) AS v FROM orders o UNION ALL SELECT 'event', json_object('event_id', event_id, 'value', value, 'event_type', event_type, 'props', CAST(props AS JSON)) FROM events"""
_KIND = "CASE WHEN t IN ('UBIGINT', 'BIGINT') THEN 'integer' WHEN t IN ('DOUBLE') THEN 'decimal' WHEN t = 'OBJECT' THEN 'object' ELSE 'text' END"


def _documents(orders, events):
    """Orders and events as JSON documents, events with a nested object."""
    order = orders.select(F.lit("order").alias("kind"), F.to_json(F.struct(*orders.columns)).alias("value"))
    nested = F.struct("event_id", "value", "event_type", F.from_json("props", "k long").alias("props"))
    return order.unionAll(events.select(F.lit("event").alias("kind"), F.to_json(nested).alias("value")))


@query(f"""WITH d AS ({_DOCUMENTS}), top AS (SELECT kind, v, unnest(json_keys(v)) AS k FROM d), one AS (SELECT kind, k AS path, json_extract(v, '$.' || k) AS x FROM top),
  two AS (SELECT kind, path || '.' || k AS path, json_extract(x, '$.' || k) AS x FROM (SELECT *, unnest(json_keys(x)) AS k FROM one WHERE json_type(x) = 'OBJECT'))
  SELECT kind, path, {_KIND} AS type, count(*) AS n FROM (SELECT kind, path, json_type(x) AS t FROM one UNION ALL SELECT kind, path, json_type(x) FROM two) GROUP BY ALL""")
def schema_fields(orders, events):
    """The fields of each kind of document, with their types and how many documents have them."""
    return schema_registry.fields(_documents(orders, events), "kind", "value")


@query("""SELECT 'event' AS kind, path, change, old_type, new_type, CAST(n AS BIGINT) AS n FROM (SELECT count(*) AS c, count(value) AS v FROM events),
  LATERAL (VALUES ('ts', 'new', NULL, 'text', c), ('props.k', 'lost', 'integer', NULL, 0), ('props', 'retyped', 'object', 'text', c), ('user_id', 'new', NULL, 'integer', c)) t(path, change, old_type, new_type, n)""")
def schema_drift(orders, events):
    """Documents of a changed shape against the registered version of their kind."""
    spark, path = orders.sparkSession, new_folder(orders.sparkSession, "schemas")
    schema_registry.register(schema_registry.fields(_documents(orders, events), "kind", "value"), path)
    changed = events.select(F.lit("event").alias("kind"), F.to_json(F.struct(*events.columns)).alias("value"))
    return schema_registry.compare(schema_registry.registered(spark, path), schema_registry.fields(changed, "kind", "value"))


def _orders_table(orders):
    """Name and place of a new external table of the orders, partitioned by status."""
    folder = new_folder(orders.sparkSession, "orders")
    name = f"orders_{folder.rpartition('-')[2]}"
    tables.create_as(orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), name, folder, ["o_orderstatus"])
    return name, folder


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders
  UNION ALL SELECT o_orderkey, o_totalprice, 'X' FROM orders WHERE o_orderpriority = '1-URGENT'""")
def catalog_partition_overwrite(orders):
    """A table created from a query, rows inserted into a new partition, one partition overwritten; then only its files are left."""
    spark, (name, folder) = orders.sparkSession, _orders_table(orders)
    tables.insert(orders.where("o_orderpriority = '1-URGENT'").select(F.lit("X").alias("o_orderstatus"), "o_orderkey", "o_totalprice"), name)
    tables.overwrite_partitions(orders.where("o_orderstatus = 'F'").select("o_orderkey", F.lit(0.0).alias("o_totalprice"), "o_orderstatus"), name)
    tables.drop(spark, name)
    return spark.read.schema("o_orderkey long, o_totalprice double, o_orderstatus string").parquet(folder)


@query("SELECT o_orderstatus, count(*) AS n_rows FROM orders GROUP BY 1")
def catalog_partition_stats(orders):
    """Rows of each partition of a table: a row for each of the few statuses."""
    spark, (name, _) = orders.sparkSession, _orders_table(orders)
    stats = tables.partition_stats(spark, name, ["o_orderstatus"]).where("n_files > 0 AND n_bytes > 0").select("o_orderstatus", "n_rows")
    known = stats.collect()
    tables.drop(spark, name)
    return spark.createDataFrame(known, stats.schema)


@query("SELECT event_id, 'error of user ' || user_id AS message FROM events WHERE event_type = 'error'")
def stream_foreach_alerts(events):
    """A message for each error, given to a writer row by row."""
    spark, folder = events.sparkSession, new_folder(events.sparkSession, "alerts")
    events.write.parquet(f"{folder}/events")
    arrived = spark.readStream.schema(events.schema).parquet(f"{folder}/events").where("event_type = 'error'")
    place = f"{folder}/alerts" if "://" in folder else f"file://{folder.removeprefix('file:')}/alerts"
    alerts.alert_each(arrived.select("event_id", F.concat(F.lit("error of user "), "user_id").alias("message")), place, f"{folder}/checkpoint")
    return spark.read.schema("event_id long, message string").json(f"{folder}/alerts")
