"""Analytic queries in the shapes of dashboards, flows and job-cost reports, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.plans import relational
from lodestream.plans.relational import status

QUERIES, ORACLES = {}, {}


def query(sql):
    def register(plan):
        names = plan.__code__.co_varnames[: plan.__code__.co_argcount]
        QUERIES[plan.__name__] = lambda spark, sf_dir: plan(*[relational.table(spark, sf_dir, n) for n in names])
        ORACLES[plan.__name__] = sql
        return plan

    return register


def first_match(value, rules, otherwise):
    """The label of the first LIKE pattern that a value matches."""
    out = F
    for pattern, label in rules:
        out = out.when(value.like(pattern), label)
    return out.otherwise(otherwise)


def n_rows():
    return F.count(F.lit(1)).alias("n")


@query("""SELECT 'customer' AS source, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part""")
def dashboard_table_counts(customer, supplier, part):
    one = lambda df, name: df.agg(n_rows()).select(F.lit(name).alias("source"), "n")
    return one(customer, "customer").unionByName(one(supplier, "supplier")).unionByName(one(part, "part"))


@query("SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders")
def dashboard_distinct_counts(orders):
    return orders.agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderpriority").alias("priorities"))


@query("""SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'Building' WHEN c_mktsegment = 'MACHINERY' THEN 'Machinery' ELSE 'Other' END AS label, count(*) AS n FROM customer GROUP BY c_mktsegment""")
def dashboard_raw_groups(customer):
    """Grouped by the raw value and labelled afterwards, so that several rows may say Other."""
    label = F.when(F.col("c_mktsegment") == "BUILDING", "Building").when(F.col("c_mktsegment") == "MACHINERY", "Machinery").otherwise("Other")
    return customer.groupBy("c_mktsegment").agg(n_rows()).select(label.alias("label"), "n")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10")
def dashboard_top_types(part):
    return part.groupBy("p_type").agg(n_rows()).orderBy(F.desc("n"), "p_type").limit(10)


@query("SELECT event_id, user_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def dashboard_recent_events(events):
    return events.select("event_id", "user_id", "event_type", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)


@query("""WITH r AS (SELECT l_suppkey, count(*) AS total, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS BIGINT) AS good FROM lineitem GROUP BY 1),
  p AS (SELECT l_suppkey, total, CAST(round(good * 100.0 / total, 2) AS DOUBLE) AS rate FROM r)
  SELECT l_suppkey, total, rate, CASE WHEN rate >= 99 THEN 'HEALTHY' WHEN rate >= 95 THEN 'WARNING' ELSE 'CRITICAL' END AS status FROM p ORDER BY rate, l_suppkey LIMIT 15""")
def dashboard_worst_quality(lineitem):
    rate = F.round(F.sum(F.when(F.col("l_returnflag") != "R", 1).otherwise(0)) * 100.0 / F.count(F.lit(1)), 2).cast("double")
    rated = lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("total"), rate.alias("rate"))
    return rated.orderBy("rate", "l_suppkey").limit(15).withColumn("status", status(F.col("rate")))


@query("""SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON 'Customer/' || c_custkey = 'Customer/' || o_custkey GROUP BY 1, 2""")
def dashboard_heat_map(orders, customer):
    """The keys are bare on both sides, so they are joined as they are, without the prefix of a reference."""
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_orderpriority").agg(n_rows())


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def dashboard_daily_activity(events):
    return events.groupBy("event_type", F.to_date("ts").alias("day")).agg(n_rows(), F.countDistinct("user_id").alias("users"))


@query("""SELECT CASE WHEN l_returnflag IN ('A', 'AA') THEN 'Accepted' WHEN l_returnflag IN ('R') THEN 'Returned' WHEN l_returnflag IS NULL OR l_returnflag = 'N' THEN 'None' ELSE 'Other' END AS flag, l_linestatus, count(*) AS n
  FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, flag, l_linestatus LIMIT 50""")
def flow_flags(lineitem):
    flag = F.col("l_returnflag")
    named = F.when(flag.isin("A", "AA"), "Accepted").when(flag == "R", "Returned").when(flag.isNull() | (flag == "N"), "None").otherwise("Other")
    return lineitem.groupBy(named.alias("flag"), "l_linestatus").agg(n_rows()).orderBy(F.desc("n"), "flag", "l_linestatus").limit(50)


@query("""SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, CASE WHEN html IS NULL OR html = '' THEN 'empty' ELSE 'full' END AS state, count(*) AS n FROM pages WHERE url IS NOT NULL GROUP BY 1, 2""")
def flow_source_validity(pages):
    return pages.where("url is not null").groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.when(F.coalesce("html", F.lit("")) == "", "empty").otherwise("full").alias("state")).agg(n_rows())


@query("""SELECT CASE WHEN lower(p_name) LIKE '%blue%' THEN 'Blue' WHEN lower(p_name) LIKE '%red%' THEN 'Red' WHEN lower(p_name) LIKE '%green%' THEN 'Green' WHEN lower(p_type) LIKE '%steel%' THEN 'Steel' ELSE 'Other' END AS class, upper(left(p_brand, 1)) || lower(substr(p_brand, 2)) AS brand, count(*) AS n
  FROM part GROUP BY 1, 2""")
def flow_classes(part):
    name = first_match(F.lower("p_name"), [("%blue%", "Blue"), ("%red%", "Red"), ("%green%", "Green")], None)
    return part.groupBy(F.coalesce(name, first_match(F.lower("p_type"), [("%steel%", "Steel")], "Other")).alias("class"), F.concat(F.upper(F.left("p_brand", F.lit(1))), F.lower(F.substring("p_brand", 2, 1000))).alias("brand")).agg(n_rows())


@query("""WITH e AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('view', 'click')), p AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
  SELECT e.event_type AS first_step, CASE WHEN p.user_id IS NULL THEN 'no purchase' ELSE 'purchase' END AS outcome, count(DISTINCT e.user_id) AS n FROM e LEFT JOIN p ON p.user_id = e.user_id GROUP BY 1, 2""")
def flow_cohort_outcome(events):
    first = events.where(F.col("event_type").isin("view", "click")).select("user_id", "event_type").distinct()
    bought = events.where("event_type = 'purchase'").select("user_id").distinct().withColumn("bought", F.lit(True))
    return first.join(bought, "user_id", "left").groupBy(F.col("event_type").alias("first_step"), F.when(F.col("bought"), "purchase").otherwise("no purchase").alias("outcome")).agg(F.countDistinct("user_id").alias("n"))


# Job-cost reports by label: orders as jobs, with a team and an environment in an array of labels
_LABELLED = """WITH jobs AS (SELECT o_orderkey AS job, o_orderdate AS created, CASE WHEN o_custkey % 4 > 0 THEN 'team-' || (o_custkey % 4) ELSE 'unlabelled' END AS team,
  CASE WHEN o_custkey % 3 = 0 THEN 'reserved' ELSE 'on-demand' END AS slots, CAST(floor(o_totalprice * 1e6) AS BIGINT) AS bytes, CAST(o_orderkey % 100000 AS BIGINT) AS slot_ms FROM orders) """


def _labelled(orders):
    team = F.when(F.col("o_custkey") % 4 > 0, F.concat(F.lit("team-"), (F.col("o_custkey") % 4).cast("string")))
    label = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    labels = F.filter(F.array(label("env", F.lit("prod")), label("team", team)), lambda x: x["value"].isNotNull())
    jobs = orders.select(
        F.col("o_orderkey").alias("job"), F.col("o_orderdate").alias("created"), labels.alias("labels"), F.when(F.col("o_custkey") % 3 == 0, "res-1").alias("reservation"),
        F.floor(F.col("o_totalprice") * 1e6).alias("bytes"), (F.col("o_orderkey") % 100000).alias("slot_ms"),
    )
    found = F.get(F.filter("labels", lambda x: x["key"] == "team"), F.lit(0))["value"]
    return jobs.select("job", "created", F.coalesce(found, F.lit("unlabelled")).alias("team"), F.when(F.isnull("reservation"), "on-demand").otherwise("reserved").alias("slots"), "bytes", "slot_ms")


@query(_LABELLED + "SELECT team, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(bytes) / power(1024, 4) * 5, 4) AS cost, CAST(sum(slot_ms) AS BIGINT) AS slot_ms FROM jobs GROUP BY 1")
def cost_by_label(orders):
    return _labelled(orders).groupBy("team").agg(n_rows(), F.sum("bytes").alias("bytes"), F.round(F.sum("bytes") / 1024.0**4 * 5, 4).alias("cost"), F.sum("slot_ms").alias("slot_ms"))


@query(_LABELLED + "SELECT job, team, bytes FROM jobs WHERE team <> 'unlabelled' ORDER BY bytes DESC, job LIMIT 20")
def top_jobs_by_label(orders):
    return _labelled(orders).where("team <> 'unlabelled'").select("job", "team", "bytes").orderBy(F.desc("bytes"), "job").limit(20)


@query(_LABELLED + "SELECT slots, team, CAST(year(created) AS INTEGER) AS y, count(*) AS n, CAST(sum(slot_ms) AS BIGINT) AS slot_ms FROM jobs GROUP BY ALL HAVING count(*) > 2")
def slots_by_type_and_label(orders):
    return _labelled(orders).groupBy("slots", "team", F.year("created").alias("y")).agg(n_rows(), F.sum("slot_ms").alias("slot_ms")).where("n > 2")


@query("SELECT o_orderpriority AS job_type, round(sum(floor(o_totalprice * 1e6)) / power(1024, 4) * 5, 4) AS cost, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1")
def cost_by_type_in_year(orders):
    return orders.where(F.year("o_orderdate") == 1996).groupBy(F.col("o_orderpriority").alias("job_type")).agg(F.round(F.sum(F.floor(F.col("o_totalprice") * 1e6)) / 1024.0**4 * 5, 4).alias("cost"), n_rows())


@query("""SELECT CAST(r.n_regionkey AS INTEGER) AS region, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS sd, count(*) AS n, CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative
  FROM customer JOIN nation r ON c_nationkey = n_nationkey GROUP BY 1""")
def mean_and_spread(customer, nation):
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("n_regionkey").alias("region")).agg(F.round(F.avg("c_acctbal"), 4).alias("mean"), F.round(F.stddev("c_acctbal"), 4).alias("sd"), n_rows(), F.sum(F.when(F.col("c_acctbal") < 0, 1).otherwise(0)).alias("negative"))


@query("SELECT CAST(o_orderdate AS DATE) AS day, arg_min(o_orderkey, struct_pack(p := o_totalprice, k := o_orderkey)) AS best FROM orders GROUP BY 1")
def best_per_day(orders):
    return orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"))


@query("SELECT sum(o_totalprice) AS top_three FROM (SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3)")
def limit_then_sum(orders):
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3).agg(F.sum("o_totalprice").alias("top_three"))


@query("""SELECT n_nationkey, m.key AS sensor, m.value AS reading FROM (SELECT n_nationkey, unnest([struct_pack(key := 'temp', value := n_nationkey * 2), struct_pack(key := 'level', value := n_regionkey + 1)]) AS m FROM nation)""")
def nested_map_sensors(nation):
    """Maps of structs, exploded to rows, and read by dotted paths."""
    device = lambda v: F.struct(F.struct(v.alias("reading")).alias("state"))
    nested = nation.select("n_nationkey", F.struct(F.create_map(F.lit("temp"), device(F.col("n_nationkey") * 2), F.lit("level"), device(F.col("n_regionkey") + 1)).alias("sensors")).alias("devices"))
    return nested.select("n_nationkey", F.explode("devices.sensors").alias("sensor", "v")).select("n_nationkey", "sensor", F.col("v.state.reading").alias("reading"))
