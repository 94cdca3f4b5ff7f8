"""Relational queries over the driver's tables: filters, aggregates, joins, windows, sets, scalars, JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.operators import quantile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str):
    """Register a query whose parameters name the tables that it reads, with the SQL that it is checked against."""

    def register(plan: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        names = plan.__code__.co_varnames[: plan.__code__.co_argcount]
        QUERIES[plan.__name__] = lambda spark, sf_dir: plan(*[table(spark, sf_dir, n) for n in names])
        ORACLES[plan.__name__] = sql
        return plan

    return register


def status(rate):
    return F.when(rate >= 99, "HEALTHY").when(rate >= 95, "WARNING").otherwise("CRITICAL")


@query("""WITH c AS (SELECT event_type, count(*) AS total_rows, CAST(sum(CASE WHEN value > 1 THEN 1 ELSE 0 END) AS BIGINT) AS valid_rows FROM events GROUP BY event_type),
  r AS (SELECT *, round(valid_rows * 100.0 / total_rows, 2) AS p FROM c)
  SELECT event_type, total_rows, valid_rows, total_rows - valid_rows AS invalid_rows, CAST(p AS DOUBLE) AS valid_pct,
  CASE WHEN p >= 99 THEN 'HEALTHY' WHEN p >= 95 THEN 'WARNING' ELSE 'CRITICAL' END AS status FROM r""")
def quality_metrics(events):
    """Per type: rows, valid and invalid rows, share of valid ones, and a status by that share."""
    rate = F.round(F.col("valid_rows") * 100.0 / F.col("total_rows"), 2).cast("double")
    counted = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("total_rows"), F.sum(F.when(F.col("value") > 1, 1).otherwise(0)).alias("valid_rows"))
    return counted.select("event_type", "total_rows", "valid_rows", (F.col("total_rows") - F.col("valid_rows")).alias("invalid_rows"), rate.alias("valid_pct"), status(rate).alias("status"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def filter_project_topk(orders):
    return orders.where("o_orderstatus = 'F' and o_totalprice > 1000").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n FROM part GROUP BY 1")
def case_bucket(part):
    return part.groupBy(F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN p_type LIKE '%STEEL%' THEN 'steel' WHEN p_type LIKE '%BRASS%' THEN 'brass' WHEN p_type LIKE 'PROMO%' THEN 'promo' ELSE 'other' END AS kind, p_brand, count(*) AS n FROM part GROUP BY 1, 2")
def like_cascade(part):
    t = F.col("p_type")
    return part.groupBy(F.when(t.like("%STEEL%"), "steel").when(t.like("%BRASS%"), "brass").when(t.like("PROMO%"), "promo").otherwise("other").alias("kind"), "p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), '--') AS segment, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0.0) AS balance
  FROM customer WHERE nullif(c_nationkey, 3) IS NOT NULL""")
def null_handling(customer):
    gaps = customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.nullif("c_nationkey", F.lit(3)).alias("nation"))
    return gaps.dropna(subset=["nation"]).fillna("--").fillna(0.0, subset=["balance"]).select("c_custkey", "segment", "balance")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_partkey) AS n_parts, CAST(sum(l_linenumber) AS BIGINT) AS lines, round(sum(l_quantity), 2) AS qty,
  round(avg(l_discount), 6) AS avg_discount, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1, 2""")
def groupby_count_distinct(lineitem):
    return lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("n_parts"), F.sum("l_linenumber").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("qty"),
        F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"),
    )


@query("SELECT n_orders, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) GROUP BY 1")
def two_level_agg(orders):
    return orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders")).groupBy("n_orders").agg(F.count(F.lit(1)).alias("customers"))


@query("SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1 HAVING count(*) > 100")
def having_alias(lineitem):
    return lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue")).where("n > 100")


@query("SELECT user_id, m.event_id AS event_id, m.event_type AS event_type FROM (SELECT user_id, max(struct_pack(ts := ts, event_id := event_id, event_type := event_type)) AS m FROM events GROUP BY 1)")
def arg_max_struct(events):
    return events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m")).select("user_id", "m.event_id", "m.event_type")


@query("SELECT user_id, array_to_string(list_slice(list_sort(list_distinct(list(event_type))), 1, 3), ',') AS kinds FROM events GROUP BY 1")
def collect_distinct_slice(events):
    return events.groupBy("user_id").agg(F.array_join(F.slice(F.sort_array(F.collect_set("event_type")), 1, 3), ",").alias("kinds"))


@query("""SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 2) AS "F", round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 2) AS "O" FROM lineitem GROUP BY 1""")
def pivot_sum(lineitem):
    return lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.sum("l_quantity"), 2))


@query("SELECT CAST(floor((l_quantity - 1) / 5) AS INTEGER) + 1 AS bin, count(*) AS n FROM lineitem WHERE l_quantity >= 1 AND l_quantity < 51 GROUP BY 1")
def histogram_bins(lineitem):
    return lineitem.where("l_quantity >= 1 and l_quantity < 51").groupBy(F.width_bucket("l_quantity", F.lit(1.0), F.lit(51.0), F.lit(10)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS q2, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3,
  round(stddev_samp(l_extendedprice), 4) AS sd FROM lineitem GROUP BY 1""")
def quantiles(lineitem):
    exact = quantile.exact_quantiles(lineitem, "l_returnflag", "l_extendedprice", [0.25, 0.5, 0.75])
    deviation = lineitem.groupBy(F.col("l_returnflag").alias("_flag")).agg(F.round(F.stddev("l_extendedprice"), 4).alias("sd"))
    return deviation.join(exact, F.col("_flag").eqNullSafe(F.col("l_returnflag")), "left").select(F.col("_flag").alias("l_returnflag"), *[F.round(F.get("quantiles", F.lit(i)), 4).alias(f"q{i + 1}") for i in range(3)], "sd")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def dedup_latest(events):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", "event_id", "event_type")


@query("""SELECT o_orderpriority, o_orderkey, CAST(days AS INTEGER) AS days FROM (SELECT o_orderpriority, o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), CAST(max(l_shipdate) AS DATE)) AS days
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, o_orderdate) QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY days DESC, o_orderkey) = 1""")
def qualify_longest_per_type(orders, lineitem):
    last = lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    timed = orders.join(last, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("days", F.datediff("shipped", "o_orderdate"))
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("days"), "o_orderkey")
    return timed.withColumn("r", F.row_number().over(w)).where("r = 1").select("o_orderpriority", "o_orderkey", "days")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity - avg(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS from_mean FROM lineitem")
def window_group_mean(lineitem):
    w = Window.partitionBy("l_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return lineitem.select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") - F.avg("l_quantity").over(w), 6).alias("from_mean"))


@query("SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def inner_join_agg(orders, customer, nation):
    per_customer = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    joined = per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query("""WITH f AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O')
  SELECT c_mktsegment AS s1, coalesce(f.o_orderpriority, 'none') AS s2, coalesce(o.o_orderpriority, 'none') AS s3, count(DISTINCT c_custkey) AS n
  FROM customer LEFT JOIN f ON f.o_custkey = c_custkey LEFT JOIN o ON o.o_custkey = c_custkey GROUP BY 1, 2, 3""")
def left_join_journey(customer, orders):
    side = lambda s: orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias(f"p{s}")).distinct()
    joined = customer.join(side("F"), "c_custkey", "left").join(side("O"), "c_custkey", "left")
    return joined.groupBy(F.col("c_mktsegment").alias("s1"), F.coalesce("pF", F.lit("none")).alias("s2"), F.coalesce("pO", F.lit("none")).alias("s3")).agg(F.countDistinct("c_custkey").alias("n"))


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) < 10")
def theta_residual_join(supplier, customer):
    """Balances are put in buckets as wide as the difference, and joined with the same and the next buckets only."""
    bucket = lambda c: F.floor(F.col(c) / 10)
    near = supplier.withColumn("bucket", F.explode(F.array(bucket("s_acctbal") - 1, bucket("s_acctbal"), bucket("s_acctbal") + 1)))
    there = customer.withColumn("c_bucket", bucket("c_acctbal"))
    on = (F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("bucket") == F.col("c_bucket")) & (F.abs(F.col("s_acctbal") - F.col("c_acctbal")) < 10)
    return near.join(there, on).select("s_suppkey", "c_custkey")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def anti_except(customer, orders):
    return customer.select("c_custkey").subtract(orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join(customer, orders):
    return customer.join(orders.where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'user-' || user_id ELSE 'none' END AS owner FROM events""")
def array_label_lookup(events):
    labels = events.withColumn("labels", F.array(F.struct(F.lit("env").alias("key"), F.lit("prod").alias("value")), F.struct(F.when(F.col("event_type") == "view", "team").otherwise("x").alias("key"), F.concat(F.lit("user-"), F.col("user_id")).alias("value"))))
    return labels.select("event_id", F.coalesce(F.get(F.filter("labels", lambda x: x["key"] == "team"), F.lit(0))["value"], F.lit("none")).alias("owner"))


@query("""SELECT 'orders' AS source, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'lineitem', l_linestatus, count(*) FROM lineitem GROUP BY 2""")
def union_tagged_counts(orders, lineitem):
    count = lambda df, tag, key: df.groupBy(F.col(key).alias("status")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(tag).alias("source"), "status", "n")
    return count(orders, "orders", "o_orderstatus").unionByName(count(lineitem, "lineitem", "l_linestatus"))


@query("""WITH u AS (SELECT c_nationkey AS nation, c_custkey AS id, c_acctbal AS bal, 1 AS side FROM customer UNION ALL SELECT s_nationkey, s_suppkey, s_acctbal, 2 FROM supplier)
  SELECT nation, id, side FROM u QUALIFY row_number() OVER (PARTITION BY nation ORDER BY bal DESC, side, id) = 1""")
def union_dedup(customer, supplier):
    u = customer.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.lit(1).alias("side")).unionByName(supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"), F.lit(2).alias("side")))
    return u.withColumn("r", F.row_number().over(Window.partitionBy("nation").orderBy(F.desc("bal"), "side", "id"))).where("r = 1").select("nation", "id", "side")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def time_window_hourly(events):
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "users")


@query("SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def minute_metrics(events):
    return events.groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS prefix, regexp_extract(c_name, '([0-9]+)$', 1) AS num, regexp_replace(c_name, '[^A-Za-z]', '', 'g') AS letters, length(c_name) AS len, md5(c_name) AS masked FROM customer")
def string_functions(customer):
    n = F.col("c_name")
    return customer.select("c_custkey", F.get(F.split(n, "#"), F.lit(0)).alias("prefix"), F.regexp_extract(n, "([0-9]+)$", 1).alias("num"), F.regexp_replace(n, "[^A-Za-z]", "").alias("letters"), F.length(n).cast("long").alias("len"), F.md5(n.cast("binary")).alias("masked"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%Y-%m') AS ym, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS since,
  o_orderdate + INTERVAL 1 MINUTE AS later FROM orders""")
def date_functions(orders):
    d = F.col("o_orderdate")
    return orders.select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.to_date(d).alias("d"), F.date_format(d, "yyyy-MM").alias("ym"), F.datediff(d, F.lit("1992-01-01").cast("date")).alias("since"), (d + F.expr("interval 1 minute")).alias("later"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_extract(events):
    return events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS k, count(*) AS n FROM events GROUP BY 1")
def from_json_struct(events):
    return events.select(F.from_json("props", "k int").alias("p")).groupBy((F.col("p.k") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def variant_path(events):
    return events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


@query("SELECT n_nationkey, key, value FROM (SELECT n_nationkey, 'name' AS key, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'region', CAST(n_regionkey AS VARCHAR) FROM nation)")
def map_explode(nation):
    return nation.select("n_nationkey", F.explode(F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))))


@query("SELECT region.r_name AS name, n_name AS member FROM nation JOIN region ON n_regionkey = r_regionkey")
def json_roundtrip(nation, region):
    """Nested rows to JSON text and back: departments with arrays of members."""
    nested = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.collect_list(F.struct("n_name")).alias("members"))
    text = nested.select(F.to_json(F.struct(F.col("r_name").alias("name"), "members")).alias("j"))
    return text.select(F.from_json("j", "name string, members array<struct<n_name:string>>").alias("d")).select("d.name", F.explode("d.members").alias("m")).select("name", F.col("m.n_name").alias("member"))


@query("SELECT l_suppkey, round(exp(avg(ln(l_quantity))), 6) AS geometric_mean, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted FROM lineitem GROUP BY 1")
def geometric_mean(lineitem):
    return lineitem.groupBy("l_suppkey").agg(F.round(F.exp(F.avg(F.ln("l_quantity"))), 6).alias("geometric_mean"), F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity"), 4).alias("weighted"))


@query("SELECT round(sqrt(avg(power(l_discount - l_tax, 2))), 8) AS rmse FROM lineitem")
def rmse(lineitem):
    return lineitem.agg(F.round(F.sqrt(F.avg(F.pow(F.col("l_discount") - F.col("l_tax"), 2))), 8).alias("rmse"))


# Job-cost analytics, with orders as the job log: status as state, priority as job type, price as bytes processed.
_JOBS = """WITH jobs AS (SELECT o_orderkey AS job, o_orderdate AS created, o_orderpriority AS job_type, o_custkey AS usr, o_orderstatus AS state, CAST(floor(o_totalprice * 1e6) AS BIGINT) AS bytes,
  CAST(o_orderkey % 100000 AS BIGINT) AS slot_ms, CASE WHEN o_custkey % 3 = 0 THEN 'res-1' END AS reservation FROM orders) """
_TB = 1024.0**4


def _jobs(orders):
    return orders.select(
        F.col("o_orderkey").alias("job"), F.col("o_orderdate").alias("created"), F.col("o_orderpriority").alias("job_type"), F.col("o_custkey").alias("usr"), F.col("o_orderstatus").alias("state"),
        F.floor(F.col("o_totalprice") * 1e6).alias("bytes"), (F.col("o_orderkey") % 100000).alias("slot_ms"), F.when(F.col("o_custkey") % 3 == 0, "res-1").alias("reservation"),
    )


@query(_JOBS + "SELECT CAST(year(created) AS INTEGER) AS y, CAST(month(created) AS INTEGER) AS m, job_type, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(bytes) / power(1024, 4) * 5, 4) AS cost FROM jobs GROUP BY 1, 2, 3")
def monthly_cost(orders):
    return _jobs(orders).groupBy(F.year("created").alias("y"), F.month("created").alias("m"), "job_type").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.round(F.sum("bytes") / _TB * 5, 4).alias("cost"))


@query(_JOBS + "SELECT usr, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM jobs GROUP BY 1 ORDER BY bytes DESC, usr LIMIT 10")
def cost_by_user(orders):
    return _jobs(orders).groupBy("usr").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "usr").limit(10)


@query(_JOBS + "SELECT job_type, round(avg(slot_ms), 4) AS avg_slot, CAST(sum(slot_ms) AS BIGINT) AS total_slot FROM jobs GROUP BY 1")
def slot_time_by_type(orders):
    return _jobs(orders).groupBy("job_type").agg(F.round(F.avg("slot_ms"), 4).alias("avg_slot"), F.sum("slot_ms").alias("total_slot"))


@query(_JOBS + "SELECT job, slot_ms, bytes FROM jobs WHERE slot_ms > 5000 AND bytes < 20000000000 ORDER BY slot_ms DESC, job LIMIT 20")
def slow_small_jobs(orders):
    return _jobs(orders).where("slot_ms > 5000 and bytes < 20000000000").select("job", "slot_ms", "bytes").orderBy(F.desc("slot_ms"), "job").limit(20)


@query(_JOBS + "SELECT CASE WHEN reservation IS NULL THEN 'on-demand' ELSE 'reserved' END AS kind, state, count(*) AS n, CAST(sum(slot_ms) AS BIGINT) AS slot_ms FROM jobs GROUP BY 1, 2")
def on_demand_vs_reserved(orders):
    return _jobs(orders).groupBy(F.when(F.isnull("reservation"), "on-demand").otherwise("reserved").alias("kind"), "state").agg(F.count(F.lit(1)).alias("n"), F.sum("slot_ms").alias("slot_ms"))


@query(_JOBS + "SELECT CAST(created AS DATE) AS day, CAST(sum(slot_ms) AS BIGINT) AS slot_ms, count(DISTINCT usr) AS users FROM jobs WHERE year(created) = 1995 GROUP BY 1")
def slot_trend(orders):
    return _jobs(orders).where(F.year("created") == 1995).groupBy(F.to_date("created").alias("day")).agg(F.sum("slot_ms").alias("slot_ms"), F.countDistinct("usr").alias("users"))
