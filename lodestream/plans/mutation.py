"""Queries for table mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import merge
from lodestream.plans import relational

QUERIES, ORACLES = {}, {}


def query(sql):
    def register(plan):
        names = plan.__code__.co_varnames[: plan.__code__.co_argcount]
        QUERIES[plan.__name__] = lambda spark, sf_dir: plan(*[relational.table(spark, sf_dir, n) for n in names])
        ORACLES[plan.__name__] = sql
        return plan

    return register


@query("""WITH ch AS (SELECT user_id AS c_custkey, event_type AS c_mktsegment, ts, event_id, event_type = 'error' AS deleted FROM events),
  l AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY ts DESC, event_id DESC) = 1)
  SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM l) UNION ALL SELECT c_custkey, c_mktsegment FROM l WHERE NOT deleted""")
def merge_cdc(customer, events):
    changes = events.select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("c_mktsegment"), F.struct("ts", "event_id").alias("at"), (F.col("event_type") == "error").alias("deleted"))
    return merge.apply_changes(customer.select("c_custkey", "c_mktsegment"), changes, "c_custkey", "at", "deleted")


@query("""WITH u AS (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), t AS (SELECT c_custkey, CAST(0 AS BIGINT) AS n FROM customer WHERE c_custkey % 2 = 0)
  SELECT coalesce(u.c_custkey, t.c_custkey) AS c_custkey, coalesce(u.n, t.n) AS n FROM t FULL JOIN u ON t.c_custkey = u.c_custkey""")
def merge_upsert(customer, orders):
    target = customer.where("c_custkey % 2 = 0").select("c_custkey", F.lit(0).cast("long").alias("n"))
    changes = orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return merge.upsert(target, changes, "c_custkey")


@query("""WITH t AS (SELECT c_custkey, c_mktsegment AS segment, DATE '2020-01-01' AS effective FROM customer), u AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey + 100000000, 'NEW' FROM customer WHERE c_custkey % 5 = 0)
  SELECT t.c_custkey, t.segment, (u.c_custkey IS NULL OR u.segment = t.segment) AS current, t.effective, CASE WHEN u.segment <> t.segment THEN DATE '2021-06-01' END AS end_date FROM t LEFT JOIN u ON u.c_custkey = t.c_custkey
  UNION ALL SELECT u.c_custkey, u.segment, true, DATE '2021-06-01', CAST(NULL AS DATE) FROM u LEFT JOIN t ON u.c_custkey = t.c_custkey WHERE t.c_custkey IS NULL OR t.segment <> u.segment""")
def merge_scd2(customer):
    day = lambda d: F.lit(d).cast("date")
    target = customer.select("c_custkey", F.col("c_mktsegment").alias("segment"), F.lit(True).alias("current"), day("2020-01-01").alias("effective"), F.lit(None).cast("date").alias("end_date"))
    changed = customer.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "NEW").otherwise(F.col("c_mktsegment")).alias("segment"))
    added = customer.where("c_custkey % 5 = 0").select((F.col("c_custkey") + 100000000).alias("c_custkey"), F.lit("NEW").alias("segment"))
    return merge.scd2(target, changed.unionByName(added).withColumn("effective", day("2021-06-01")), "c_custkey", "segment", "effective")
