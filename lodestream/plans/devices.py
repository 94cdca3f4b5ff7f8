"""Device readings as JSON with a fixed schema, prices of cities under names with blanks, and a billing export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.plans import relational

QUERIES, ORACLES = {}, {}
DEVICE = "device_id bigint, device_name string, cca3 string, c02_level bigint, battery_level bigint, temp bigint, humidity bigint"


def query(sql):
    def register(plan):
        names = plan.__code__.co_varnames[: plan.__code__.co_argcount]
        QUERIES[plan.__name__] = lambda spark, sf_dir: plan(*[relational.table(spark, sf_dir, n) for n in names])
        ORACLES[plan.__name__] = sql
        return plan

    return register


def devices(orders: DataFrame) -> DataFrame:
    """Readings of devices, as JSON, one an order; the device is the customer, so that devices report often."""
    k = F.col("o_orderkey")
    reading = F.struct(
        F.col("o_custkey").alias("device_id"), F.concat(F.lit("meter-"), F.col("o_custkey")).alias("device_name"), F.concat(F.lit("C"), F.col("o_custkey") % 30).alias("cca3"), (k % 800 + 800).alias("c02_level"),
        (k % 10).alias("battery_level"), (k % 35).alias("temp"), (k % 100).alias("humidity"), F.struct(k.alias("seen")).alias("ignored"),
    )
    return orders.select(F.from_json(F.to_json(reading), DEVICE).alias("d")).select("d.*")


_D = "WITH d AS (SELECT o_custkey AS device_id, 'meter-' || o_custkey AS device_name, 'C' || (o_custkey % 30) AS cca3, o_orderkey % 800 + 800 AS c02_level, o_orderkey % 10 AS battery_level, o_orderkey % 35 AS temp, o_orderkey % 100 AS humidity FROM orders) "


@query(_D + "SELECT cca3, count(device_id) AS number, round(avg(humidity), 6) AS humidity, round(avg(temp), 6) AS temp FROM d GROUP BY 1 ORDER BY number DESC, cca3 LIMIT 20")
def iot_countries(orders):
    means = [F.round(F.avg(c), 6).alias(c) for c in ("humidity", "temp")]
    return devices(orders).groupBy("cca3").agg(F.count("device_id").alias("number"), *means).orderBy(F.desc("number"), "cca3").limit(20)


@query(_D + "SELECT cca3, c02_level FROM d WHERE c02_level > 1400")
def iot_high_readings(orders):
    return devices(orders).where("c02_level > 1400").select("cca3", "c02_level").orderBy(F.desc("c02_level"))


@query(_D + "SELECT cca3, count(DISTINCT device_id) AS devices FROM d WHERE battery_level = 0 GROUP BY 1 ORDER BY devices DESC, cca3 LIMIT 100")
def iot_flat_batteries(orders):
    return devices(orders).where("battery_level = 0").groupBy("cca3").agg(F.countDistinct("device_id").alias("devices")).orderBy(F.desc("devices"), "cca3").limit(100)


@query(_D + "SELECT device_name, temp, humidity, c02_level FROM d WHERE temp > 30 AND humidity > 70 AND battery_level > 6")
def iot_warm_and_damp(orders):
    return devices(orders).where("temp > 30 AND humidity > 70 AND battery_level > 6").select("device_name", "temp", "humidity", "c02_level").orderBy("c02_level")


PRICE, PEOPLE, STATE = "2015 median sales price", "2014 Population estimate", "State Code"


def cities(part: DataFrame) -> DataFrame:
    """Cities with prices in thousands, under names with blanks; some lack a price or the number of people, and such rows go."""
    price = F.when(F.col("p_partkey") % 13 != 0, F.col("p_retailprice") / 4).alias(PRICE)
    people = F.when(F.col("p_partkey") % 17 != 0, F.lit(1000) * F.col("p_size")).alias(PEOPLE)
    return part.select(F.concat("p_name", F.lit(" "), "p_partkey").alias("City"), F.col("p_brand").alias(STATE), people, price).dropna()


_CITY = "WITH c AS (SELECT p_name || ' ' || p_partkey AS city, p_brand AS state, 1000 * p_size AS people, p_retailprice / 4 AS price FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 17 <> 0) "


@query(_CITY + 'SELECT city AS "City", people / 1000 AS "Population (1000s)", price AS "Price (1000s)" FROM c ORDER BY price DESC, city LIMIT 10')
def city_dearest(part):
    return cities(part).select("City", (F.col(PEOPLE) / 1000).alias("Population (1000s)"), F.col(PRICE).alias("Price (1000s)")).orderBy(F.desc("Price (1000s)"), "City").limit(10)


@query(_CITY + "SELECT state, CASE WHEN price >= 300 THEN '>=300K' WHEN price < 300 THEN '< 300K' END AS category, count(*) AS n, round(avg(price), 6) AS mean, min(price) AS lowest, max(price) AS highest FROM c GROUP BY 1, 2")
def city_price_classes(part):
    category = F.when(F.col(PRICE) >= 300, ">=300K").when(F.col(PRICE) < 300, "< 300K")
    return cities(part).groupBy(F.col(STATE).alias("state"), category.alias("category")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(PRICE), 6).alias("mean"), F.min(PRICE).alias("lowest"), F.max(PRICE).alias("highest"))


@query("""SELECT o_orderkey AS line, CASE o_custkey % 4 WHEN 0 THEN 'Cluster Compute' WHEN 1 THEN 'Storage' WHEN 2 THEN 'cluster' ELSE 'Managed Cluster' END AS description, o_totalprice AS cost FROM orders WHERE o_custkey % 4 IN (0, 3)""")
def billing_by_service(orders):
    """Lines of a billing export whose service is named so, in this case only; the name is a field of a struct."""
    name = F.when(F.col("o_custkey") % 4 == 0, "Cluster Compute").when(F.col("o_custkey") % 4 == 1, "Storage").when(F.col("o_custkey") % 4 == 2, "cluster").otherwise("Managed Cluster")
    export = orders.select(F.col("o_orderkey").alias("line"), F.struct(name.alias("description")).alias("service"), F.col("o_totalprice").alias("cost"))
    return export.where(F.col("service.description").like("%Cluster%")).select("line", F.col("service.description").alias("description"), "cost")
