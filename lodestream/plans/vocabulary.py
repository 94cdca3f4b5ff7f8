"""Smaller column operations in bulk: summaries, averages of all numbers, renaming, casting, and functions with several results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestream.plans import relational

QUERIES, ORACLES = {}, {}
NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint")


def query(sql):
    def register(plan):
        names = plan.__code__.co_varnames[: plan.__code__.co_argcount]
        QUERIES[plan.__name__] = lambda spark, sf_dir: plan(*[relational.table(spark, sf_dir, n) for n in names])
        ORACLES[plan.__name__] = sql
        return plan

    return register


def numeric(df):
    return [c for c, t in df.dtypes if t in NUMBERS]


@query("""SELECT s.summary, CAST(CASE s.summary WHEN 'count' THEN n WHEN 'mean' THEN round(m, 4) WHEN 'min' THEN lo ELSE hi END AS DOUBLE) AS balance
  FROM (SELECT count(c_acctbal) AS n, avg(c_acctbal) AS m, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), (VALUES ('count'), ('mean'), ('min'), ('max')) s(summary)""")
def describe_column(customer):
    return customer.select("c_acctbal").summary("count", "mean", "min", "max").select("summary", F.round(F.col("c_acctbal").cast("double"), 4).alias("balance"))


@query("""SELECT p_brand, round(avg(p_partkey), 4) AS avg_p_partkey, round(avg(p_size), 4) AS avg_p_size, round(avg(p_retailprice), 4) AS avg_p_retailprice FROM part GROUP BY 1""")
def average_all_numbers(part):
    return part.groupBy("p_brand").agg(*[F.round(F.avg(c), 4).alias(f"avg_{c}") for c in numeric(part)])


@query("""SELECT CAST(s_suppkey AS DOUBLE) AS supp_key, CAST(s_nationkey AS DOUBLE) AS nation_key, CAST(s_acctbal AS DOUBLE) AS account_balance FROM supplier""")
def bulk_rename_and_cast(supplier):
    """Names with spaces get underscores, all columns become doubles."""
    spaced = supplier.select(F.col("s_suppkey").alias("supp key"), F.col("s_nationkey").alias("nation key"), F.col("s_acctbal").alias("account balance"))
    return spaced.select([F.col(f"`{c}`").cast("double").alias(c.replace(" ", "_")) for c in spaced.columns])


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'false' ELSE 'true' END AS is_open FROM orders""")
def negated_flag_text(orders):
    return orders.select("o_orderkey", (~(F.col("o_orderstatus") == "F")).cast("string").alias("is_open"))


@query("""SELECT c_custkey, split_part(c_name, '#', 1) AS head, length(c_name) AS size FROM customer""")
def struct_udf(customer):
    """A vectorised function with two results in a struct."""

    @F.pandas_udf("head string, size long")
    def parts(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"head": names.str.split("#").str[0], "size": names.str.len()})

    return customer.select("c_custkey", parts("c_name").alias("p")).select("c_custkey", "p.head", "p.size")


@query("""SELECT o_custkey, o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS mean FROM orders""")
def grouped_function_over_window(orders):
    """A grouped vectorised function over a whole partition of a window; the built-in average does the same without Python."""

    @F.pandas_udf("double")
    def mean(v: pd.Series) -> float:
        return v.mean()

    return orders.select("o_custkey", "o_orderkey", F.round(mean("o_totalprice").over(Window.partitionBy("o_custkey")), 4).alias("mean"))


@query("""SELECT n_name, CAST(sum(c_custkey * 2) AS BIGINT) AS doubled FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name LIKE '%A%' GROUP BY 1""")
def aggregate_of_function(customer, nation):
    """A sum of what a function makes of each row."""
    return customer.join(nation.where(F.col("n_name").like("%A%")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum(F.col("c_custkey") * 2).alias("doubled"))
