"""Catalog tables, saved models, streams that they score, and grouped Python aggregates in two steps."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from lodestream.functions import udfs
from lodestream.sources import tables
from lodestream.streaming import scoring


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, None, None)], "k int, v string, part string")
    tables.create_as(df, "made_here", str(tmp_path / "made"), ["part"], {"owner's": "it\\me", "quality": "gold"})
    yield "made_here"
    tables.drop(spark, "made_here")


def test_create_insert_overwrite(spark, table, tmp_path):
    assert rows(spark.table(table)) == [(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, None, None)]
    before = spark.conf.get(tables.OVERWRITE)
    tables.insert(spark.createDataFrame([("z", 9, "n")], "part string, k int, v string"), table)
    tables.overwrite_partitions(spark.createDataFrame([("x", 7, "only")], "part string, k int, v string"), table)
    assert rows(spark.table(table)) == [(3, "c", "y"), (4, None, None), (7, "only", "x"), (9, "n", "z")] and spark.conf.get(tables.OVERWRITE) == before
    with pytest.raises(ValueError, match="has the columns"):
        tables.insert(spark.range(1), table)
    spark.sql(f"INSERT INTO {table} SELECT k + 100, v, part FROM {table} WHERE part = 'y'")
    assert {r["part"]: (r["n_rows"], r["n_files"]) for r in tables.partition_stats(spark, table, ["part"]).collect()} == {"x": (1, 1), "y": (2, 2), "z": (1, 1), None: (1, 1)}
    tables.drop(spark, table)
    assert spark.read.parquet(str(tmp_path / "made")).count() == 5  # the files stay


def test_describe_and_attach(spark, table, tmp_path):
    known = tables.describe(spark, table)
    assert known["k"] == "int" and known["part"] == "string" and known["Type"] == "EXTERNAL" and known["Location"].endswith("/made") and "quality=gold" in known["Table Properties"]
    spark.range(3).write.parquet(str(tmp_path / "loose"))
    tables.attach(spark, "found_here", str(tmp_path / "loose"), "id bigint")
    assert spark.sql("SELECT sum(id) AS s FROM found_here").first()["s"] == 3
    tables.drop(spark, "found_here")
    assert not spark.catalog.tableExists("found_here")


def test_a_saved_model_scores_a_stream_as_a_table(spark, tmp_path):
    data = spark.range(200).select(F.col("id").cast("double").alias("x"), (F.col("id") * 3.0 + 1).alias("y"), F.timestamp_seconds(F.col("id") * 600).alias("at"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="y", solver="normal")]).fit(data)
    loaded = scoring.load(spark.newSession(), scoring.save(model, str(tmp_path / "m")))
    assert rows(model.transform(data).select("x", "prediction")) == rows(loaded.transform(data).select("x", "prediction"))
    for part in (data.where("x < 100"), data.where("x >= 100")):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        arrived = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
        out = scoring.scores_by_window(loaded, arrived, "at", "1 hour", late="10 minutes").writeStream.format("parquet").outputMode("append")
        out.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    rounded = lambda df: rows(df.select("start", "n", F.round("mean", 6)))
    final, whole = rounded(spark.read.parquet(str(tmp_path / "out"))), rounded(scoring.scores_by_window(loaded, data, "at", "1 hour"))
    assert 0 < len(final) < len(whole) and set(final) < set(whole)  # windows that the watermark has closed


def test_no_task_holds_a_group(spark):
    """Three groups over eight tasks: what reaches the shuffle is a row per group and task."""
    df = spark.range(0, 80_000, 1, 8).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).alias("v"), F.lit(2.0).alias("w"))
    sums = udfs.arrow_sums(df, ["g"], "v", "w")
    want = df.groupBy("g").agg(F.count("v"), F.sum("v"), F.sum(F.when(F.col("v").isNotNull(), 2.0)), F.sum(F.col("v") * 2))
    assert rows(sums) == rows(want)
    plan = sums._jdf.queryExecution().executedPlan()
    sums.collect()
    assert "MapInArrow" in plan.toString()
    parts = df.repartition(8).withColumn("t", F.spark_partition_id())
    assert udfs.arrow_sums(parts, ["g", "t"], "v").count() == 24
    assert rows(udfs.arrow_sums(df.where("false"), ["g"], "v")) == []


def test_subtract_mean_keeps_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), (None, 4.0), (None, 8.0)], "g string, v double")
    assert rows(udfs.arrow_subtract_mean(df, "g", "v")) == sorted([("a", -0.5), ("a", 0.5), ("b", None), (None, -2.0), (None, 2.0)], key=repr)


def test_trees_give_finite_figures(spark):
    from lodestream import catalog

    got = {r["what"]: r["value"] for r in catalog.QUERIES["ml_decision_trees"](spark, "/root/testdata/sf0.001").collect()}
    assert 0 <= got["weighted precision of brand"] <= 1 and 0 < got["rmse of price"] < 1e6
