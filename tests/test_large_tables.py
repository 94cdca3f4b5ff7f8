"""Work that must not gather in one task or on the driver as tables grow."""

from pyspark.sql import functions as F

from lodestream.clinical import dashboard, fhir, flows
from lodestream.functions import udfs
from lodestream.operators.once import spread
from lodestream.operators.quantile import exact_quantiles
from lodestream.plans import clinical_flows, learning, relational, surfaces


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spread_deals_by_size(spark, tmp_path):
    spark.range(0, 200_000, 1, 1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert spread(df).rdd.getNumPartitions() == 8
    assert spread(df, 10_000).rdd.getNumPartitions() > 16
    assert spread(df, 10_000).count() == 200_000


def test_texts_are_dealt_while_narrow(spark):
    """One exchange of keys before the texts are made, none of the texts."""
    tables = [relational.table(spark, "/root/testdata/sf0.001", "lineitem")]
    plan = fhir.bronze(clinical_flows.observation_texts(*tables), dealt=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and plan.index("Patient/") < plan.index("Repartition")


def test_type_is_read_once(spark):
    texts = ["", None, "{bad", "{}", '{"resourceType":""}', '{"resourceType":"Odd","id":"1"}', '{"resourceType":"Condition","subject":{}}', '{"resourceType":"Immunization","status":"x","vaccineCode":{"a":1},"patient":{"a":1}}', '{"resourceType":"Encounter","status":"0","class":"AMB"}', '{"resourceType":"Encounter","status":0}']
    df = fhir.validated(spark.createDataFrame([(t,) for t in texts], "raw_resource string"))
    got = [(r["is_valid"], r["resource_type"], r["validation_errors"], r["warnings"]) for r in df.collect()]
    assert got == [
        (False, None, ["empty resource"], []), (False, None, ["empty resource"], []), (False, None, ["malformed JSON"], []), (False, None, ["missing resourceType"], []), (False, "", ["missing resourceType"], ["unknown type "]), (True, "Odd", [], ["unknown type Odd"]),
        (False, "Condition", ["Condition: missing required field subject"], []), (False, "Immunization", ["Immunization: missing occurrenceDateTime or occurrenceString"], []), (True, "Encounter", [], []),
        (False, "Encounter", ["Encounter: missing required field status", "Encounter: missing required field class"], []),
    ]
    plan = df.select("is_valid")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.resourceType") <= 2


def test_quarantine_is_counted_in_bronze(spark):
    bronze = spark.createDataFrame([("Patient", True), ("Patient", False), (None, False)], "resource_type string, is_valid boolean")
    given = dict.fromkeys(("patient", "encounter", "observation", "condition", "medication_request", "immunization"), spark.range(0).selectExpr("true AS active", "'x' AS status", "'x' AS clinical_status_code", "'x' AS patient_id"))
    figures = {r["dataset"]: r["n"] for r in dashboard.totals(given | {"bronze": bronze}).collect()}
    assert (figures["total_resources"], figures["valid_resources"], figures["quarantined"]) == (3, 1, 2)
    assert dashboard.dataset(given | {"bronze": bronze}, "quarantined").first()["n"] == 2


def test_joins_by_patient_do_not_broadcast(spark):
    make = spark.createDataFrame
    encounter, patient = make([("1", "in", "AMB"), ("1", "in", "AMB"), ("2", "out", "IMP")], "subject_id string, class_display string, class_code string"), make([("1", "male"), ("2", None)], "id string, gender string")
    shown = dashboard.encounter_patient_heatmap({"encounter": encounter, "patient": patient})
    journey = flows.care_journey(encounter, make([("1", "laboratory")], "subject_id string, category_code string"), make([("2", "active")], "subject_id string, clinical_status_code string"))
    for df in (shown, journey):
        assert "Broadcast" not in planned(df) and "SortMergeJoin" in planned(df)
    assert rows(shown) == [("in", "male", 2), ("out", None, 1)]


def test_pandas_mean_in_two_steps(spark):
    df = spark.range(0, 80_000, 1, 8).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).alias("v"))
    got = udfs.grouped_mean(df, "g", "v", "m")
    assert "MapInPandas" in planned(got) and rows(got) == rows(df.groupBy("g").agg(F.avg("v")))
    assert rows(udfs.grouped_mean(df.where("v IS NULL"), "g", "v", "m")) == [(1, None), (2, None), (None, None)]
    assert "MapInPandas" in planned(surfaces.QUERIES["pandas_grouped_mean"](spark, "/root/testdata/sf0.001"))


def test_quantiles_without_a_group_in_one_task(spark):
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    ties = spark.range(0, 30_001).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 > 0, F.floor(F.pow(F.hash("id") % 1000, 2) / 7).cast("double")).alias("v"))
    one = spark.createDataFrame([(7, 1.5), (8, 2.0), (8, 2.0), (8, 5.0), (9, None), (None, 3.0), (None, 4.0)], "g long, v double")
    df = ties.unionByName(one)
    want = rows(df.where("v IS NOT NULL").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares)))))
    for accuracy in (10, 2000):
        got = rows(exact_quantiles(df, "g", "v", shares, accuracy))
        assert [g[0] for g in got] == [w[0] for w in want]
        assert all(abs(a - b) < 1e-6 for g, w in zip(got, want, strict=True) for a, b in zip(g[1], w[1], strict=True))
    assert " percentile(" not in planned(relational.QUERIES["quantiles"](spark, "/root/testdata/sf0.001"))


def test_trees_train_on_dealt_rows(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(learning, "spread", lambda df, piece: dealt.append(piece) or spread(df, piece))
    for name in ("ml_decision_trees", "ml_boosted_regression"):
        assert learning.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert dealt == [learning.TREE_PIECE] * 2
