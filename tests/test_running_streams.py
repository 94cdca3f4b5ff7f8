"""Stream-stream joins with restarts, bucketed upserts with conflicts and replays, observed expectations."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestream.operators import observed
from lodestream.operators.expectations import Expectations
from lodestream.sources import bucketed
from lodestream.streaming import alerts, joins, windows

DAY = datetime(2024, 1, 1)


def at(minutes):
    return DAY + timedelta(minutes=minutes)


@pytest.fixture
def views(spark):
    return spark.createDataFrame([(k, k % 3, at(10 * k)) for k in range(30)] + [(100, None, at(5))], "view long, u1 long, t1 timestamp_ntz")


@pytest.fixture
def clicks(spark):
    return spark.createDataFrame([(k, k % 3, at(10 * k + 12)) for k in range(0, 30, 2)] + [(100, 0, at(12)), (101, None, at(6))], "click long, u2 long, t2 timestamp_ntz")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def batch_join(views, clicks, how, within="15 minutes"):
    return windows.interval_join(views, clicks, ("u1", "u2"), ("t1", "t2"), within, how)


@pytest.mark.parametrize("how", ["inner", "left_outer"])
def test_streams_join_as_tables_do(views, clicks, how):
    got = joins.replayed_join(views, clicks, ("u1", "u2"), ("t1", "t2"), "15 minutes", how)
    plain = views.join(clicks, F.expr("u1 = u2 AND t2 >= t1 AND t2 <= t1 + interval 15 minutes"), how)
    pairs = ["view", "click"]
    assert rows(got.select(*pairs)) == rows(plain.select(*pairs)) == rows(batch_join(views, clicks, how).select(*pairs))


def test_unmatched_rows_come_late_and_late_rows_are_dropped(spark, views, clicks, tmp_path):
    streams = joins.JoinedStreams(spark, str(tmp_path), views, clicks, ("u1", "u2"), ("t1", "t2"), "15 minutes", "left_outer")
    early = views.where(F.col("t1") < F.lit(at(100)))
    streams.arrive(early, clicks.where(F.col("t2") < F.lit(at(100))))
    streams.run()
    first = streams.result()
    open_still = F.col("t1") > F.lit(at(92 - 15))  # clicks up to minute 92 have come, so these may still find a match
    assert first.where("click IS NOT NULL").count() > 0 and first.where("click IS NULL AND u1 IS NOT NULL").count() > 0
    assert first.where(open_still & F.col("click").isNull() & F.col("u1").isNotNull()).count() == 0 and early.where(open_still).count() > 0
    streams.arrive(views.where(F.col("t1") >= F.lit(at(100))), clicks.where(F.col("t2") >= F.lit(at(100))))
    streams.run()
    end = streams.finish()
    whole = rows(streams.result(end).select("view", "click"))
    assert whole == rows(batch_join(views, clicks, "left_outer").select("view", "click"))
    streams.arrive(spark.createDataFrame([(999, 0, at(1))], views.schema), spark.createDataFrame([(999, 0, at(2))], clicks.schema))
    query = streams.run()
    dropped = sum(state["numRowsDroppedByWatermark"] for p in query.recentProgress for state in p["stateOperators"])
    assert dropped >= 2 and rows(streams.result(end).select("view", "click")) == whole


def test_join_state_is_split_by_time(spark):
    """One key with all rows: the join's keys have the time as well, and each pair comes once."""
    left = spark.range(500).select(F.lit(1).alias("u1"), F.timestamp_seconds(F.col("id") * 60).alias("t1"), "id")
    right = spark.range(500).select(F.lit(1).alias("u2"), F.timestamp_seconds(F.col("id") * 60).alias("t2"), F.col("id").alias("other"))
    got = windows.interval_join(left, right, ("u1", "u2"), ("t1", "t2"), "5 minutes")
    assert got.count() == got.distinct().count() == sum(min(6, 500 - k) for k in range(500))
    assert "_at" in got._jdf.queryExecution().toString() and got.columns == ["u1", "t1", "id", "u2", "t2", "other"]


def table(spark, *values):
    return spark.createDataFrame(list(values), "k long, v string")


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    bucketed.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("v")), path, "k", buckets=8)
    before = bucketed.manifest(spark, path)
    after = bucketed.upsert(table(spark, (7, "b")), path, "k")
    changed = [b for b in before["buckets"] if before["buckets"][b] != after["buckets"][b]]
    assert len(changed) == 1 and len(before["buckets"]) == 8
    written = [d for d in (tmp_path / "t" / "data").iterdir() if d.name == after["buckets"][changed[0]][0].split("/")[1]]
    assert [d.name for d in written[0].iterdir() if d.is_dir()] == [f"_bucket={changed[0]}"]
    got = dict(map(tuple, bucketed.read(spark, path).collect()))
    assert got == {k: "b" if k == 7 else "a" for k in range(200)}
    assert [r["n_changed"] for r in bucketed.history(spark, path).orderBy("version").collect()] == [8, 1]
    with pytest.raises(ValueError, match="has the key k"):
        bucketed.upsert(table(spark, (7, "b")).withColumnRenamed("v", "w"), path, "k")


@pytest.mark.parametrize("same", [True, False])
def test_the_second_writer_tries_again(spark, tmp_path, same):
    """Another writer commits first: with the same bucket the merge is repeated, with another one only the commit is."""
    path = str(tmp_path / "t")
    bucketed.upsert(spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v")), path, "k", buckets=4)
    of = {r["k"]: r["b"] for r in spark.range(100).select(F.col("id").alias("k"), F.pmod(F.xxhash64("id"), F.lit(4)).alias("b")).collect()}
    other = next(k for k in range(100) if k != 5 and (of[k] == of[5]) == same)
    tried = []

    def first_comes_another():
        if not tried:
            bucketed.upsert(table(spark, (other, "other")), path, "k")
        tried.append(len(list((tmp_path / "t" / "data").iterdir())))

    bucketed.upsert(table(spark, (5, "mine")), path, "k", before_commit=first_comes_another)
    got = dict(map(tuple, bucketed.read(spark, path).collect()))
    assert got == {k: {5: "mine", other: "other"}.get(k, "a") for k in range(100)}
    assert len(tried) == 2 and bucketed.versions(spark, path) == [0, 1, 2]
    assert tried[1] - tried[0] == (1 if same else 0)  # data written for the second try


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    assert bucketed.upsert(table(spark, (1, "a")), path, "k", writer="s", batch=4)["version"] == 0
    assert bucketed.upsert(table(spark, (1, "repeated")), path, "k", writer="s", batch=4) is None
    assert bucketed.upsert(table(spark, (1, "older")), path, "k", writer="s", batch=3) is None
    assert bucketed.upsert(table(spark, (2, "b")), path, "k", writer="other", batch=4)["version"] == 1
    assert bucketed.upsert(table(spark), path, "k", writer="s", batch=5)["batches"] == {"s": 5, "other": 4}
    assert rows(bucketed.read(spark, path)) == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="several changes of one key"):
        bucketed.upsert(table(spark, (1, "x"), (1, "y")), path, "k")
    bucketed.upsert(table(spark, (None, "n")), path, "k")
    assert rows(bucketed.read(spark, path)) == [(1, "a"), (2, "b"), (None, "n")]


def test_versions_by_time_and_restore(spark, tmp_path):
    path = str(tmp_path / "t")
    early = datetime.now()
    bucketed.upsert(table(spark, (1, "a")), path, "k", buckets=2)
    between = datetime.now()
    bucketed.upsert(table(spark, (1, "b"), (2, "b")), path, "k")
    assert rows(bucketed.read(spark, path, as_of=between)) == [(1, "a")] and rows(bucketed.read(spark, path, as_of=datetime.now())) == [(1, "b"), (2, "b")]
    with pytest.raises(bucketed.VersionGone, match="no version as early"):
        bucketed.read(spark, path, as_of=early)
    bucketed.restore(spark, path, 0)
    assert rows(bucketed.read(spark, path)) == [(1, "a")] and bucketed.versions(spark, path) == [0, 1, 2]
    assert bucketed.vacuum(spark, path, keep=1) == 0  # all too young
    assert bucketed.vacuum(spark, path, keep=1, older_than=-10) > 0
    assert rows(bucketed.read(spark, path)) == [(1, "a")]
    with pytest.raises(bucketed.VersionGone, match="files of version 1 .* were removed"):
        bucketed.read(spark, path, 1).collect()
    with pytest.raises(bucketed.VersionGone, match="has no version 9"):
        bucketed.read(spark, path, 9)


RULES = Expectations(warn={"pos": "a > 0"}, drop={"b is there": "b is not null"}, quarantine={"small": "a < 10"}, fail={"known": "b <> 'fatal'"})
DATA = [(1, "x"), (None, "x"), (-1, None), (50, "y"), (60, "z"), (2, "y")]


def test_expectations_are_counted_by_the_write(spark, tmp_path):
    df = spark.createDataFrame(DATA, "a int, b string").where("b is null or b <> 'fatal'")
    rules = Expectations(RULES.warn, RULES.drop, RULES.quarantine)
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("checked", "one write")
    result = observed.write(df, rules, str(tmp_path / "t"))
    jobs = status.getJobIdsForGroup("checked")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1
    assert (result.seen, result.written, result.quarantined, result.dropped) == (6, 2, 3, 1) and result.success
    assert rows(result.metrics(spark)) == rows(rules.metrics(df))
    assert result.pass_percent()["pos"] == 66.67 and result.status() == "CRITICAL" and result.to_dict()["broken"]["small"] == 3
    assert rows(observed.read(spark, str(tmp_path / "t"))) == [(1, "x"), (2, "y")]
    assert [r["_broken"] for r in observed.read(spark, str(tmp_path / "t"), good=False).collect()] == [["small"]] * 3


def test_a_failed_expectation_fails_the_write(spark, tmp_path):
    df = spark.createDataFrame([*DATA, (1, "fatal")], "a int, b string")
    with pytest.raises(observed.WriteFailed, match="expectation known is broken") as failed:
        observed.write(df, RULES, str(tmp_path / "t"))
    assert failed.value.result.status() == "FAILED" and not failed.value.result.success


def test_expectations_of_an_empty_write(spark, tmp_path):
    spark.createDataFrame([], "a int, b string").write.parquet(str(tmp_path / "in"))
    result = observed.write(spark.read.parquet(str(tmp_path / "in")), RULES, str(tmp_path / "t"))
    assert (result.seen, result.written) == (0, 0) and result.status() == "HEALTHY" and set(result.broken.values()) == {0}


def test_expectations_are_counted_by_each_batch(spark, tmp_path):
    df = spark.createDataFrame(DATA, "a int, b string")
    rules = Expectations(RULES.warn, RULES.drop, RULES.quarantine)
    total = []
    for part in (df.where("a > 1"), df.where("a <= 1 or a is null")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        arrived = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        total.append(observed.write_stream(arrived, rules, str(tmp_path / "out"), str(tmp_path / "checkpoint")))
    assert [r.seen for r in total] == [3, 3] and all(r.success and r.batches for r in total)
    summed = {name: sum(r.broken[name] for r in total) for name in rules.all()}
    assert summed == {r["expectation"]: r["broken"] for r in rules.metrics(df).collect()}
    assert rows(observed.read(spark, str(tmp_path / "out"))) == [(1, "x"), (2, "y")]


def test_models_work_after_a_checked_write(spark, tmp_path):
    """A session that has counted expectations can still be captured by a model's summary."""
    from lodestream import catalog

    observed.write(spark.createDataFrame(DATA, "a int, b string"), Expectations(RULES.warn), str(tmp_path / "t"))
    assert catalog.QUERIES["ml_logistic_cross_validation"](spark, "/root/testdata/sf0.001").count() > 0


def test_a_writer_that_fails_leaves_each_row_once(spark, tmp_path):
    class Stumbling(alerts.AlertFiles):
        def process(self, row):
            import os

            if row["id"] == 77 and not os.path.exists(str(self.path).removeprefix("file://") + "-stumbled"):
                open(str(self.path).removeprefix("file://") + "-stumbled", "w").close()
                raise RuntimeError("stumbled")
            super().process(row)

    spark.range(0, 200, 1, 8).write.parquet(str(tmp_path / "in"))
    arrived = spark.readStream.schema("id long").option("maxFilesPerTrigger", 8).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="stumbled"):
        alerts.alert_each(arrived, f"file://{tmp_path}/out", str(tmp_path / "c"), Stumbling)
    for _ in range(2):  # the batch is repeated, then there is nothing more
        alerts.alert_each(arrived, f"file://{tmp_path}/out", str(tmp_path / "c"), Stumbling)
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "out")).collect()) == list(range(200))
    writer = alerts.AlertFiles(f"file://{tmp_path}/out2")
    for _ in range(2):
        if writer.open(3, 5):
            writer.process(spark.range(1).first())
        writer.close(None)
    assert [r["id"] for r in spark.read.json(str(tmp_path / "out2")).collect()] == [0]


def test_made_streams_join(spark, tmp_path):
    """Impressions and late clicks of a counting stream: a click finds the impression 50 numbers before it, in every run alike."""
    found = []
    for run in range(2):
        views, clicks = alerts.impressions_and_clicks(alerts.counted(spark, 100, 3_600_000, 60_000))
        joined = windows.interval_join(views, clicks.withColumnRenamed("adId", "clicked"), ("adId", "clicked"), ("impressionTime", "clickTime"), "10 minutes")
        query = joined.writeStream.format("memory").queryName(f"made{run}").trigger(processingTime="0 seconds").start()
        try:
            for _ in range(300):
                if (query.lastProgress or {}).get("batchId", -1) >= 4:
                    break
                query.awaitTermination(0.2)
        finally:
            query.stop()
        found.append({r["adId"] for r in spark.table(f"made{run}").collect() if r["adId"] < 300})
    sample = {r["id"] - 50 for r in spark.range(350).where(alerts.sampled(F.col("id"), 10) & (F.col("id") > 50)).collect()}
    assert found[0] == found[1] == sample and sample


def test_a_rate_stream_counts(spark):
    df = alerts.counter(spark, 50)
    assert df.isStreaming and [c for c, _ in df.dtypes] == ["timestamp", "value"]
