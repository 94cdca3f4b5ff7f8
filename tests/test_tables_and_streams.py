"""Versioned tables, expectations, tolerant reads, the REST source, and streams against batch."""

import json

import pytest
from pyspark.sql import functions as F

from lodestream.operators import merge
from lodestream.operators.expectations import Expectations
from lodestream.sources import files, rest, versioned
from lodestream.streaming import windows

SF = "/root/testdata/sf0.001"


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    versioned.write(spark.range(3), path)
    versioned.write(spark.range(5), path)
    assert versioned.read(spark, path).count() == 5 and len(versioned.versions(spark, path)) == 2


def test_upsert_keeps_one_row_a_key(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    out = merge.upsert(target, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k")
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_expectations(spark):
    df = spark.createDataFrame([(1, "x"), (None, "y"), (-1, None)], "a int, b string")
    good, bad = Expectations(drop={"a": "a is not null"}, quarantine={"b": "b is not null", "pos": "a > 0"}).split(df)
    assert [r["a"] for r in good.collect()] == [1] and [r["_broken"] for r in bad.collect()] == [["b", "pos"]]
    with pytest.raises(Exception, match="expectation p is broken"):
        Expectations(fail={"p": "a > 0"}).split(df)[0].collect()


def test_tolerant_json_and_ndjson(spark, tmp_path):
    path = str(tmp_path / "j")
    spark.createDataFrame([('{"a": 1}',), ("{bad",), ('{"a": 2}',)], "value string").write.text(path)
    good, bad = files.tolerant_json(spark, path, "a int")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and [r["bad_record"] for r in bad.collect()] == ["{bad"]
    files.write_ndjson(spark.range(5), str(tmp_path / "n"), rows_per_file=2)
    assert spark.read.json(str(tmp_path / "n")).count() == 5


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = windows.file_stream(spark, str(tmp_path / "e"), events.schema)
    got = windows.run_to_memory(windows.windowed_counts(stream, "event_type", "ts"), "counted")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, windows.windowed_counts(events, "event_type", "ts").collect()))
    counts = windows.file_stream(spark, str(tmp_path / "e"), events.schema).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    windows.upsert_stream(counts, str(tmp_path / "u"), "event_type", str(tmp_path / "c")).awaitTermination()
    want = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, versioned.read(spark, str(tmp_path / "u")).select("event_type", "n").collect())) == sorted(map(tuple, want.collect()))


def _server(url, headers):
    page = int(url.rpartition("page=")[2]) if "page=" in url else 1
    link = [{"relation": "next", "url": f"http://x/p?page={page + 1}"}] if page < 3 else []
    return 200, {}, json.dumps({"resourceType": "Bundle", "link": link, "entry": [{"resource": {"resourceType": "Patient", "id": f"{page}-{k}"}} for k in range(2)]})


def test_rest_pages(spark):
    fast = rest.Limits(per_second=1e6)
    assert [r["id"] for r in rest.search(_server, "http://x", "Patient", {}, {}, fast)] == ["1-0", "1-1", "2-0", "2-1", "3-0", "3-1"]
    assert len(list(rest.search(_server, "http://x", "Patient", rest.since("2024"), {}, rest.Limits(results=3, per_second=1e6)))) == 3
    with pytest.raises(OSError, match="goes on after 1 pages"):
        list(rest.search(_server, "http://x", "Patient", {}, {}, rest.Limits(pages=1, per_second=1e6)))


def test_rest_retries():
    answers, waits = [(429, {"Retry-After": "7"}, ""), (503, {}, ""), (200, {}, "{}")], []
    assert rest.fetch(lambda u, h: answers.pop(0), "u", {}, rest.Limits(per_second=1e6), waits.append) == {}
    assert 7.0 in waits and 2.0 in waits
    with pytest.raises(OSError, match="404"):
        rest.fetch(lambda u, h: (404, {}, ""), "u", {}, rest.Limits(per_second=1e6))


def test_rest_source_in_spark(spark):
    def transport(url, headers):  # nested, so that it travels to the workers by value
        import json

        kind = url.split("?")[0].rpartition("/")[2]
        return 200, {}, json.dumps({"entry": [{"resource": {"resourceType": kind, "id": str(k)}} for k in range(4)]})

    spark.dataSource.register(rest.rest_source("rest_test", transport, rest.Limits(per_second=1e6)))
    df = spark.read.format("rest_test").options(base="http://x", queries=json.dumps([{"kind": "Patient"}, {"kind": "Observation"}])).load()
    assert sorted((r["resource_type"], r["resource_id"]) for r in df.collect()) == [(k, str(i)) for k in ("Observation", "Patient") for i in range(4)]


@pytest.mark.parametrize("name", ["ml_logistic_cross_validation", "ml_forest_importances", "ml_boosted_regression", "ml_scored_rows", "ridge_cross_validation"])
def test_learning_gives_rows(spark, name):
    from lodestream import catalog

    rows = catalog.QUERIES[name](spark, SF).collect()
    assert rows and all(v is not None and v == v for r in rows for v in r)


def test_message_tables(spark, tmp_path):
    from lodestream.clinical import message_tables

    header = lambda kind, control: f"MSH|^~\\&|A|F|R|RF|20240101||{kind}|{control}|P|2.5"
    file = "\r".join([
        header("ADT^A01", "1"), "PID|1||7^^^H^MR", header("ORU^R01", "2"), "PID|1||8", "OBR|1|p|f|80053^panel", "OBX|1|NM|a^b||5", "OBX|2|NM|c^d||6", header("SIU^S12", "3"), "SCH|s", header("VXU^V04", "4"), "RXA|0|1|20240101||03^MMR",
        header("ORM^O01", "5"), "ORC|NW|9", header("ORU^R01", ""),
    ])
    files_in = spark.createDataFrame([("PID|no header\n" + file, "f1"), (None, "f2"), ("", "f3")], "value string, _source_file string")
    tables = message_tables.write_tables(files_in, str(tmp_path / "m"))
    counts = {n: t.count() for n, t in tables.items()}
    assert counts == {"raw": 7, "quarantine": 2, "adt": 1, "orm": 1, "oru": 1, "oru_observations": 2, "siu": 1, "siu_resources": 0, "vxu": 1, "vxu_vaccinations": 1}
    assert [r["cvx_code"] for r in tables["vxu_vaccinations"].collect()] == ["03"]
    broken = {(r["table"], r["expectation"]): r["broken"] for r in message_tables.expectation_metrics(tables).collect()}
    assert broken["ORU", "observations"] == 0 and broken["VXU", "patient_id"] == 1 and broken["ADT", "patient_id"] == 0


def test_versions_evolve_and_compact(spark, tmp_path):
    path = str(tmp_path / "t")
    versioned.evolve(spark.createDataFrame([(1, "a")], "k int, v string"), path)
    versioned.evolve(spark.createDataFrame([(2, 5)], "k int, net int"), path, "append")
    versioned.compact(spark, path, ["k"], 1)
    assert sorted(map(tuple, versioned.read(spark, path).select("k", "v", "net").collect())) == [(1, "a", None), (2, None, 5)]
    assert [r["version"] for r in versioned.history(spark, path).collect()] == [0, 1, 2]
    versioned.evolve(spark.createDataFrame([(3,)], "k int"), path)
    assert [tuple(r) for r in versioned.read(spark, path).select("k", "v", "net").collect()] == [(3, None, None)]


def test_libsvm(spark, tmp_path):
    (tmp_path / "d.txt").write_text("1 1:0.5 3:2\n0 2:1\n")
    rows = files.libsvm(spark, str(tmp_path / "d.txt"), 3).collect()
    assert [(r["label"], r["features"].toArray().tolist()) for r in rows] == [(1.0, [0.5, 0.0, 2.0]), (0.0, [0.0, 1.0, 0.0])]


def test_a_write_that_died_is_skipped(spark, tmp_path):
    path = str(tmp_path / "t")
    versioned.write(spark.range(1), path)
    (tmp_path / "t" / "_v=1").mkdir()  # what is left of a write that was killed
    (tmp_path / "t" / "_v=1" / "part-0.parquet").write_bytes(b"cut off")
    assert versioned.read(spark, path).count() == 1
    assert versioned.write(spark.range(7), path) == 2 and versioned.read(spark, path).count() == 7
    versioned.write(spark.range(8), path)
    assert versioned.vacuum(spark, path, keep=2) == [0, 1] and versioned.versions(spark, path) == [2, 3]


def test_two_changes_of_a_key_fail(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="several changes of one key: 1"):
        merge.upsert(target, spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string"), "k").collect()
    rows = merge.upsert(target, spark.createDataFrame([(None, "x"), (None, "y"), (2, "z")], "k int, v string"), "k").collect()
    assert sorted(map(tuple, rows), key=repr) == [(1, "a"), (2, "z"), (None, "x"), (None, "y")]


def test_delimited_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id|day|place\n1|2020-01-02|a\n2||b\n")
    path = str(tmp_path / "c.csv")
    assert [tuple(r) for r in files.csv(spark, path, "id int, day string, place string", sep="|").collect()] == [(1, "2020-01-02", "a"), (2, None, "b")]
    assert dict(files.csv(spark, path, sep="|").dtypes)["id"] == "int"
    files.csv_view(spark, "given_csv", path, "id int, day date, place string", sep="|")
    assert spark.sql("SELECT max(day) AS d FROM given_csv").first()["d"].isoformat() == "2020-01-02"
    assert files.at_path(spark, "text", path).count() == 3


def test_message_split_is_linear(spark):
    import time

    from lodestream.clinical import hl7

    file = "FHS|x\r\n" + "MSH|^~\\&|A\r PID|1 \r\n\nOBX|MSH\n" * 16_000
    start = time.perf_counter()
    got = spark.createDataFrame([(file,)], "f string").select(hl7.split_batch(F.col("f")).alias("m")).selectExpr("size(m) AS n", "m[0] AS a", "m[1] AS b").first()
    assert got["n"] == 16_001 and got["a"] == "FHS|x" and got["b"] == "MSH|^~\\&|A\nPID|1\nOBX|MSH" and time.perf_counter() - start < 20


def test_slowly_changing_rows_in_one_pass(spark):
    """Closed, unchanged, new and null cases; the updates are read once."""
    target = spark.createDataFrame([(1, "a", True, 1, None), (2, "b", False, 1, 2), (2, "c", True, 2, None), (3, "d", False, 1, 5), (4, None, True, 1, None), (None, "n", True, 1, None)], "k int, v string, current boolean, effective int, end_date int")
    updates = spark.createDataFrame([(1, "x", 9), (2, "c", 9), (3, "d", 9), (4, None, 9), (5, "e", 9), (6, None, 9), (None, "m", 9)], "k int, v string, effective int")
    out = merge.scd2(target, updates, "k", "v", "effective")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([
        (1, "a", False, 1, 9), (1, "x", True, 9, None), (2, "b", False, 1, 2), (2, "c", True, 2, None), (3, "d", False, 1, 5), (3, "d", True, 9, None), (4, None, True, 1, None), (5, "e", True, 9, None),
        (None, "n", True, 1, None), (None, "m", True, 9, None),
    ], key=repr)
    with pytest.raises(Exception, match="several changes of one key: 1"):
        merge.scd2(target, updates.unionAll(updates.where("k = 1")), "k", "v", "effective").collect()
    read = spark.read.parquet(f"{SF}/customer.parquet").selectExpr("c_custkey as k", "c_name as v")
    plan = merge.upsert(read.limit(10), read, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # target and changes
