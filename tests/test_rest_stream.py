"""The REST stream against a server whose data grow, and the life of its tokens."""

import json
import time

import pytest

from lodestream.sources import rest, rest_auth, rest_stream

FAST = rest.Limits(count=3, per_second=1e6, tries=1)


def server(folder):
    """A transport over resources in a folder, as closures, so that it travels to the workers by value."""
    folder = str(folder)

    def transport(url, headers):
        import json
        import time
        import urllib.parse
        from pathlib import Path

        with open(f"{folder}/requests", "a") as log:
            log.write(f"{time.time()} {url}\n")
        if Path(folder, "down").exists() and "Observation" in url:
            return 503, {}, ""
        address, _, query = url.partition("?")
        params = urllib.parse.parse_qs(query)
        after, upto = (next(v[2:] for v in params["_lastUpdated"] if v[:2] == op) for op in ("gt", "le"))
        page, count = int(params.get("page", ["0"])[0]), int(params["_count"][0])
        kept = [r for line in Path(folder, "data").read_text().splitlines() if (r := json.loads(line))["resourceType"] == address.rpartition("/")[2] and after < r["meta"]["lastUpdated"] <= upto]
        link = [{"relation": "next", "url": f"{address}?{urllib.parse.urlencode({**params, 'page': page + 1}, doseq=True)}"}] if len(kept) > (page + 1) * count else []
        return 200, {}, json.dumps({"link": link, "entry": [{"resource": r} for r in kept[page * count : (page + 1) * count]]})

    def now():
        from pathlib import Path

        return float(Path(folder, "clock").read_text())

    return transport, now


def add(folder, kind, ids, ms):
    with open(folder / "data", "a") as f:
        f.writelines(json.dumps({"resourceType": kind, "id": f"{kind[0]}{k}", "meta": {"lastUpdated": rest_stream.moment(ms + k)}}) + "\n" for k in ids)


def test_no_change_is_lost_or_doubled(spark, tmp_path):
    """Batches of a growing server, one of which fails in the midst of its reading and is repeated after a restart."""
    folder = tmp_path / "server"
    folder.mkdir()
    transport, now = server(folder)
    spark.dataSource.register(rest_stream.rest_changes("changes_test", transport, FAST, now=now))

    def run(clock):
        (folder / "clock").write_text(str(clock))
        df = spark.readStream.format("changes_test").options(base="http://x", kinds='["Patient", "Observation"]', since_ms="1000000", lag="2", slices="3").load()
        df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["resource_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    add(folder, "Patient", range(10), 1_000_001)
    add(folder, "Patient", [99], 900_000)  # before the start
    add(folder, "Observation", range(5), 1_003_000)  # newer than the lag allows at first
    assert run(1004.0) == [f"P{k}" for k in range(10)]
    add(folder, "Observation", range(5, 9), 1_010_000)
    (folder / "down").touch()
    with pytest.raises(Exception, match="HTTP 503"):
        run(1100.0)
    add(folder, "Patient", [50], 1_099_000)  # comes while the server is down, after the range of the failed batch
    (folder / "down").unlink()
    run(1200.0)
    assert run(1200.0) == sorted([f"O{k}" for k in range(9)] + [f"P{k}" for k in (*range(10), 50)])
    asked = [line.split(" ", 1)[1] for line in (folder / "requests").read_text().splitlines()]
    assert len({u for u in asked if "Patient" in u and "page" not in u}) >= 6  # three slices of each range


def test_slices_cover_a_range_once():
    found = rest_stream.slices(["a", "b"], 10, 25, 4)
    assert [(s.start, s.end) for s in found if s.kind == "a"] == [(10, 13), (13, 17), (17, 21), (21, 25)] and {s.tasks for s in found} == {8}
    assert rest_stream.slices(["a"], 5, 5, 4) == [] and [(s.start, s.end) for s in rest_stream.slices(["a"], 5, 7, 4)] == [(5, 6), (6, 7)]


def test_tasks_share_the_budget_of_requests(spark, tmp_path):
    """Four tasks at once ask no faster than one may."""
    (tmp_path / "clock").write_text("1000")
    (tmp_path / "data").write_text("")
    transport, now = server(tmp_path)
    spark.dataSource.register(rest_stream.rest_changes("slow_changes_test", transport, rest.Limits(count=1, per_second=10.0, tries=1), now=now))
    add(tmp_path, "Patient", range(24), 100_000)
    df = spark.readStream.format("slow_changes_test").options(base="http://x", kinds='["Patient"]', since_ms="99999", lag="0", slices="4")
    (tmp_path / "clock").write_text("100.023")
    df.load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 24
    times = sorted(float(line.split()[0]) for line in (tmp_path / "requests").read_text().splitlines())
    spans = [b - a for a, b in zip(times, times[12:], strict=False)]
    assert len(times) >= 24 and min(spans) > 0.75  # any twelve requests on end take over a second, less what starts at once


def test_a_token_is_fetched_once_and_renewed_in_time():
    clock, fetched, seen = [1000.0], [], []

    def post(url, form):
        fetched.append(form)
        return 200, json.dumps({"access_token": f"t{len(fetched)}", "expires_in": 300})

    def transport(url, headers):
        seen.append(headers["Authorization"])
        clock[0] += 1
        page = int(url.rpartition("page=")[2]) if "page=" in url else 1
        link = [{"relation": "next", "url": f"http://x/p?page={page + 1}"}] if page < 30 else []
        return 200, {}, json.dumps({"link": link, "entry": [{"resource": {"id": str(page)}}]})

    auth = rest_auth.Client("http://t/1", "me", "s3", "read", post, lambda: clock[0])
    send = rest_auth.authorized(transport, auth)
    assert len(list(rest.search(send, "http://x", "Patient", {}, {}, rest.Limits(per_second=1e6)))) == 30
    assert len(fetched) == 1 and set(seen) == {"Bearer t1"} and fetched[0] == {"grant_type": "client_credentials", "client_id": "me", "client_secret": "s3", "scope": "read"}
    clock[0] = 1000 + 239
    send("http://x", {})
    assert len(fetched) == 1
    clock[0] = 1000 + 240  # a minute before the end
    send("http://x", {})
    assert len(fetched) == 2 and seen[-1] == "Bearer t2"
    same = rest_auth.Client("http://t/1", "me", "s3", "read", post, lambda: clock[0])
    assert same.header() == "Bearer t2" and len(fetched) == 2  # another reader of the process
    with pytest.raises(rest_auth.AuthError, match="no token, HTTP 403"):
        rest_auth.Client("http://t/2", "me", "s3", "", lambda u, f: (403, ""), lambda: 0.0).header()


def test_a_refused_token_is_fetched_anew():
    fetched, answers = [], [401, 200]
    auth = rest_auth.Client("http://t/3", "me", "s", "", lambda u, f: (fetched.append(1), (200, '{"access_token": "t"}'))[1], time.time)
    assert rest_auth.authorized(lambda u, h: (answers.pop(0), {}, "{}"), auth)("u", {})[0] == 200 and len(fetched) == 2


def test_other_ways_to_ask():
    seen = []
    ask = lambda auth: rest_auth.authorized(lambda u, h: (seen.append(h), (200, {}, ""))[1], auth)("u", {"a": "b"})
    for auth in (rest_auth.Nobody(), rest_auth.Basic("user", "pass"), rest_auth.Bearer("x")):
        ask(auth)
    assert seen == [{"a": "b"}, {"a": "b", "Authorization": "Basic dXNlcjpwYXNz"}, {"a": "b", "Authorization": "Bearer x"}]


def test_one_resource_and_capabilities():
    statement = {"resourceType": "CapabilityStatement", "rest": [{"resource": [{"type": "Patient", "interaction": [{"code": "read"}, {"code": "search-type"}]}, {"type": "Observation"}]}]}
    pages = {"http://x/Patient/a%2Fb": (200, '{"id": "a/b"}'), "http://x/Patient/gone": (410, ""), "http://x/metadata": (200, json.dumps(statement)), "http://y/metadata": (200, '{"resourceType": "OperationOutcome"}')}
    transport = lambda u, h: (pages[u][0], {}, pages[u][1]) if u in pages else (404, {}, "")
    assert rest.by_id(transport, "http://x/", "Patient", "a/b", {}, FAST) == {"id": "a/b"}
    assert rest.by_id(transport, "http://x", "Patient", "gone", {}, FAST) is None and rest.by_id(transport, "http://x", "Patient", "none", {}, FAST) is None
    assert rest.capability(transport, "http://x", {}, FAST) == {"Patient": ["read", "search-type"], "Observation": []}
    with pytest.raises(OSError, match="no capability statement"):
        rest.capability(transport, "http://y", {}, FAST)
