"""A paged REST search as a data source: bundles of resources, one row a resource, one partition a query.

``search`` reads pages through a transport, a callable (url, headers) -> (status, headers, body). The default uses
urllib; tests and other clients give their own by the option-free ``rest_source``. Pages of one query follow each other
by their next links, so a query is the unit of distribution: split large ones by date or id ranges.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Transport = Callable[[str, dict], tuple[int, dict, str]]
RETRIED = {429, 500, 502, 503, 504}


@dataclass(frozen=True)
class Limits:
    """count: resources a page; pages, results: most of each (None: all), where a search that goes on after its pages fails; per_second: requests; tries and delay: back-off."""

    count: int = 100
    pages: int | None = None
    results: int | None = None
    per_second: float = 10.0
    tries: int = 3
    delay: float = 1.0


def urllib_transport(url: str, headers: dict) -> tuple[int, dict, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=30) as r:
            return r.status, dict(r.headers), r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read().decode(errors="replace")


def fetch(transport: Transport, url: str, headers: dict, limits: Limits, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One JSON body. Busy servers are asked again, after Retry-After or a delay that doubles; other failures raise."""
    for attempt in range(limits.tries):
        sleep(1 / limits.per_second)
        status, got, body = transport(url, headers)
        if status < 400:
            return json.loads(body)
        if status not in RETRIED or attempt == limits.tries - 1:
            raise OSError(f"{url}: HTTP {status}")
        after = {k.lower(): v for k, v in got.items()}.get("retry-after", "")
        sleep(float(after) if after.isdigit() else limits.delay * 2**attempt)
    raise OSError(f"{url}: no try is allowed")


def search(transport: Transport, base: str, kind: str, params: dict, headers: dict, limits: Limits, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Resources of all pages of a search."""
    url: str | None = f"{base.rstrip('/')}/{kind}?{urllib.parse.urlencode({'_count': limits.count, **params}, doseq=True)}"
    seen = pages = 0
    while url and (limits.pages is None or pages < limits.pages):
        bundle = fetch(transport, url, headers, limits, sleep)
        pages += 1
        for entry in bundle.get("entry") or []:
            if limits.results is not None and seen >= limits.results:
                return
            if entry.get("resource") is not None:
                seen += 1
                yield entry["resource"]
        url = next((x.get("url") for x in bundle.get("link") or [] if x.get("relation") == "next"), None)
    if url:
        raise OSError(f"{base}: the search goes on after {pages} pages; allow more")


def by_id(transport: Transport, base: str, kind: str, key: str, headers: dict, limits: Limits, sleep: Callable[[float], None] = time.sleep) -> dict | None:
    """One resource, or None where the server has none (404) or none any more (410)."""
    url = f"{base.rstrip('/')}/{kind}/{urllib.parse.quote(key, safe='')}"
    gone = lambda u, h: (200, {}, "null") if (got := transport(u, h))[0] in (404, 410) else got
    return fetch(gone, url, headers, limits, sleep)


def capability(transport: Transport, base: str, headers: dict, limits: Limits, sleep: Callable[[float], None] = time.sleep) -> dict[str, list[str]]:
    """What the server says it can do: the interactions of each resource type."""
    statement = fetch(transport, f"{base.rstrip('/')}/metadata", headers, limits, sleep)
    if statement.get("resourceType") != "CapabilityStatement":
        raise OSError(f"{base}: no capability statement but {statement.get('resourceType')}")
    kinds = [k for r in statement.get("rest") or [] for k in r.get("resource") or []]
    return {k["type"]: [i["code"] for i in k.get("interaction") or []] for k in kinds}


def since(timestamp: str) -> dict:
    """Parameters of an incremental search."""
    return {"_lastUpdated": f"gt{timestamp}"}


@dataclass
class Query(InputPartition):
    kind: str
    params: dict


class _Reader(DataSourceReader):
    def __init__(self, options: dict, transport: Transport, limits: Limits):
        self.base, self.token = options["base"], options.get("token")
        self.queries = [Query(q["kind"], q.get("params", {})) for q in json.loads(options["queries"])]
        self.transport, self.limits = transport, limits

    def partitions(self) -> list[InputPartition]:
        return self.queries

    def read(self, partition: Query) -> Iterator[tuple]:
        headers = {"Accept": "application/fhir+json", **({"Authorization": f"Bearer {self.token}"} if self.token else {})}
        # the budget of requests is the server's, so the tasks, which may all run at once, share it
        limits = replace(self.limits, per_second=self.limits.per_second / len(self.queries))
        for resource in search(self.transport, self.base, partition.kind, partition.params, headers, limits):
            yield partition.kind, resource.get("id"), json.dumps(resource)


def rest_source(name: str, transport: Transport = urllib_transport, limits: Limits = Limits()) -> type[DataSource]:
    """A data source to register: options base, token, and queries (a JSON list of kind and params)."""

    class Rest(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "resource_type string, resource_id string, value string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(self.options, transport, limits)

    return Rest
