"""A REST search as a stream: what the server has changed since the last batch, read in ranges of time that can be repeated.

An offset is a moment. A batch is the range after one moment up to the next: each resource has one time of its last
change and so is in one range, and a range that is read again, after a failure or a lost executor, asks for the same.
Servers may show a change a little after its time, so the newest moment read is ``lag`` seconds back. A range is cut into
slices of time, one task each for every kind of resource; all tasks share the server's budget of requests.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lodestream.sources.rest import Limits, Transport, search, urllib_transport
from lodestream.sources.rest_auth import Auth, Nobody, authorized


def moment(ms: int) -> str:
    """Milliseconds since 1970 as the server writes them."""
    return datetime.fromtimestamp(ms / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


@dataclass
class Slice(InputPartition):
    """Changes of one kind of resource after ``start`` up to ``end``, in milliseconds, with a share of the requests."""

    kind: str
    start: int
    end: int
    tasks: int


def slices(kinds: list[str], start: int, end: int, parts: int) -> list[Slice]:
    """The range after start up to end, in at most ``parts`` slices for each kind; none of an empty range."""
    cuts = sorted({start + (end - start) * k // parts for k in range(parts + 1)})
    found = [(kind, a, b) for kind in kinds for a, b in zip(cuts, cuts[1:], strict=False)]
    return [Slice(kind, a, b, len(found)) for kind, a, b in found]


class _Changes(DataSourceStreamReader):
    def __init__(self, options: dict, transport: Transport, limits: Limits, auth: Auth, now: Callable[[], float]):
        self.base, self.kinds = options["base"], json.loads(options["kinds"])
        self.first, self.lag, self.parts = int(options.get("since_ms", 0)), float(options.get("lag", 5)), int(options.get("slices", 4))
        self.transport, self.limits, self.auth, self.now = transport, limits, auth, now

    def initialOffset(self) -> dict:
        return {"until_ms": self.first}

    def latestOffset(self, *_) -> dict:
        return {"until_ms": max(self.first, int((self.now() - self.lag) * 1000))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return slices(self.kinds, start["until_ms"], max(start["until_ms"], end["until_ms"]), self.parts)

    def read(self, partition: Slice) -> Iterator[tuple]:
        limits = replace(self.limits, per_second=self.limits.per_second / partition.tasks)
        params = {"_lastUpdated": [f"gt{moment(partition.start)}", f"le{moment(partition.end)}"]}
        for resource in search(authorized(self.transport, self.auth), self.base, partition.kind, params, {"Accept": "application/fhir+json"}, limits):
            yield partition.kind, resource.get("id"), (resource.get("meta") or {}).get("lastUpdated"), json.dumps(resource)

    def commit(self, end: dict) -> None:
        """Nothing to free: the server keeps what was read."""


def rest_changes(name: str, transport: Transport = urllib_transport, limits: Limits = Limits(), auth: Auth = Nobody(), now: Callable[[], float] = time.time) -> type[DataSource]:
    """A stream source to register: options base, kinds (a JSON list), since_ms, lag (seconds) and slices."""

    class Changes(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "resource_type string, resource_id string, last_updated string, value string"

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Changes(self.options, transport, limits, auth, now)

    return Changes
