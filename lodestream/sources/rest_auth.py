"""Who asks a REST server: nobody, a user and password, a fixed token, or tokens that a client fetches and renews."""

from __future__ import annotations

import base64
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from lodestream.sources.rest import Transport

#: A fetched token is not used in its last seconds.
MARGIN = 60.0
#: Seconds that a token lasts whose answer does not say.
LASTS = 3600.0
#: Tokens of this process by client: a task's searches, and tasks that run one after the other in a worker, share them.
_TOKENS: dict[tuple[str, str, str], tuple[str, float]] = {}

Post = Callable[[str, dict[str, str]], tuple[int, str]]


def urllib_post(url: str, form: dict[str, str]) -> tuple[int, str]:
    with urllib.request.urlopen(urllib.request.Request(url, urllib.parse.urlencode(form).encode()), timeout=30) as r:
        return r.status, r.read().decode()


class AuthError(OSError):
    """The server gave no token."""


@dataclass(frozen=True)
class Nobody:
    def header(self) -> str | None:
        return None


@dataclass(frozen=True)
class Basic:
    user: str
    password: str

    def header(self) -> str:
        return "Basic " + base64.b64encode(f"{self.user}:{self.password}".encode()).decode()


@dataclass(frozen=True)
class Bearer:
    token: str

    def header(self) -> str:
        return f"Bearer {self.token}"


@dataclass(frozen=True)
class Client:
    """Client credentials: a token is fetched once and kept until MARGIN seconds before it ends."""

    token_url: str
    client_id: str
    secret: str
    scope: str = ""
    post: Post = urllib_post
    now: Callable[[], float] = time.time

    def header(self) -> str:
        who = (self.token_url, self.client_id, self.scope)
        token, until = _TOKENS.get(who, ("", 0.0))
        if self.now() >= until:
            form = {"grant_type": "client_credentials", "client_id": self.client_id, "client_secret": self.secret, **({"scope": self.scope} if self.scope else {})}
            status, body = self.post(self.token_url, form)
            answer = json.loads(body) if status < 400 else {}
            if "access_token" not in answer:
                raise AuthError(f"{self.token_url}: no token, HTTP {status}")
            token = answer["access_token"]
            _TOKENS[who] = token, self.now() + float(answer.get("expires_in", LASTS)) - MARGIN
        return f"Bearer {token}"

    def forget(self) -> None:
        """Drop the token, as after an answer that it is not valid."""
        _TOKENS.pop((self.token_url, self.client_id, self.scope), None)


Auth = Nobody | Basic | Bearer | Client


def authorized(transport: Transport, auth: Auth) -> Transport:
    """The transport, with an authorization header on each request; a refused token is fetched anew, once."""

    def send(url: str, headers: dict) -> tuple[int, dict, str]:
        asked = lambda: transport(url, {**headers, **({"Authorization": h} if (h := auth.header()) else {})})
        got = asked()
        if got[0] == 401 and isinstance(auth, Client):
            auth.forget()
            got = asked()
        return got

    return send


@dataclass(frozen=True)
class Server:
    """A public server: address, requests a second, resources a page."""

    base: str
    per_second: float
    count: int


# Public test servers.
SERVERS = {
    "hapi": Server("http://hapi.fhir.org/baseR4", 10.0, 100),
    "synthea": Server("https://syntheticmass.mitre.org/v1/fhir", 5.0, 50),
    "smart_sandbox": Server("https://launch.smarthealthit.org/v/r4/fhir", 10.0, 100),
    "hl7_test": Server("http://test.fhir.org/r4", 5.0, 50),
    "cerner_sandbox": Server("https://fhir-open.cerner.com/r4/ec2458f2-1e24-41c8-b71b-0e701af7583d", 5.0, 50),
    "hapi_stu3": Server("http://hapi.fhir.org/baseDstu3", 10.0, 100),
}
