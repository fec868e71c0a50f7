"""A read-only HTTP facade: status, timeline, one change, revert script.

``Api.respond`` is the whole behaviour and needs no socket; ``serve`` puts it on one.
"""

from __future__ import annotations

import hmac
import ipaddress
import json
from collections.abc import Callable, Iterable
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from .functions.moments import filter_from, split_list, whole_number
from .functions.predicates import BadRequest, Refused
from .operators.normalise import mark_read_only
from .operators.timeline import one, page
from .plans.script import script_lines
from .plans.status import as_dict
from .plans.store import ChangeStore

JSON, TEXT = "application/json", "text/plain; charset=utf-8"
Response = tuple[int, dict[str, str], Iterable[str]]


class Api:
    def __init__(self, store: ChangeStore, label: str, *, token: str | None = None, clock: Callable[[], datetime] = lambda: datetime.now(UTC)):
        if token is not None and not token:
            raise ValueError("an empty token protects nothing")
        self.store, self.label, self.token, self.clock = store, label, token, clock

    def respond(self, method: str, target: str, authorization: str = "") -> Response:
        if self.token is not None and not hmac.compare_digest(authorization.encode(), f"Bearer {self.token}".encode()):
            return self._json(401, {"error": "a valid bearer token is required"}, {"WWW-Authenticate": "Bearer"})
        parts = urlsplit(target)
        parameters = dict(reversed(parse_qsl(parts.query, keep_blank_values=True)))
        route = self._route(parts.path)
        if route is None:
            return self._json(404, {"error": f"there is nothing at {parts.path}"})
        if method not in ("GET", "HEAD"):
            return self._json(405, {"error": f"{method} is not allowed here"}, {"Allow": "GET, HEAD"})
        try:
            status, headers, body = route(parameters)
        except BadRequest as e:
            return self._json(400, {"error": str(e)})
        return status, headers, body if method == "GET" else ()

    def _route(self, path: str):
        if path == "/api/status":
            return self._status
        if path == "/api/changes":
            return self._changes
        if path == "/api/revert.sql":
            return self._revert
        if path.startswith("/api/changes/") and "/" not in path[len("/api/changes/") :]:
            return lambda _: self._change(path[len("/api/changes/") :])
        return None

    @staticmethod
    def _json(status: int, body: dict, headers: dict | None = None) -> Response:
        return status, {"Content-Type": JSON, **(headers or {})}, [json.dumps(body, ensure_ascii=False)]

    def _status(self, _: dict) -> Response:
        return self._json(200, as_dict(self.label, self.store.snapshot().status(self.clock())))

    def _changes(self, p: dict) -> Response:
        f, limit, before = filter_from(p, self.clock()), whole_number(p.get("limit"), "limit"), whole_number(p.get("before"), "before")
        try:
            return self._json(200, page(self.store.snapshot(), f, before, limit, self.clock()))
        except Refused as e:
            return self._json(409, {"error": str(e)})

    def _change(self, raw: str) -> Response:
        if not raw:
            raise BadRequest("id: '' is not a number")
        number = whole_number(raw, "id")
        try:
            found = one(self.store.snapshot(), number)
        except Refused as e:
            return self._json(500, {"error": str(e)})
        return self._json(200, found) if found else self._json(404, {"error": f"no change {number} in this store"})

    def _revert(self, p: dict) -> Response:
        """The gate and the search for refusals come before the status line."""
        f = filter_from(p, self.clock())
        snapshot = self.store.snapshot()
        try:
            snapshot.gate(f, self.clock())
            changes = mark_read_only(snapshot.changes(f), split_list(p.get("generated")))
            lines = script_lines(changes, self.label, f)
            first = next(lines)
        except Refused as e:
            return self._json(409, {"error": str(e)})

        def body():
            yield first + "\n"
            try:
                for line in lines:
                    yield line + "\n"
            except Exception as e:  # the status line is gone; say it in the file
                yield f"\n-- ERROR: this script is incomplete and must not be run: {e}\n"

        return 200, {"Content-Type": TEXT, "Content-Disposition": 'attachment; filename="revert.sql"'}, body()


def is_loopback(host: str) -> bool:
    """Only addresses that are certainly local; an empty host or a name is not."""
    if host == "localhost":
        return True
    try:
        return ipaddress.ip_address(host).is_loopback
    except ValueError:
        return False


def serve(api: Api, host: str, port: int) -> ThreadingHTTPServer:
    """A server ready to run; beyond this machine only with a token."""
    if not is_loopback(host) and api.token is None:
        raise Refused(f"listening on {host or 'every address'} needs a token")

    class Handler(BaseHTTPRequestHandler):
        def _any(self):
            status, headers, body = api.respond(self.command, self.path, self.headers.get("Authorization", ""))
            self.send_response(status)
            for name, value in headers.items():
                self.send_header(name, value)
            self.end_headers()
            for part in body:
                self.wfile.write(part.encode("utf-8"))

        do_GET = do_HEAD = do_POST = do_PUT = do_DELETE = do_PATCH = _any

    return ThreadingHTTPServer((host, port), Handler)
