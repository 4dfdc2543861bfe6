"""A web server for this machine alone: GET and HEAD, JSON answers."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame

from corpusloom.surfaces.service import Service

HEADERS = {"Content-Type": "application/json; charset=utf-8", "Cache-Control": "no-store", "X-Content-Type-Options": "nosniff",
    "Content-Security-Policy": "default-src 'none'"}
FILTERS = ("project", "source_type", "kind", "after", "before")


def answer(service: Service, target: str, curated: DataFrame | None = None) -> tuple[int, dict]:
    """(status, body) of a request's target."""
    parts = urlsplit(target)
    route, asked = unquote(parts.path).rstrip("/"), {k: v[0] for k, v in parse_qs(parts.query).items()}
    try:
        if route == "/api/search":
            if not asked.get("q", "").strip():
                return 400, {"error": "q is missing"}
            limit = int(asked["limit"]) if "limit" in asked else None
            rows = service.search(asked["q"], limit=limit, exact=asked.get("exact") == "1", **{k: asked[k] for k in FILTERS if k in asked})
            return 200, {"query": asked["q"], "results": rows}
        if route == "/api/doc":
            found = service.read(asked.get("path", ""), int(asked["ord"]) if "ord" in asked else None, int(asked.get("context", 2)))
            return (404 if "error" in found else 200), found
        if route == "/api/health":
            return 200, service.health()
        if route == "/api/dashboard" and curated is not None:
            return 200, service.dashboard(curated, asked.get("as_of") or datetime.now(UTC).date().isoformat())
        if route.startswith("/api/project/") and curated is not None:
            name = route.removeprefix("/api/project/")
            if not name or "/" in name or "\\" in name or ".." in name:
                return 404, {"error": "not found"}
            found = service.project(name, curated)
            return (404 if "error" in found else 200), found
    except ValueError as error:
        return 400, {"error": str(error)}
    return 404, {"error": "not found"}


def handler(service: Service, curated: DataFrame | None) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def reply(self, body: bool) -> None:
            host = (self.headers.get("Host") or "").rsplit(":", 1)[0]
            # a page elsewhere must not reach this server under another name
            status, found = answer(service, self.path, curated) if host in ("127.0.0.1", "localhost") else (403, {"error": "forbidden"})
            data = json.dumps(found, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            for k, v in HEADERS.items():
                self.send_header(k, v)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            if body:
                self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            self.reply(True)

        def do_HEAD(self) -> None:  # noqa: N802
            self.reply(False)

        def refused(self) -> None:
            self.send_response(405)
            self.send_header("Allow", "GET, HEAD")
            self.end_headers()

        do_POST = do_PUT = do_DELETE = do_PATCH = do_OPTIONS = refused

        def log_message(self, *_: object) -> None:
            return

    return Handler


def server(service: Service, port: int = 0, curated: DataFrame | None = None) -> HTTPServer:
    return HTTPServer(("127.0.0.1", port), handler(service, curated))


def serve(service: Service, port: int, curated: DataFrame | None = None) -> None:
    server(service, port, curated).serve_forever()
