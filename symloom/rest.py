"""The service over HTTP: GET requests, answers in JSON.

    /api/v1/functions/NAME/{source,info,references,callers,callees}   /api/v1/search?q=TERM&limit=N&labels=A,B
    /api/v1/search/functions?q=TERM                                   /api/v1/health
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from symloom.service import NotFound, Service

# The paths of the interface.
ROOT = "/api/v1/"


def answer(service: Service, address: str) -> tuple[int, object]:
    """(status, value) of a GET request's address."""
    parts = urlsplit(address)
    asked = {k: v[-1] for k, v in parse_qs(parts.query).items()}
    if not parts.path.startswith(ROOT):
        return 404, {"error": "no such path"}
    steps = [unquote(s) for s in parts.path[len(ROOT) :].strip("/").split("/")]
    try:
        limit = int(asked.get("limit", 0))
        match steps:
            case ["health"]:
                return 200, {"status": "ok", "nodes": service.status()}
            case ["search"]:
                return 200, service.search(asked.get("q", ""), [x for x in asked.get("labels", "").split(",") if x], limit)
            case ["search", "functions"]:
                return 200, service.search(asked.get("q", ""), ["Function", "Method"], limit)
            case ["functions", name, "source"]:
                return 200, service.source(name=name)
            case ["functions", name, "info"]:
                return 200, service.analyze(name)
            case ["functions", name, "callers" | "callees" as side]:
                return 200, service.near(name, side, limit)
            case ["functions", name, "references"]:
                return 200, service.near(name, "callers", limit)
        return 404, {"error": "no such path"}
    except NotFound as problem:
        return 404, {"error": str(problem)}
    except ValueError as problem:
        return 400, {"error": str(problem)}


def server(service: Service, port: int = 8080) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, value = answer(service, self.path)
            body = json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
