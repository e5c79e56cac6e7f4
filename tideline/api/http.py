"""A thin HTTP service over an engine, with the routes and response shapes of the Prometheus API."""

from __future__ import annotations

import gzip
import json
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from ..errors import BadQuery, ExecutionError
from ..sources.ingest import Point
from . import metadata
from .engine import Engine
from .format import json_chunks, parse_duration, parse_time

VERSION = "1.0.0"


class Api:
    """Requests to (status, body); no sockets."""

    def __init__(self, engine: Engine, table=None, kinds: dict[str, str] | None = None, timeout_s: float | None = None):
        self.engine, self.table, self.kinds, self.timeout_s = engine, table, kinds or {}, timeout_s
        self.began = time.time()

    def handle(self, path: str, params: dict[str, list[str]], body: bytes = b"") -> tuple[int, str]:
        try:
            return 200, self._route(path, params, body)
        except BadQuery as e:
            return _error(e.status, e.kind, str(e))
        except ExecutionError as e:
            return _error(e.status, e.kind, str(e))
        except KeyError as e:
            return _error(404, "not_found", f"no route {e.args[0]}")
        except Exception as e:  # noqa: BLE001  a request's failure must not end the service
            text = str(e)
            return _error(422, "execution", text.split("\n")[0]) if "USER_RAISED_EXCEPTION" in text else _error(500, "internal", text.split("\n")[0])

    def _route(self, path: str, params: dict[str, list[str]], body: bytes) -> str:
        get = lambda name, default="": params.get(name, [default])[0]
        store = self.engine.store
        if path in ("/-/healthy", "/-/ready"):
            return "OK"
        if not path.startswith("/api/v1/"):
            raise KeyError(path)
        name = path[8:].rstrip("/")
        if name in ("query", "query_range") and not get("query"):
            raise BadQuery("no query")
        if name == "query":
            return self._timed(lambda: "".join(json_chunks(self.engine.query(get("query"), parse_time(get("time"))))))
        if name == "query_range":
            start, end, step = parse_time(get("start")), parse_time(get("end")), parse_duration(get("step"))
            if end < start:
                raise BadQuery("end is before start")
            if step <= 0:
                raise BadQuery("step must be positive")
            return self._timed(lambda: "".join(json_chunks(self.engine.query_range(get("query"), start, end, step))))
        if name == "labels":
            return _ok([r[0] for r in metadata.label_names(store).orderBy("name").collect()])
        if name.startswith("label/") and name.endswith("/values"):
            return _ok([r[0] for r in metadata.label_values(store, unquote(name[6:-7])).orderBy("value").collect()])
        if name == "series":
            found = metadata.series(store, params.get("match[]", []))
            return _ok([{"__name__": r["metric_name"], **(r["labels"] or {})} for r in found.collect()])
        if name == "status/tsdb":
            return _ok(metadata.status(store))
        if name == "metadata":
            return _ok({k: [{"type": v, "help": "", "unit": ""}] for k, v in sorted(self.kinds.items())})
        if name == "status/buildinfo":
            return _ok({"version": VERSION, "application": "tideline"})
        if name == "status/runtimeinfo":
            return _ok({"startTime": self.began, "lookbackMs": self.engine.settings.lookback_ms})
        if name in ("status/config", "status/flags"):
            return _ok({"yaml": ""} if name.endswith("config") else {})
        if name == "write":
            if self.table is None:
                raise BadQuery("this service does not take samples")
            points = [Point(s["labels"], int(t), float(v)) for s in json.loads(body) for t, v in s["samples"]]
            self.table.append(points)
            return _ok({"samples": len(points)})
        raise KeyError(path)

    def _timed(self, run):
        """Run in a job group of its own, cancelled when the time is up."""
        if self.timeout_s is None:
            return run()
        import threading

        context, group = self.engine.spark.sparkContext, uuid.uuid4().hex
        timer = threading.Timer(self.timeout_s, lambda: context.cancelJobGroup(group))
        context.setJobGroup(group, "query", interruptOnCancel=True)
        timer.start()
        try:
            return run()
        finally:
            timer.cancel()


def _ok(data) -> str:
    return json.dumps({"status": "success", "data": data}, ensure_ascii=False)


def _error(status: int, kind: str, message: str) -> tuple[int, str]:
    return status, json.dumps({"status": "error", "errorType": kind, "error": message}, ensure_ascii=False)


def serve(api: Api, host: str = "127.0.0.1", port: int = 9090) -> ThreadingHTTPServer:
    """A server that is ready to serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, body: bytes = b"") -> None:
            url = urlsplit(self.path)
            params = parse_qs(url.query, keep_blank_values=True)
            form = self.headers.get("Content-Type", "").startswith("application/x-www-form-urlencoded")
            if form:
                for k, v in parse_qs(body.decode(), keep_blank_values=True).items():
                    params.setdefault(k, []).extend(v)
            status, text = api.handle(url.path, params, b"" if form else body)
            data = text.encode()
            self.send_response(status)
            if "gzip" in self.headers.get("Accept-Encoding", "") and len(data) > 1024:
                data = gzip.compress(data, 1)
                self.send_header("Content-Encoding", "gzip")
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("X-Request-Id", self.headers.get("X-Request-Id") or uuid.uuid4().hex)
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._answer()

        def do_POST(self) -> None:
            self._answer(self.rfile.read(int(self.headers.get("Content-Length") or 0)))

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
