"""A small HTTP front: POST /api/query, POST /write, GET /api/suggest, GET /points/<metric>, GET /health."""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import parsing
from ..operators import filters
from . import metadata, query


class Service:
    """Answers requests over a DataFrame of points and, where given, of their rollups and the stored
    names; sink and quarantine (functions of a DataFrame) take the points that clients write."""

    def __init__(self, points: DataFrame, rolled: DataFrame | None = None, now=None, names: DataFrame | None = None, sink=None, quarantine=None, shard_tags=("host",)):
        self.points, self.rolled, self.now, self.names = points, rolled, now or (lambda: int(time.time())), names
        self.sink, self.quarantine, self.shard_tags = sink, quarantine, shard_tags

    def answer(self, method: str, target: str, body: str = "") -> tuple[int, str, str]:
        """(status, content type, text). Bad requests are 400, unknown paths 404."""
        url = urlsplit(target)
        args = {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
        try:
            if method == "POST" and url.path == "/api/query":
                return 200, "application/json", self.query(body)
            if method == "POST" and url.path == "/write" and self.sink:
                return 200, "application/json", self.write(body)
            if method == "GET" and url.path == "/api/suggest":
                return 200, "application/json", self.suggest(args)
            if method == "GET" and url.path.startswith("/points/"):
                return 200, "text/plain", self.simple(url.path.removeprefix("/points/"), args)
            if method == "GET" and url.path == "/health":
                return 200, "application/json", self.health(args)
        except (ValueError, KeyError, TypeError) as e:
            return 400, "application/json", json.dumps({"error": str(e)})
        return 404, "application/json", json.dumps({"error": "no such path"})

    def query(self, body: str) -> str:
        request = query.parse(body, self.now())
        out = []
        for q in request.queries:
            result = query.plan(self.points, request, q, self.rolled)
            out += [json.loads(r.json) for r in query.to_json_rows(result, q.metric).orderBy("group").toLocalIterator()]
        return json.dumps(out)

    def write(self, body: str) -> str:
        """JSON points: valid ones go to the sink, others with their error to the quarantine."""
        json.loads(body)
        rows = self.points.sparkSession.createDataFrame([(body,)], "body string")
        found = parsing.checked(parsing.parse_json(rows), self.shard_tags).drop("body").persist()
        valid, bad = parsing.split_valid(found)
        n = {"written": valid.count(), "rejected": bad.count()}
        if n["written"]:
            self.sink(valid.withColumn("value", model.widened(F.col("int_value"), F.col("float_value"))))
        if n["rejected"] and self.quarantine:
            self.quarantine(bad)
        found.unpersist()
        return json.dumps(n)

    def suggest(self, args: dict[str, str]) -> str:
        if args["type"] not in metadata.KINDS:
            raise ValueError(f"the type is one of {', '.join(metadata.KINDS)}")
        names = metadata.suggest(metadata.names(self.points) if self.names is None else self.names, args.get("q", ""), args["type"], int(args.get("max", metadata.LIMIT)))
        return json.dumps([r.name for r in names.collect()])

    def simple(self, metric: str, args: dict[str, str]) -> str:
        request = query.parse_simple(metric, int(args["start"]), int(args["end"]), args.get("attrs", ""), args.get("agrg", ""))
        result = query.plan(self.points, request, request.queries[0])
        return "\n".join(r.text for r in query.to_text_lines(result).orderBy("group", "line").toLocalIterator()) + "\n"

    def health(self, args: dict[str, str]) -> str:
        fixed = filters.from_text(args.get("fixed_attrs", ""))
        row = metadata.health(self.points, args["metric"], fixed, args["count_attr"], self.now(), int(args["time_interval"])).select(F.to_json(F.struct("*")).alias("j")).first()
        return row.j


def serve(service: Service, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server, not yet running: call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method: str) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            status, kind, text = service.answer(method, self.path, body)
            raw = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self):
            self._reply("GET")

        def do_POST(self):
            self._reply("POST")

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
