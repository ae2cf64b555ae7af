"""A small HTTP surface on the driver: an inspector page, /health, /metrics, /events, /events/ID, and POST /api/parse."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession

from millrace.config import Config
from millrace.operators import serialize
from millrace.plans import pipeline
from millrace.sources import readers


#: The inspector: the latest events, one of them in full, and a box to parse a message of one's own.
PAGE = """<!doctype html><meta charset="utf-8"><title>millrace</title>
<style>body{font:14px sans-serif;margin:2em}td,th{padding:2px 12px 2px 0;text-align:left}tr{cursor:pointer}pre{background:#f4f4f4;padding:1em;white-space:pre-wrap}textarea{width:100%}</style>
<h1>Events</h1><textarea id="m" rows="3" placeholder="a message"></textarea><button id="p">Parse</button>
<table><thead><tr><th>id<th>format<th>source<th>vendor<th>parser<th>status</thead><tbody id="t"></tbody></table><pre id="e"></pre>
<script>
const $ = x => document.getElementById(x), show = e => { $("e").textContent = JSON.stringify(e, null, 2) };
$("p").onclick = async () => show(await (await fetch("/api/parse", {method: "POST", body: $("m").value})).json());
fetch("/events?limit=100").then(r => r.json()).then(rows => rows.forEach(e => {
  const tr = $("t").insertRow();
  [e.ingestion.event_id.slice(0, 8), e.parser.format_detected, e.source.status, e.source.vendor, e.parser.name, e.parser.status].forEach(v => { tr.insertCell().textContent = v ?? "-" });
  tr.onclick = () => show(e);
}));
</script>"""


def server(spark: SparkSession, events: Callable[[], DataFrame], cfg: Config = Config(), host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server over the events that a call of events() gives (a table that streams write, say). The caller starts and stops it."""

    class Handler(BaseHTTPRequestHandler):
        def _say(self, code: int, body: object) -> None:
            page = isinstance(body, str)
            data = body.encode() if page else json.dumps(body, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", f"{'text/html' if page else 'application/json'}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _docs(self, df: DataFrame) -> list:
            return [json.loads(r[0]) for r in df.select(serialize.spool_json()).collect()]

        def do_GET(self) -> None:
            path, _, query = self.path.partition("?")
            if path == "/":
                self._say(200, PAGE)
            elif path == "/health":
                self._say(200, {"status": "ok"})
            elif path == "/metrics":
                self._say(200, {r["name"]: r["value"] for r in pipeline.metrics(events()).collect()})
            elif path == "/events":
                n = re.search(r"(?:^|&)limit=(\d{1,6})(?:&|$)", query)
                self._say(200, self._docs(pipeline.recent(events(), int(n[1]) if n else 100)))
            elif path.startswith("/events/"):
                found = self._docs(pipeline.event_by_id(events(), path[8:]))
                self._say(200 if found else 404, found[0] if found else {"error": "no such event"})
            else:
                self._say(404, {"error": "no such path"})

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if self.path != "/api/parse":
                self._say(404, {"error": "no such path"})
            elif size > 4 * cfg.limits.max_message_bytes:
                self._say(413, {"error": "too long"})
            else:
                text = self.rfile.read(size).decode("utf-8", "replace")
                self._say(200, self._docs(pipeline.parse_events(readers.inline(spark, text, transport="api"), cfg))[0])

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
