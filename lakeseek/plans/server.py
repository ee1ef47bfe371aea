"""The engine over HTTP, with the standard library's server: list and describe indexes, query, index with a stream of events.

GET  /                      a small page
GET  /api/indexes           all indexes
GET  /api/indexes/<name>    one, with its versions
POST /api/query             {"index", "query", "top_k" 1..100, "code_only", "version"}
POST /api/index             {"path" or "zip" (base64), "name", "versions": "last 3" or "v1, v2", "source_only"}; answers JSON lines: log, progress, done or error

One indexing job runs at a time; another gets 409. Sessions are opened once per index and refreshed per query.
"""

from __future__ import annotations

import base64
import itertools
import json
import os
import queue
import re
import tempfile
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lakeseek.plans import session as api
from lakeseek.plans import store
from lakeseek.sources.datasets import unpack_zip

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,99}")
MOST_RESULTS = 100
PAGE = """<!doctype html><meta charset="utf-8"><title>lakeseek</title><form onsubmit="ask(event)"><select id="i"></select> <input id="q" size="60"> <button>Search</button></form><div id="r"></div>
<script>
const el = id => document.getElementById(id);
fetch('/api/indexes').then(r => r.json()).then(all => all.forEach(x => el('i').add(new Option(x.name))));
async function ask(e) {
  e.preventDefault();
  const r = await fetch('/api/query', {method: 'POST', body: JSON.stringify({index: el('i').value, query: el('q').value})});
  const out = await r.json();
  el('r').replaceChildren(...(out.results || []).map(d => {
    const box = document.createElement('section'), head = document.createElement('h4'), pre = document.createElement('pre');
    head.textContent = `${d.rank}. ${d.doc_id}  ${d.score.toFixed(4)}`;
    d.hits.forEach(h => {
      const version = document.createElement('b');
      version.textContent = (h.versions || []).join(' ') + '\\n';
      pre.append(version);
      const from = h.start_line || 1, marked = new Set(h.match_lines || []);
      ((h.snippet || {}).text || (h.snippet || {}).status || '').split('\\n').forEach((line, k) => {
        const row = document.createElement(marked.has(from + k) ? 'mark' : 'span');
        row.textContent = line + '\\n';
        pre.append(row);
      });
    });
    box.append(head, pre);
    return box;
  }));
}
</script>"""


class HttpError(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def parse_versions(text: str) -> tuple[list[str] | None, int | None]:
    """("v1, v2" as a list, or "last 3" or "3" as a number)."""
    words = text.replace(",", " ").split()
    if not words:
        raise ValueError("no versions are named")
    if len(words) == 2 and words[0].lower() == "last" and words[1].isdigit():
        return None, int(words[1])
    if len(words) == 1 and words[0].isdigit() and len(words[0]) < 4:
        return None, int(words[0])
    return words, None


def grouped(rows: list[dict]) -> list[dict]:
    """Result rows by document, each with its hits: one for a folder, one per revision for versions."""
    out: list[dict] = []
    for r in rows:
        doc = r.get("path") or r["doc_id"]
        if not out or out[-1]["doc_id"] != doc:
            out.append({"doc_id": doc, "rank": r["rank"], "score": round(r["score"], 6), "hits": []})
        keys = ("revision_id", "versions", "start_line", "end_line", "snippet", "focus_line", "match_lines", "contains_match", "match_line")
        out[-1]["hits"].append({k: r[k] for k in keys if k in r} | {"score": round(r["score"], 6), "version": (r.get("versions") or [None])[-1]})
    return out


class Service:
    def __init__(self, spark: SparkSession, base: str, encoder=None, chunking=None):
        self.spark, self.base, self.encoder, self.chunking = spark, os.path.abspath(base), encoder, chunking
        self.sessions: dict[str, api.Session] = {}
        self.opening, self.job = threading.Lock(), threading.Lock()

    def root(self, name: str) -> str:
        if not NAME.fullmatch(name or ""):
            raise HttpError(400, "an index's name has letters, digits, dots, dashes and underscores")
        return os.path.join(self.base, name)

    def list(self) -> list[dict]:
        names = sorted(os.listdir(self.base)) if os.path.isdir(self.base) else []
        roots = [os.path.join(self.base, n) for n in names]
        return [{"name": os.path.basename(r.root)} | r.asDict() for r in store.describe(self.spark, roots).collect()]

    def one(self, name: str) -> dict:
        found = store.describe(self.spark, [self.root(name)]).collect()
        if not found:
            raise HttpError(404, f"no index {name}")
        out = {"name": name} | found[0].asDict()
        if out["versions"]:
            commits = self.session(name).tables["commits"].orderBy(F.desc("ordinal"))
            out["commits"] = [{"sha": r.sha, "label": (r.tags or [r.short])[0], "date": r.date[:10], "subject": r.subject} for r in commits.collect()]
        return out

    def session(self, name: str) -> api.Session:
        root = self.root(name)
        with self.opening:
            if name not in self.sessions:
                try:
                    self.sessions[name] = api.Session(self.spark, root, self.encoder)
                except FileNotFoundError as error:
                    raise HttpError(404, str(error)) from error
            else:
                self.sessions[name].refresh()
            return self.sessions[name]

    def query(self, body: dict) -> dict:
        text, k = body.get("query"), body.get("top_k", 10)
        if not isinstance(text, str) or not text.strip():
            raise HttpError(422, "the query is empty")
        if not isinstance(k, int) or not 1 <= k <= MOST_RESULTS:
            raise HttpError(422, f"top_k is 1 to {MOST_RESULTS}")
        try:
            rows = self.session(body.get("index", "")).query(text, k, body.get("version"), bool(body.get("code_only")))
        except ValueError as error:
            raise HttpError(400, str(error)) from error
        return {"results": grouped([json.loads(x) for x in rows.toJSON().collect()])}

    def index(self, body: dict):
        """Events of an indexing job, as they come."""
        if not self.job.acquire(blocking=False):
            raise HttpError(409, "an indexing job is running")
        events: queue.Queue = queue.Queue()

        def run():
            try:
                if body.get("zip"):
                    name = body.get("name") or "upload"
                    with tempfile.NamedTemporaryFile(suffix=".zip") as file:
                        file.write(base64.b64decode(body["zip"]))
                        file.flush()
                        path = unpack_zip(file.name, os.path.join(self.base, ".sources", os.path.basename(self.root(name))))
                else:
                    path = body.get("path") or ""
                    name = body.get("name") or os.path.basename(api.default_root(path))
                if not os.path.isdir(path):
                    raise ValueError(f"{path!r} is no folder")
                events.put({"event": "log", "message": f"indexing {path}"})
                options = {"root": self.root(name), "chunking": self.chunking, "encoder": self.encoder, "source_only": bool(body.get("source_only"))}
                if body.get("versions"):
                    revisions, last = parse_versions(body["versions"])
                    done = api.index_versions(self.spark, path, revisions, last, **options)
                else:
                    done = api.index_folder(self.spark, path, rebuild=bool(body.get("rebuild")), **options)
                events.put({"event": "done", "index": name, "stats": done["stats"]})
            except Exception as error:  # noqa: BLE001  told to the caller
                events.put({"event": "error", "message": str(error)[:500]})
            finally:
                self.job.release()
                events.put(None)

        threading.Thread(target=run, daemon=True).start()
        began = time.time()
        while True:
            try:
                event = events.get(timeout=0.5)
            except queue.Empty:
                tracker = self.spark.sparkContext.statusTracker()
                stages = [s for s in (tracker.getStageInfo(i) for i in tracker.getActiveStageIds()) if s]
                yield {"event": "progress", "done": sum(s.numCompletedTasks for s in stages), "total": sum(s.numTasks for s in stages), "seconds": round(time.time() - began, 1)}
                continue
            if event is None:
                return
            yield event


def handler(service: Service):
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def send(self, status: int, data: bytes, kind: str = "application/json"):
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def answer(self, work):
            try:
                self.send(200, json.dumps(work()).encode())
            except HttpError as error:
                self.send(error.status, json.dumps({"detail": str(error)}).encode())
            except Exception as error:  # noqa: BLE001
                self.send(500, json.dumps({"detail": str(error)[:500]}).encode())

        def do_GET(self):
            parts = self.path.split("?")[0].strip("/").split("/")
            if parts == [""]:
                self.send(200, PAGE.encode(), "text/html; charset=utf-8")
            elif parts == ["api", "indexes"]:
                self.answer(service.list)
            elif parts[:2] == ["api", "indexes"] and len(parts) == 3:
                self.answer(lambda: service.one(parts[2]))
            else:
                self.send(404, b'{"detail": "not found"}')

        def do_POST(self):
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
            except ValueError:
                return self.send(400, b'{"detail": "the body is no JSON"}')
            if self.path == "/api/query":
                return self.answer(lambda: service.query(body))
            if self.path != "/api/index":
                return self.send(404, b'{"detail": "not found"}')
            try:
                stream = service.index(body)
                first = next(stream)
            except HttpError as error:
                return self.send(error.status, json.dumps({"detail": str(error)}).encode())
            self.send_response(200)
            self.send_header("Content-Type", "application/x-ndjson")
            self.end_headers()
            for event in itertools.chain([first], stream):
                self.wfile.write(json.dumps(event).encode() + b"\n")
                self.wfile.flush()

    return Handler


def serve(spark: SparkSession, base: str = "indexes", port: int = 8765, **options) -> ThreadingHTTPServer:
    """A server on localhost, not yet running."""
    return ThreadingHTTPServer(("127.0.0.1", port), handler(Service(spark, base, **options)))


if __name__ == "__main__":
    serve(SparkSession.builder.appName("lakeseek-server").getOrCreate()).serve_forever()
