"""The pipeline behind HTTP: one loaded system, checked requests, limits for visitors."""

from __future__ import annotations

import json
import mimetypes
import os
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pramana.operators import pipeline
from pramana.operators.serving import Limits, validate_request
from pramana.sources.providers import ProviderError

#: Sent with every response.
HEADERS = {"X-Content-Type-Options": "nosniff", "Referrer-Policy": "strict-origin-when-cross-origin", "Content-Security-Policy": "default-src 'self'"}
MOST_BYTES = 10_000


@dataclass
class System:
    """Passages, what there is to search them with, and generators by name (see pipeline.answer); the first is the default, None the extractive one."""

    passages: DataFrame
    retrievers: pipeline.Retrievers
    generators: dict[str, Callable | None] = field(default_factory=lambda: {"extractive": None})
    notes: list[str] = field(default_factory=list)
    hosted: frozenset[str] = frozenset()

    def ask(self, body: str) -> tuple[int, dict]:
        """(status, object) for a JSON request: 400 with an error for what isn't right in it, 502 where the generator can't be asked."""
        spark = self.passages.sparkSession
        r = spark.createDataFrame([(body,)], "body string").select(validate_request(F.col("body"), list(self.generators)).alias("r")).first()["r"]
        if r["status"] != 200:
            return r["status"], {"error": r["error"]}
        given = json.loads(body)
        asked = spark.createDataFrame([("q", r["query"])], "id string, question string")
        floor = max(0.0, float(given.get("bm25_floor") or 0.0))
        try:
            got = pipeline.answer(asked, self.passages, self.retrievers, method=r["method"], k=r["k"], bm25_floor=floor, provider=self.generators[given.get("generator") or next(iter(self.generators))]).drop("qid").first()
        except ProviderError as e:
            return 502, {"error": str(e)}
        return 200, {"query": r["query"], **got.asDict(recursive=True)}


def load_system(passages: DataFrame, *, lexical=None, vectors: DataFrame | None = None, encode: Callable | None = None, generators: dict[str, Callable | None] | None = None) -> System:
    """A system over ``passages``; without vectors it says so and searches by words."""
    from pramana.operators.lexical import LexicalIndex

    ready = vectors is not None and encode is not None
    r = pipeline.Retrievers(lexical or LexicalIndex(passages), vectors, encode, pipeline.passage_scripts(passages))
    return System(passages, r, generators or {"extractive": None}, [] if ready else ["no vectors: hybrid methods search by words"])


class Gate:
    """Limits kept in memory for one server; visitors without requests for a day are forgotten."""

    def __init__(self, limits: Limits | None = None, clock: Callable[[], float] = time.time):
        self.limits, self.clock, self.lock = limits or Limits(), clock, threading.Lock()
        self.accepted: dict[str, list[float]] = {}
        self.hosted: list[float] = []

    def decide(self, visitor: str, hosted: bool) -> str:
        now = self.clock()
        with self.lock:
            if len(self.accepted) > 10_000:
                self.accepted = {v: t for v, t in self.accepted.items() if t and now - t[-1] <= 86400}
            return self.limits.decide(self.accepted.setdefault(visitor, []), now, self.hosted if hosted else None)


def make_handler(system: System, web_dir: str, *, gate: Gate | None = None, behind_proxy: bool = False) -> type[BaseHTTPRequestHandler]:
    """A handler of GET /api/health, POST /api/ask and the files under ``web_dir``. Questions are never written to the log."""
    root, gate, one = os.path.realpath(web_dir), gate or Gate(), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, body: bytes, kind: str = "application/json; charset=utf-8") -> None:
            self.send_response(status)
            for k, v in {"Content-Type": kind, "Content-Length": str(len(body)), "Cache-Control": "no-store", **HEADERS}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def reply_json(self, status: int, value) -> None:
            self.reply(status, json.dumps(value, ensure_ascii=False).encode())

        def visitor(self) -> str:
            said = self.headers.get("X-Forwarded-For", "").split(",")[0].strip() if behind_proxy else ""
            return said or self.client_address[0]

        def do_GET(self) -> None:  # noqa: N802
            path = self.path.split("?", 1)[0]
            if path == "/api/health":
                return self.reply_json(200, {"ok": True, "generators": list(system.generators), "notes": system.notes})
            target = os.path.realpath(os.path.join(root, path.lstrip("/") or "index.html"))
            if not target.startswith(root + os.sep) or not os.path.isfile(target):
                return self.reply(404, b"not found", "text/plain; charset=utf-8")
            with open(target, "rb") as f:
                return self.reply(200, f.read(), mimetypes.guess_type(target)[0] or "application/octet-stream")

        def do_POST(self) -> None:  # noqa: N802
            if self.path.split("?", 1)[0] != "/api/ask":
                return self.reply_json(404, {"error": "not found"})
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BYTES:
                return self.reply_json(413, {"error": "request too large"})
            try:
                body = self.rfile.read(size).decode()
                value = json.loads(body or "{}")
            except ValueError:
                return self.reply_json(400, {"error": "body is not JSON"})
            asked = value.get("generator") if isinstance(value, dict) else None
            decision = gate.decide(self.visitor(), (asked or next(iter(system.generators))) in system.hosted)
            if decision != "ok":
                return self.reply_json(429, {"error": {"minute": "too many questions a minute", "day": "too many questions a day", "budget": "the hosted model's budget of the day is used up"}[decision]})
            with one:
                return self.reply_json(*system.ask(body))

        def log_message(self, form: str, *args) -> None:
            print(self.command, self.path.split("?", 1)[0], args[1] if len(args) > 1 else "", flush=True)

    return Handler
