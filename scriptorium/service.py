"""A small HTTP surface over assessments, reviews and massages."""

from __future__ import annotations

import json
from collections import OrderedDict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock
from typing import Any

from pyspark.sql import SparkSession

from scriptorium import api
from scriptorium.operators import massage
from scriptorium.sources import corpus, profiles
from scriptorium.sources.profiles import Profile

MOST_BODY, MOST_RESULTS = 1 << 20, 256
KINDS = ("assessments", "reviews", "massages")


class Results:
    """What was created, first in first out."""

    def __init__(self, most: int = MOST_RESULTS) -> None:
        self.rows: OrderedDict[tuple[str, int], dict] = OrderedDict()
        self.most, self.last, self.lock = most, 0, Lock()

    def add(self, kind: str, value: dict) -> int:
        with self.lock:
            self.last += 1
            self.rows[kind, self.last] = value
            while len(self.rows) > self.most:
                self.rows.popitem(last=False)
            return self.last

    def get(self, kind: str, n: int) -> dict | None:
        with self.lock:
            return self.rows.get((kind, n))


class Service:
    """Routes to (status, headers, body). ``reviser`` is needed for massages."""

    def __init__(self, spark: SparkSession, known: dict[str, Profile], reviser: massage.Reviser | None = None) -> None:
        self.spark, self.known, self.reviser, self.results = spark, known, reviser, Results()

    def links(self, p: Profile) -> dict[str, str]:
        kinds = KINDS if self.reviser else KINDS[:2]
        return {"self": f"/profiles/{p.id}"} | {k: f"/profiles/{p.id}/{k}" for k in kinds}

    def answer(self, method: str, path: str, body: bytes = b"") -> tuple[int, dict[str, str], dict]:
        error = lambda code, why: (code, {}, {"error": why, "links": {"root": "/", "profiles": "/profiles"}})
        parts = [x for x in path.split("/") if x]
        if method == "GET":
            if not parts:
                return 200, {}, {"links": {"self": "/", "profiles": "/profiles"}}
            if parts == ["profiles"]:
                return 200, {}, {"profiles": [{"id": p.id, "register": p.register, "links": self.links(p)} for p in self.known.values()]}
            if len(parts) == 2 and parts[0] == "profiles" and parts[1] in self.known:
                p = self.known[parts[1]]
                return 200, {}, profiles.to_dict(p) | {"links": self.links(p)}
            if len(parts) == 2 and parts[0] in KINDS and parts[1].isdigit() and (found := self.results.get(parts[0], int(parts[1]))):
                return 200, {}, found
            return error(404, "there is nothing here")
        if method != "POST" or len(parts) != 3 or parts[0] != "profiles" or parts[2] not in KINDS:
            return error(405 if method not in ("GET", "POST") else 404, "there is nothing here")
        if parts[1] not in self.known:
            return error(404, f"no profile {parts[1]!r}")
        if parts[2] == "massages" and self.reviser is None:
            return error(405, "no reviser is configured")
        try:
            text = json.loads(body[: MOST_BODY + 1]).get("text", "") if len(body) <= MOST_BODY else ""
        except (ValueError, AttributeError):
            text = ""
        if not isinstance(text, str) or not text.strip():
            return error(400, "a JSON body with text is needed, of 1 MiB at most")
        p = self.known[parts[1]]
        made = {"assessments": api.check, "reviews": api.review, "massages": self.massage}[parts[2]](self.spark, text, p)
        n = self.results.add(parts[2], made | {"links": {"profile": f"/profiles/{p.id}"}})
        return 201, {"Location": f"/{parts[2]}/{n}"}, self.results.get(parts[2], n) or made

    def massage(self, spark: SparkSession, text: str, p: Profile) -> dict[str, Any]:
        t = profiles.tables(spark, [p])
        tables = massage.Profile(t["features"].drop("profile_id"), t["stats"].select("documents", "words"), t["rules"].select("rule_id", "param", "severity", "statement"), tuple(p.avoided), (p.discriminator or {}).get("threshold"))
        outcome, steps = massage.massage(corpus.one_draft(spark, text), tables, self.reviser)
        final = outcome.first()
        return {"final": final.text, "accepted": final.accepted, "revisions": final.revisions, "trajectory": [r.asDict() for r in steps.orderBy("revision").collect()]}


def serve(spark: SparkSession, known: dict[str, Profile], port: int, reviser: massage.Reviser | None = None) -> None:
    service = Service(spark, known, reviser)

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, headers, body = service.answer(self.command, self.path.split("?")[0], self.rfile.read(min(size, MOST_BODY + 1)))
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            for k, v in (headers | {"Content-Type": "application/json", "Content-Length": str(len(data))}).items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = _do

    ThreadingHTTPServer(("127.0.0.1", port), Handler).serve_forever()
