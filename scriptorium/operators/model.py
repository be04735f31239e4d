"""A client of a language model's HTTP interface, for revisers and judges: one request a draft, the transport injectable."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from .prompts import JUDGE_HEAD, revision_prompt

#: (address, headers, body) to (status, body).
Transport = Callable[[str, dict[str, str], bytes], tuple[int, bytes]]
REVISE = "You revise drafts. Answer with the revised draft alone."
JUDGE = "You judge drafts by rules. Answer with the list alone."


def truncated_bytes(data: bytes, n: int) -> str:
    """At most ``n`` bytes of UTF-8, a character that the cut would split left out; dots where something is missing."""
    return data.decode("utf-8", "replace") if len(data) <= n else data[:n].decode("utf-8", "ignore") + "..."


def http(address: str, headers: dict[str, str], body: bytes) -> tuple[int, bytes]:
    request = urllib.request.Request(address, data=body, headers=headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=300) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as refused:
        return refused.code, refused.read()


@dataclass
class Client:
    """``base`` is the interface's address; ``headers`` go with every request beside the key. Clients are sent to executors,
    so a transport must be picklable."""

    key: str
    model: str
    base: str
    most_tokens: int = 4096
    transport: Transport = http
    headers: dict[str, str] = field(default_factory=dict)

    def complete(self, system: str, user: str) -> str:
        """The answer's text. RuntimeError without a key, for a status that isn't 2xx, and for an answer cut off at the
        token limit, which must not pass for a whole one."""
        if not self.key:
            raise RuntimeError("no key is configured")
        most = self.most_tokens if self.most_tokens > 0 else 4096
        body = {"model": self.model, "max_tokens": most, "system": system, "messages": [{"role": "user", "content": user}]}
        status, raw = self.transport(self.base.rstrip("/") + "/v1/messages", {"content-type": "application/json", "x-api-key": self.key} | self.headers, json.dumps(body).encode())
        if not 200 <= status < 300:
            raise RuntimeError(f"the model answered {status}: {truncated_bytes(raw, 500)}")
        try:
            answer = json.loads(raw)
            parts = [b["text"] for b in answer.get("content", []) if b.get("type") == "text"]
        except (ValueError, AttributeError, KeyError, TypeError) as e:
            raise RuntimeError("the model's answer can't be read") from e
        if answer.get("stop_reason") == "max_tokens":
            raise RuntimeError(f"the answer was cut off at {most} tokens")
        return "".join(parts)

    def revise(self, draft: str, brief: dict[str, Any]) -> str:
        return self.complete(REVISE, revision_prompt(draft, brief))

    def judge(self, draft: str, rules: list[dict[str, Any]]) -> list[dict[str, Any]]:
        """Verdicts on judged rules (none, none asked for); RuntimeError where the answer holds no list of them."""
        if not rules:
            return []
        lines = "".join(f"- [{r['rule_id']}] {r['statement']}\n" for r in rules)
        reply = self.complete(JUDGE, f"{JUDGE_HEAD}{lines}\n--- draft ---\n{draft.strip()}\n--- end of draft ---\n")
        found = re.search(r"\[.*\]", reply, re.DOTALL)
        try:
            verdicts = json.loads(found[0]) if found else None
        except ValueError:
            verdicts = None
        if not isinstance(verdicts, list):
            raise RuntimeError("the judge's answer holds no list of verdicts")
        return [v for v in verdicts if isinstance(v, dict) and {"id", "holds"} <= set(v)]
