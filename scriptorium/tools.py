"""Tool functions for calling programs: a dictionary of arguments to a dictionary of plain results."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium import api
from scriptorium.operators import distill as dst
from scriptorium.sources import baseline, corpus, profiles
from scriptorium.sources.profiles import Profile


def comma_list(text: str) -> tuple[str, ...]:
    """A comma-separated list, trimmed, without empty entries."""
    return tuple(x.strip() for x in text.split(",") if x.strip())


def documents(spark: SparkSession, folder: str, register: str = "") -> DataFrame:
    return corpus.read_corpus(spark, folder, register).select(F.col("doc_name").alias("doc_id"), "text")


def word_base(spark: SparkSession, path: str | None, docs: DataFrame) -> DataFrame:
    """The table of general prose at ``path``, else the corpus' own."""
    if path:
        return baseline.load(spark, path)
    return baseline.word_table(docs, 20_000).select(F.col("word").alias("term"), F.col("n").alias("base"))


@dataclass
class Tools:
    """``folder`` is where profiles are looked up by name; a path given explicitly goes before a name."""

    spark: SparkSession
    folder: str = ""
    word_table: str | None = None

    def profile(self, a: dict[str, Any]) -> Profile:
        return profiles.load(a["profile_path"]) if a.get("profile_path") else profiles.find(self.folder, a.get("profile", ""))

    def list_profiles(self, _: dict[str, Any]) -> dict[str, Any]:
        if not self.folder:
            return {"profiles_dir": "", "profiles": [], "note": "no folder of profiles is configured: give profile_path"}
        found = [{"id": p.id, "register": p.register, "language": p.language, "calibrated": p.discriminator is not None, "path": path} for path, p in profiles.listing(self.folder)]
        return {"profiles_dir": self.folder, "profiles": found} | ({} if found else {"note": f"no profiles in {self.folder}"})

    def _docs(self, folder: str, register: str = "") -> DataFrame:
        docs = documents(self.spark, folder, register)
        if docs.isEmpty():
            raise ValueError(f"no documents in {folder}")
        return docs

    def _finished(self, made: api.Outcome, a: dict[str, Any]) -> dict[str, Any]:
        path = a.get("out") or f"{made.profile.id}.profile.yaml"
        profiles.save(made.profile, path)
        return {"profile_path": path, "deterministic_rules": made.deterministic_rules}

    def _options(self, a: dict[str, Any]) -> dict[str, Any]:
        return {"id": a.get("id", ""), "language": a.get("language", ""), "options": dst.Options(avoid=comma_list(a.get("avoid", "")))}

    def distill(self, a: dict[str, Any]) -> dict[str, Any]:
        if not a.get("corpus_dir") or not a.get("register"):
            raise ValueError("distill needs corpus_dir and register")
        docs = self._docs(a["corpus_dir"], a["register"])
        made = api.distill(docs, a["register"], word_base(self.spark, self.word_table, docs), base=a.get("base", ""), rules_file=a.get("rules_file", ""), **self._options(a))
        p = made.profile
        counts = {"documents": p.documents, "words": p.words, "features": len(p.features), "lexicon_terms": len(p.preferred), "judged_rules": made.judged_rules}
        return self._finished(made, a) | counts | ({"note": "; ".join(made.warnings)} if made.warnings else {})

    def calibrate(self, a: dict[str, Any]) -> dict[str, Any]:
        if not a.get("target_dir") or not a.get("decoys_dir") or not a.get("register"):
            raise ValueError("calibrate needs target_dir, decoys_dir and register")
        docs, decoys = self._docs(a["target_dir"], a["register"]), self._docs(a["decoys_dir"])
        made = api.calibrate(docs, decoys, a["register"], word_base(self.spark, self.word_table, docs), a.get("holdout_every") or 4, a.get("base", ""), **self._options(a))
        found = made.calibration or {}
        kept = {k: found[k] for k in ("threshold", "auc", "tpr", "fpr", "accuracy", "separates", "train", "target_holdout", "decoys")}
        return self._finished(made, a) | kept | ({"warning": "; ".join(made.warnings)} if made.warnings else {})

    def retrieve(self, a: dict[str, Any]) -> dict[str, Any]:
        if not a.get("corpus_dir"):
            raise ValueError("retrieve needs corpus_dir and query")
        bank = api.Bank.of(self._docs(a["corpus_dir"]), min_words=a.get("min_words") or 0)
        rows = bank.passages(a.get("query", ""), a.get("k") or 3).orderBy("rank").collect()
        return {"exemplars": [{"score": r.score, "source": r.source, "index": r.para, "text": r.chunk} for r in rows]}

    def score(self, a: dict[str, Any]) -> dict[str, Any]:
        found = api.check(self.spark, a.get("text", ""), self.profile(a))
        return {k: v for k, v in found.items() if k != "rules"} | {"rule_violations": found["rules"]}

    def style_review(self, a: dict[str, Any]) -> dict[str, Any]:
        found = api.review(self.spark, a.get("text", ""), self.profile(a))
        return found | {"rules": found["profile_rules"], "rule_violations": found["rules"]}

    def call(self, name: str, a: dict[str, Any]) -> dict[str, Any]:
        """A tool's result, or {"error": ...}: nothing that is wrong with a call ends the session."""
        known: dict[str, Callable] = {f.__name__: f for f in (self.list_profiles, self.distill, self.calibrate, self.retrieve, self.score, self.style_review)}
        if name not in known:
            return {"error": f"no tool {name!r}: there are {', '.join(known)}"}
        try:
            return known[name](a)
        except (ValueError, OSError, KeyError, TypeError) as e:
            return {"error": str(e)}

    def serve(self, lines: TextIO, out: TextIO) -> None:
        """A call a line, {"tool": name, "arguments": {...}}, and a result a line."""
        for line in lines:
            if line.strip():
                try:
                    call = json.loads(line)
                    answer = self.call(call.get("tool", ""), call.get("arguments") or {})
                except (ValueError, AttributeError):
                    answer = {"error": "a line is a JSON object with tool and arguments"}
                print(json.dumps(answer, ensure_ascii=False), file=out, flush=True)
