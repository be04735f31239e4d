"""Profiles as YAML files: reading, inheritance, writing, listing, finding by name; and as tables."""

from __future__ import annotations

import glob
import os
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

try:
    import yaml
except ImportError:  # only the YAML surface needs it
    yaml = None

PATTERN = "*.profile.yaml"
FEATURES = "profile_id string, metric string, min double, max double, mean double, stddev double, weight double"
RULES = "profile_id string, pos int, rule_id string, class string, severity string, statement string, support double, param double, counterexamples array<string>, require_evidence boolean"
LEXICON = "profile_id string, kind string, pos int, term string"


@dataclass
class Profile:
    """One register's style. Features and rules are dicts as in the file; an open side of a range is None."""

    id: str = ""
    register: str = ""
    language: str = ""
    inherits: str = ""
    features: list[dict[str, Any]] = field(default_factory=list)
    preferred: list[str] = field(default_factory=list)
    avoided: list[str] = field(default_factory=list)
    rules: list[dict[str, Any]] = field(default_factory=list)
    exemplars: dict[str, Any] | None = None
    discriminator: dict[str, Any] | None = None
    documents: int = 0
    words: int = 0


def _need_yaml() -> Any:
    if yaml is None:
        raise RuntimeError("reading and writing profile files needs PyYAML")
    return yaml


def from_dict(data: Any) -> Profile:
    """ValueError on anything that isn't a profile's mapping."""
    if not isinstance(data, dict):
        raise ValueError("a profile file holds a mapping")
    lexicon, corpus = data.get("lexicon") or {}, data.get("corpus") or {}
    text = {k: str(data.get(k) or "") for k in ("id", "register", "language", "inherits")}
    return Profile(
        **text, features=list(data.get("features") or []), preferred=list(lexicon.get("preferred") or []), avoided=list(lexicon.get("avoided") or []), rules=list(data.get("rules") or []),
        exemplars=data.get("exemplars"), discriminator=data.get("discriminator"), documents=int(corpus.get("documents") or 0), words=int(corpus.get("words") or 0),
    )


def to_dict(p: Profile) -> dict[str, Any]:
    out: dict[str, Any] = {k: v for k, v in (("id", p.id), ("register", p.register), ("language", p.language), ("inherits", p.inherits)) if v}
    out["features"] = sorted(p.features, key=lambda f: f["id"])
    out["lexicon"] = {"preferred": p.preferred, "avoided": p.avoided}
    out["rules"] = p.rules
    out |= {k: v for k, v in (("exemplars", p.exemplars), ("discriminator", p.discriminator)) if v}
    return out | {"corpus": {"documents": p.documents, "words": p.words}}


def load_raw(path: str) -> Profile:
    with open(path, encoding="utf-8") as f:
        try:
            return from_dict(_need_yaml().safe_load(f))
        except _need_yaml().YAMLError as e:
            raise ValueError(f"{path}: {e}") from e


def merge(base: Profile, child: Profile) -> Profile:
    """The child under its author's base: entries of the base replace those of the same id, term lists unite."""

    def united(own: list[dict], more: list[dict]) -> list[dict]:
        by_id = {x["id"]: x for x in own}
        return list((by_id | {x["id"]: x for x in more}).values())

    terms = lambda a, b: list(dict.fromkeys(t for t in [*a, *b] if t))
    return replace(child, features=united(child.features, base.features), rules=united(child.rules, base.rules), preferred=terms(child.preferred, base.preferred), avoided=terms(child.avoided, base.avoided))


def resolve(p: Profile, folder: str) -> Profile:
    """With its base merged in; a base has none of its own. Resolving again changes nothing."""
    if not p.inherits:
        return p
    base = load_raw(os.path.join(folder, p.inherits))
    if base.inherits:
        raise ValueError(f"the base {p.inherits!r} may not inherit itself")
    return merge(base, p)


def load(path: str) -> Profile:
    return resolve(load_raw(path), os.path.dirname(path))


def save(p: Profile, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        _need_yaml().safe_dump(to_dict(p), f, sort_keys=False, allow_unicode=True)


def listing(folder: str) -> list[tuple[str, Profile]]:
    """(path, profile) of a folder by id; files that don't load are passed over. No folder, none."""
    found = []
    for path in sorted(glob.glob(os.path.join(glob.escape(folder), PATTERN))) if folder else []:
        try:
            found.append((path, load(path)))
        except (ValueError, OSError, KeyError, TypeError):
            continue
    return sorted(found, key=lambda x: x[1].id)


def load_strict(folder: str) -> dict[str, Profile]:
    """All profiles of a folder by id; a file that doesn't load, and an empty or repeated id, is an error."""
    out: dict[str, Profile] = {}
    for path in sorted(glob.glob(os.path.join(glob.escape(folder), PATTERN))):
        p = load(path)
        if not p.id or p.id in out:
            raise ValueError(f"{path}: an empty or repeated id {p.id!r}")
        out[p.id] = p
    return out


def is_path(ref: str) -> bool:
    """By its looks alone: a separator or a YAML ending."""
    return "/" in ref or "\\" in ref or os.path.splitext(ref)[1].lower() in (".yaml", ".yml")


def find(folder: str, ref: str) -> Profile:
    """A profile by path, or by file stem, id or register in a folder."""
    if not ref:
        raise ValueError("no profile is named")
    if is_path(ref):
        return load(ref)
    if not folder:
        raise ValueError(f"no folder to look for profile {ref!r} in")
    stem = os.path.join(folder, f"{ref}.profile.yaml")
    if os.path.exists(stem):
        return load(stem)
    for _, p in sorted(listing(folder)):
        if ref in (p.id, p.register):
            return p
    raise ValueError(f"no profile {ref!r} in {folder}")


def tables(spark: SparkSession, profiles: list[Profile]) -> dict[str, DataFrame]:
    """features, rules, lexicon and stats of profiles, keyed by ``profile_id``: the dimension tables of scoring."""
    f, r, x, s = [], [], [], []
    for p in profiles:
        f += [(p.id, e["id"], (e.get("target") or {}).get("min"), (e.get("target") or {}).get("max"), e.get("mean", 0.0), e.get("stddev", 0.0), e.get("weight", 0.0)) for e in p.features]
        r += [(p.id, i, e["id"], e.get("class", ""), e.get("severity", ""), e.get("statement", ""), e.get("support", 0.0), e.get("param", 0.0), list(e.get("counterexamples") or []), bool(e.get("require_evidence"))) for i, e in enumerate(p.rules)]
        x += [(p.id, kind, i, t) for kind, terms in (("preferred", p.preferred), ("avoided", p.avoided)) for i, t in enumerate(terms)]
        s.append((p.id, p.documents, p.words, (p.discriminator or {}).get("threshold")))
    number = lambda row: tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in row)
    return {
        "features": spark.createDataFrame([number(v) for v in f], FEATURES),
        "rules": spark.createDataFrame([(*v[:6], float(v[6]), float(v[7]), *v[8:]) for v in r], RULES),
        "lexicon": spark.createDataFrame(x, LEXICON),
        "stats": spark.createDataFrame([(*v[:3], None if v[3] is None else float(v[3])) for v in s], "profile_id string, documents bigint, words bigint, threshold double"),
    }
