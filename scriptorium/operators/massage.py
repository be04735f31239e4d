"""The assess-and-revise loop over a batch of drafts.

A round is one job over the drafts that are still open: score, decide, brief, revise. The loop is bounded by the number of
revisions; each round's drafts are written to a checkpoint, so a lost executor costs a round at most. A ``draft_id`` names
one draft: ids must not repeat.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import trimmed

from . import lint, retrieve, rules as rl
from .metrics import metrics_long

GUIDANCE = (
    "Rewrite the draft in the target style and keep its meaning: bring features into range, remove avoided terms, mend broken "
    "rules, prefer the given vocabulary, follow the passages' rhythm."
)


@dataclass(frozen=True)
class Profile:
    """A profile's tables: features, stats (documents, words), rules (rule_id, param, severity, statement, class, ...), avoided
    and preferred terms and threshold (None: not calibrated)."""

    features: DataFrame
    stats: DataFrame
    rules: DataFrame
    avoided: tuple[str, ...] = ()
    threshold: float | None = None
    preferred: tuple[str, ...] = ()


@dataclass(frozen=True)
class Bank:
    """Passages to learn from: ``postings`` (source, para, term, weight), ``weights`` (term, idf) and ``chunks`` (source, para,
    chunk), as retrieval makes them."""

    postings: DataFrame
    weights: DataFrame
    chunks: DataFrame


Reviser = Callable[[DataFrame], DataFrame]
#: Drafts to failed judged rules: (draft_id, rule_id, severity, statement, evidence).
Judge = Callable[[DataFrame], DataFrame]
EXEMPLARS = 3


def _broken(drafts: DataFrame, profile: Profile, judge: Judge | None) -> DataFrame:
    """(draft_id, rule_id, severity, statement, evidence) of all broken rules, checked or judged."""
    columns = ["draft_id", "rule_id", "severity", "statement", "evidence"]
    known = profile.rules
    for name in ("severity", "statement"):
        known = known if name in known.columns else known.withColumn(name, F.lit("soft" if name == "severity" else ""))
    found = rl.check(rl.paragraph_table(drafts, ["draft_id"]), known, ["draft_id"]).select(*columns)
    return found if judge is None else found.unionByName(judge(drafts).select(*columns))


def assess(drafts: DataFrame, profile: Profile, judge: Judge | None = None) -> DataFrame:
    """Drafts (draft_id, text) with distance, on_target, hard_violations, rule_violations, accepted.

    Accepted: no avoided term, no broken rule of severity hard, and on target where the profile has a threshold; soft
    violations never block."""
    scored = lint.score_rows(drafts, profile.features, profile.stats, ["draft_id"])
    counts = _broken(drafts, profile, judge).groupBy("draft_id").agg(F.count("*").alias("rule_violations"), F.count_if(F.col("severity") == "hard").alias("hard_rules"))
    rows = drafts.join(scored, "draft_id").join(counts, "draft_id", "left").fillna(0, ["rule_violations", "hard_rules"])
    rows = rows.withColumn("hard_violations", lint.hard_counts(drafts, list(profile.avoided)))
    rows = rows.withColumn("on_target", lint.on_target(F.col("distance"), F.lit(profile.threshold).cast("double")))
    accepted = (F.col("hard_violations") == 0) & (F.col("hard_rules") == 0) & F.coalesce("on_target", F.lit(True))
    return rows.withColumn("accepted", accepted).drop("hard_rules")


def briefs(seen: DataFrame, profile: Profile, judge: Judge | None = None, bank: Bank | None = None, exemplars: int = EXEMPLARS) -> DataFrame:
    """(draft_id, brief): what a reviser needs to know of each assessed draft, as one struct: distance, on_target, threshold;
    features out of range, avoided terms, broken rules, passages of the bank on the same matter (``exemplars`` of them;
    three, if that isn't positive), each an array in its order; preferred and avoided terms; guidance. Lists are a draft's
    own, so they are as long as its faults are many."""
    drafts = seen.select("draft_id", "text")

    def listed(rows: DataFrame, name: str, order: list[Column], *columns: str) -> DataFrame:
        entry = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.struct(*columns).alias("own"))
        own = rows.groupBy("draft_id").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["own"]).alias(name))
        return own

    met = lint.compared(metrics_long(drafts, ["draft_id"]), profile.features, profile.stats)
    features = listed(lint.feature_violations(met, ["draft_id"]), "features", [-F.col("contribution"), F.col("metric")], "metric", "value", "min", "max", "deviation", "severity")
    terms = seen.sparkSession.createDataFrame([(t,) for t in profile.avoided], "term string")
    lexical = listed(lint.avoided_spans(drafts, terms, ["draft_id"]), "lexical", [F.col("start"), F.col("term")], "term", "start", "end")
    rules = listed(_broken(drafts, profile, judge), "rules", [F.col("rule_id"), F.col("evidence")], "rule_id", "severity", "statement", "evidence")
    made = seen.join(features, "draft_id", "left").join(lexical, "draft_id", "left").join(rules, "draft_id", "left")
    entries = ["features", "lexical", "rules"]
    if bank is not None:
        near = retrieve.top(bank.postings, bank.weights, drafts, "draft_id", exemplars if exemplars > 0 else EXEMPLARS).withColumnRenamed("query", "draft_id")
        passages = listed(near.join(bank.chunks.select("source", "para", "chunk"), ["source", "para"]), "exemplars", [F.col("rank")], "rank", "score", "source", "para", "chunk")
        made = made.join(passages, "draft_id", "left")
        entries.append("exemplars")
    strings = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    lists = [F.coalesce(F.col(e), F.array().cast(made.schema[e].dataType)).alias(e) for e in entries]
    if bank is None:
        lists.append(F.array().cast("array<struct<rank:bigint,score:double,source:string,para:int,chunk:string>>").alias("exemplars"))
    brief = F.struct(
        "distance", "on_target", F.lit(profile.threshold).cast("double").alias("threshold"), *lists, strings(profile.preferred).alias("preferred"),
        strings(profile.avoided).alias("avoided"), F.lit(GUIDANCE).alias("guidance"),
    )
    return made.select("draft_id", brief.alias("brief"))


def massage(
    drafts: DataFrame, profile: Profile, revise: Reviser | None, most: int = 3, judge: Judge | None = None, cut: Callable[[DataFrame], DataFrame] | None = None,
    bank: Bank | None = None, exemplars: int = EXEMPLARS,
) -> tuple[DataFrame, DataFrame]:
    """(outcome: draft_id, text, accepted, revisions; trajectory: draft_id, revision, distance, on_target, hard_violations,
    rule_violations, accepted).

    ``revise`` maps assessed drafts to (draft_id, revised), with a column ``brief`` of :func:`briefs` if it is marked as
    ``briefed``; a draft stops when it is accepted, when the revisions are used
    up, or when a revision is blank or the same (which counts as made, and the text stays). Without ``revise`` drafts are
    assessed once. ``cut`` stores a round's result; a checkpoint by default."""
    most = most if most > 0 else 3
    spark = drafts.sparkSession
    if cut is None:
        if spark.sparkContext.getCheckpointDir() is None:
            shared = spark.conf.get("spark.checkpoint.dir", None)
            if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
            spark.sparkContext.setCheckpointDir(shared or "file:///tmp/checkpoints/scriptorium")
        cut = lambda df: df.checkpoint()
    steps = ("draft_id", "revision", "distance", "on_target", "hard_violations", "rule_violations", "accepted")
    open_, outcome, trajectory = drafts.select("draft_id", "text"), None, None

    def add(a: DataFrame | None, b: DataFrame) -> DataFrame:
        return b if a is None else a.unionByName(b)

    for revision in range(most + 1):
        seen = cut(assess(open_, profile, judge).withColumn("revision", F.lit(revision)))
        trajectory = add(trajectory, seen.select(*steps))
        last = revision == most or revise is None
        done = seen if last else seen.where("accepted")
        outcome = add(outcome, done.select("draft_id", "text", "accepted", F.col("revision").alias("revisions")))
        if last:
            break
        told = seen.where("not accepted")
        if getattr(revise, "briefed", False):
            told = cut(told.join(briefs(told, profile, judge, bank, exemplars), "draft_id"))
        tried = cut(seen.where("not accepted").join(revise(told).select("draft_id", "revised"), "draft_id", "left"))
        moved = (trimmed(F.coalesce("revised", F.lit(""))) != "") & (F.col("revised") != F.col("text"))
        stuck = tried.where(~moved)
        outcome = outcome.unionByName(stuck.select("draft_id", "text", "accepted", F.lit(revision + 1).alias("revisions")))
        open_ = tried.where(moved).select("draft_id", F.col("revised").alias("text"))
    return outcome, trajectory


def replacing(pairs: dict[str, str]) -> Reviser:
    """A reviser without a model: fixed replacements, as expressions."""

    def revise(seen: DataFrame) -> DataFrame:
        text = F.col("text")
        for old, new in pairs.items():
            text = F.replace(text, F.lit(old), F.lit(new))
        return seen.select("draft_id", text.alias("revised"))

    return revise


def calling(function: Callable[..., str], briefed: bool = False) -> Reviser:
    """A reviser that calls Python (a model's client, say) for each draft, in Arrow batches; ``briefed``: with the draft's
    brief as a dictionary. An error ends the loop and names the revision."""

    def revise(seen: DataFrame) -> DataFrame:
        kind = seen.schema["draft_id"].dataType.simpleString()

        def run(frames):
            for frame in frames:
                revised = []
                for row in frame.itertuples():
                    try:
                        revised.append(function(row.text, json.loads(row.brief)) if briefed else function(row.text))
                    except Exception as e:
                        raise RuntimeError(f"revision {row.revision + 1}: {e}") from e
                yield frame.assign(revised=revised)[["draft_id", "revised"]]

        columns = ["draft_id", "text", "revision", *([F.to_json("brief").alias("brief")] if briefed else [])]
        return seen.select(*columns).mapInPandas(run, f"draft_id {kind}, revised string")

    revise.briefed = briefed
    return revise


def judging(function: Callable[[str, list[dict]], list[dict]], rules: DataFrame) -> Judge:
    """A judge that calls Python for each draft with the judged ones of a profile's few rules; it answers with verdicts (id,
    holds, evidence). Verdicts on rules that aren't there are left out. Without judged rules it is never called."""
    known = [r.asDict() for r in rl.judged(rules).select("rule_id", "severity", "statement").orderBy("rule_id").collect()]

    def judge(drafts: DataFrame) -> DataFrame:
        kind = drafts.schema["draft_id"].dataType.simpleString()

        def run(frames):
            for frame in frames:
                rows = [(row.draft_id, v["id"], bool(v["holds"]), v.get("evidence")) for row in frame.itertuples() for v in (function(row.text, known) if known else [])]
                yield pd.DataFrame(rows, columns=["draft_id", "rule_id", "holds", "evidence"])

        verdicts = drafts.select("draft_id", "text").mapInPandas(run, f"draft_id {kind}, rule_id string, holds boolean, evidence string")
        return rl.judged_violations(verdicts, rules, ["draft_id"])

    return judge
