"""The library's entry points: distil, calibrate, check, review, retrieve, on tables of documents."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import calibrate as cal
from scriptorium.operators import distill as dst
from scriptorium.operators import lexicon, lint, massage, prompts, retrieve, rules
from scriptorium.operators.metrics import check_language, metrics_long
from scriptorium.sources import corpus, profiles
from scriptorium.sources.profiles import Profile


@dataclass
class Outcome:
    """A finished profile and what went into its rules."""

    profile: Profile
    deterministic_rules: int = 0
    judged_rules: int = 0
    skipped: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    calibration: dict[str, Any] | None = None


def distill(docs: DataFrame, register: str, baseline: DataFrame, id: str = "", language: str = "", options: dst.Options = dst.Options(), base: str = "", rules_file: str = "") -> Outcome:
    """A profile of ``docs`` (doc_id, text) against the word table ``baseline`` (term, base)."""
    if not register:
        raise ValueError("distilling needs a register")
    features, stats = dst.profile_frames(docs, [], check_language(language), options)
    terms = lexicon.mine(lexicon.term_counts(docs.withColumn("r", F.lit(register)), ["r"]), baseline, ["r"], options.top_n, options.min_count, options.min_docs)
    s = stats.first()
    # A profile is some fifty features and forty terms: this is where the driver takes it over.
    made = Profile(
        id=id or register, register=register, language=check_language(language),
        features=[{"id": r.metric, "target": {"min": r["min"], "max": r["max"]}, "mean": r.mean, "stddev": r.stddev, "weight": r.weight} for r in features.orderBy("metric").collect()],
        preferred=[r.term for r in terms.orderBy("rank").collect()], avoided=dst.avoid_list(options.avoid), documents=int(s.documents or 0), words=int(s.words or 0),
    )
    return finish(made, docs, base, rules_file)


def finish(p: Profile, docs: DataFrame, base: str = "", rules_file: str = "") -> Outcome:
    """Adds mined rules, then the base, then the judged rules of a file whose ids are free."""
    paragraphs = rules.paragraph_table(docs, ["doc_id"])
    mined = rules.mine(paragraphs, [])
    examples: dict[str, list[str]] = {}
    for r in rules.counterexamples(paragraphs, mined, [], ["doc_id", "para"]).orderBy("rule_id", "pos").collect():
        examples.setdefault(r.rule_id, []).append(r.evidence)
    p.rules = [
        {"id": r.rule_id, "class": "deterministic", "severity": r.severity, "statement": r.statement, "support": r.support, "param": r.param, "counterexamples": examples.get(r.rule_id, [])}
        for r in mined.orderBy(F.col("rule_id").desc()).collect()
    ]
    p.inherits = base
    p = profiles.resolve(p, "")
    out = Outcome(p, deterministic_rules=len(p.rules))
    have = {r["id"] for r in p.rules}
    for r in profiles.load_raw(rules_file).rules if rules_file else []:
        if r.get("class") != "judged":
            continue
        if r["id"] in have:
            out.skipped.append(r["id"])
            continue
        have.add(r["id"])
        p.rules.append(r)
        out.judged_rules += 1
    if dst.thin(p.documents):
        out.warnings.append(f"only {p.documents} documents: ranges will be loose")
    return out


def calibrate(docs: DataFrame, decoys: DataFrame, register: str, baseline: DataFrame, holdout_every: int = 4, base: str = "", rules_file: str = "", **more: Any) -> Outcome:
    """Distil on the training part, score the rest and the decoys, attach the threshold; rules are mined on all of ``docs``."""
    parts = cal.split(docs, "doc_id", holdout_every)
    n = {r.split: r["count"] for r in parts.groupBy("split").count().collect()}
    cal.guard(n.get("train", 0), n.get("holdout", 0), decoys.limit(1).count())
    train = parts.where("split = 'train'").drop("split")
    made = distill(train, register, baseline, **more).profile
    drafts = parts.where("split = 'holdout'").select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("draft_id"), "text")
    drafts = drafts.unionByName(decoys.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("draft_id"), "text"))
    scored = scores(drafts, made).select("distance", F.col("draft_id").startswith("t").alias("target"))
    best = cal.discriminator(scored).first()
    made.discriminator = {k: best[k] for k in ("threshold", "auc", "tpr", "fpr", "method")}
    out = finish(made, docs, base, rules_file)
    out.calibration = best.asDict() | {"train": n.get("train", 0), "target_holdout": n.get("holdout", 0), "decoys": decoys.count()}
    if not best.separates:
        out.warnings.append("the corpora are not told apart well: the threshold means little")
    return out


def _frames(spark: SparkSession, p: Profile) -> dict[str, DataFrame]:
    return profiles.tables(spark, [p])


def scores(drafts: DataFrame, p: Profile) -> DataFrame:
    """(draft_id, distance) of any number of drafts."""
    check_language(p.language)
    t = _frames(drafts.sparkSession, p)
    return lint.score_rows(drafts, t["features"].drop("profile_id"), t["stats"].select("documents", "words"), ["draft_id"])


def check(spark: SparkSession, text: str, p: Profile) -> dict[str, Any]:
    """One draft's assessment: distance, verdict, features out of range, avoided terms, broken rules."""
    check_language(p.language)
    draft, t = corpus.one_draft(spark, text), _frames(spark, p)
    met = lint.compared(metrics_long(draft, ["draft_id"]), t["features"].drop("profile_id"), t["stats"].select("documents", "words"))
    found = lint.distances(met, ["draft_id"]).first()
    distance = found.distance if found else 0.0
    threshold = (p.discriminator or {}).get("threshold")
    features = lint.feature_violations(met, ["draft_id"]).orderBy(F.col("contribution").desc(), "metric").drop("draft_id", "contribution")
    spans = lint.avoided_spans(draft, t["lexicon"].where("kind = 'avoided'").select("term"), ["draft_id"]).orderBy("start", "term").drop("draft_id") if p.avoided else None
    lexical = [r.asDict() for r in spans.collect()] if spans is not None else []
    known = t["rules"].where(F.col("class") == "deterministic").select("rule_id", "param", "severity", "statement")
    broken = rules.check(rules.paragraph_table(draft, ["draft_id"]), known, ["draft_id"]).orderBy("rule_id", "paragraph", "sentence").drop("draft_id")
    return {
        "distance": distance, "threshold": threshold, "on_target": None if threshold is None else distance <= threshold, "features": [r.asDict() for r in features.collect()],
        "lexical": lexical, "hard_violations": len(lexical), "rules": [r.asDict() for r in broken.collect()],
    }


def review(spark: SparkSession, text: str, p: Profile) -> dict[str, Any]:
    """An assessment with what a reviser needs: vocabulary, rules, the judging prompt, a verdict in words, guidance."""
    found = check(spark, text, p)
    verdict = {None: "not calibrated: judge for yourself", True: "on target", False: "off target"}[found["on_target"]]
    judged = [r for r in p.rules if r.get("class") == "judged"]
    prompt = None
    if judged:
        lines = prompts.rule_lines(_frames(spark, p)["rules"], [])
        prompt = corpus.one_draft(spark, text).withColumn("l", lines.scalar()).select(prompts.judging_prompt(F.col("text"), F.col("l"))).first()[0]
    return found | {"preferred_lexicon": p.preferred, "avoided_lexicon": p.avoided, "profile_rules": p.rules, "judging_prompt": prompt, "judgement": verdict, "guidance": massage.GUIDANCE}


@dataclass
class Bank:
    """A corpus' passages, made once and kept for any number of queries: ``chunks`` (source, para, chunk), ``postings`` and
    ``weights``."""

    chunks: DataFrame
    postings: DataFrame
    weights: DataFrame

    @staticmethod
    def of(docs: DataFrame, source: str = "doc_id", order: str = "doc_id", min_words: int = retrieve.MIN_WORDS) -> Bank:
        chunks = retrieve.chunks(docs, source, order, min_words).persist()
        weights = retrieve.idf(chunks).persist()
        return Bank(chunks, retrieve.postings(chunks, ["source", "para"], weights).persist(), weights)

    def passages(self, query: str, k: int = 3) -> DataFrame:
        """(rank, source, para, score, chunk): the passages nearest to one query (three, if ``k`` isn't positive)."""
        if not query.strip():
            raise ValueError("the query is blank")
        asked = self.chunks.sparkSession.createDataFrame([(0, query)], "query_id int, text string")
        found = retrieve.top(self.postings, self.weights, asked, "query_id", k if k > 0 else 3).drop("query")
        return found.join(self.chunks.select("source", "para", "chunk"), ["source", "para"]).select("rank", "source", "para", "score", "chunk")

    def free(self) -> None:
        for table in (self.postings, self.weights, self.chunks):
            table.unpersist()


def passages(docs: DataFrame, query: str, k: int = 3, **more: Any) -> DataFrame:
    """The passages nearest to one query over a corpus of which no bank is kept."""
    return Bank.of(docs, **more).passages(query, k)
