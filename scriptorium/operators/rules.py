"""Structural rules: mined as quantiles over paragraphs, checked by comparing with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.functions.num import rounded

#: The rules that can be mined, and their severity.
SENTENCE_RULE, PARAGRAPH_RULE = "max-sentence-length", "max-paragraph-length"
SEVERITY = "soft"
LEAST_PARAGRAPHS = 5
DEFAULT_SUPPORT = 0.9


def support_or_default(support: float) -> float:
    return support if 0 < support < 1 else DEFAULT_SUPPORT


def paragraph_table(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Kept columns, ``para`` (0-based), ``paragraph``, ``sents`` and ``lens`` (words in each)."""
    found = docs.select(*keep, F.posexplode(tx.paragraphs(F.col(text))).alias("para", "paragraph"))
    found = found.withColumn("sents", tx.sentences(F.col("paragraph")))
    return found.withColumn("lens", F.transform("sents", tx.word_count))


def _scalars() -> Column:
    return F.inline(
        F.array(
            F.struct(F.lit(SENTENCE_RULE).alias("rule_id"), F.array_max("lens").cast("bigint").alias("v")),
            F.struct(F.lit(PARAGRAPH_RULE).alias("rule_id"), F.size("sents").cast("bigint").alias("v")),
        )
    )


def statement(rule_id: Column, param: Column) -> Column:
    n = param.cast("bigint").cast("string")
    return F.when(rule_id == SENTENCE_RULE, F.concat(F.lit("Keep sentences to "), n, F.lit(" words or fewer."))).otherwise(
        F.concat(F.lit("Keep paragraphs to "), n, F.lit(" sentences or fewer."))
    )


def mine(paragraphs: DataFrame, by: list[str], min_support: float = DEFAULT_SUPPORT) -> DataFrame:
    """(by, rule_id, param, support, severity, statement). The parameter is the nearest-rank quantile. Values are counted
    first, so what is sorted is the few distinct lengths and not the paragraphs."""
    q = support_or_default(min_support)
    counted = paragraphs.select(*by, _scalars()).groupBy(*by, "rule_id", "v").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by, "rule_id")
    upto = counted.withColumn("cum", F.sum("n").over(group.orderBy("v"))).withColumn("all", F.sum("n").over(group))
    reached = upto.where((F.col("all") >= LEAST_PARAGRAPHS) & (F.col("cum") >= F.ceil(q * F.col("all"))))
    least = reached.groupBy(*by, "rule_id", "all").agg(F.min("v").alias("v"), F.min("cum").alias("cum"))
    param = F.col("v").cast("double")
    return least.select(*by, "rule_id", param.alias("param"), rounded(F.col("cum") / F.col("all"), 3).alias("support"), F.lit(SEVERITY).alias("severity"), statement(F.col("rule_id"), param).alias("statement"))


def counterexamples(paragraphs: DataFrame, rules: DataFrame, by: list[str], order: list[str], most: int = 3) -> DataFrame:
    """(by, rule_id, pos, evidence): the paragraphs that break a mined rule most, in ``order`` where they tie."""
    wanted = [c for c in (*by, *order, "paragraph") if c]
    each = paragraphs.select(*dict.fromkeys(wanted), _scalars())
    broken = each.join(F.broadcast(rules.select(*by, "rule_id", "param")), [*by, "rule_id"]).where("v > param")
    place = Window.partitionBy(*by, "rule_id").orderBy(F.col("v").desc(), *order)
    found = broken.withColumn("pos", F.row_number().over(place)).where(F.col("pos") <= most)
    return found.select(*by, "rule_id", F.col("pos").cast("bigint").alias("pos"), tx.truncated(tx.first_sentence(F.col("paragraph")), 100).alias("evidence"))


def check(paragraphs: DataFrame, rules: DataFrame, keep: list[str], on: list[str] | None = None) -> DataFrame:
    """Violations of deterministic rules: kept columns, rule_id, paragraph (1-based), sentence (1-based, 0 for a paragraph
    rule), severity, statement, evidence. ``rules`` are the profiles' few rules, broadcast; ``on`` names columns on which
    drafts and rules must agree."""
    known = F.broadcast(rules.where(F.col("rule_id").isin(SENTENCE_RULE, PARAGRAPH_RULE)))
    size = F.size("sents")
    sentence = F.transform("sents", lambda s, i: F.struct(F.lit(SENTENCE_RULE).alias("rule_id"), (i + 1).alias("sentence"), F.get("lens", i).alias("v"), tx.truncated(s, 120).alias("evidence")))
    whole = F.struct(
        F.lit(PARAGRAPH_RULE).alias("rule_id"), F.lit(0).alias("sentence"), size.alias("v"),
        F.concat(size.cast("string"), F.lit("-sentence paragraph: "), tx.truncated(F.col("paragraph"), 120)).alias("evidence"),
    )
    columns = list(dict.fromkeys([*keep, *(on or [])]))
    each = paragraphs.select(*columns, (F.col("para") + 1).cast("bigint").alias("paragraph"), F.inline(F.concat(sentence, F.array(whole))))
    broken = each.join(known, [*(on or []), "rule_id"]).where("v > param")
    return broken.select(*keep, "rule_id", "paragraph", F.col("sentence").cast("bigint").alias("sentence"), "severity", "statement", "evidence")


def judged(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("class") == "judged")


def judged_violations(verdicts: DataFrame, rules: DataFrame, keep: list[str]) -> DataFrame:
    """Failed verdicts (rule_id, holds, evidence) with their rules; verdicts on unknown rules are left out."""
    failed = verdicts.where(~F.col("holds")).join(F.broadcast(judged(rules).select("rule_id", "severity", "statement")), "rule_id")
    return failed.select(*keep, "rule_id", F.lit(0).cast("bigint").alias("paragraph"), "severity", "statement", "evidence")
