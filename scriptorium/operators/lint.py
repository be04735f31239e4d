"""Scoring drafts against profiles: many drafts and many profiles in one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.num import rounded

from .metrics import definitions, is_per_thousand, measured, needed

#: A feature whose scale is less can't be held against a draft.
LEAST_SCALE = 1e-9
#: A noncharacter that stands for a term in a text.
MARK = "\ufdd2"


def scale(metric: Column, mean: Column, stddev: Column, n_words: Column, corpus_words: Column) -> Column:
    """Deviations are counted in these: the profile's, widened for rates by how much a draft's length makes them vary
    beyond what documents of the corpus' mean length do; one occurrence in the draft at least."""
    more = F.greatest(F.lit(0.0), F.lit(1000.0) * mean / n_words - F.coalesce(F.try_divide(F.lit(1000.0) * mean, corpus_words), F.lit(0.0)))
    return F.when(~is_per_thousand(metric) | (n_words <= 0), stddev).otherwise(F.greatest(F.sqrt(stddev * stddev + more), F.lit(1000.0) / n_words))


def deviation(value: Column, low: Column, high: Column, scaled: Column) -> Column:
    """How far outside the range, in scales; an open side is null."""
    return F.when(value < low, (low - value) / scaled).when(value > high, (value - high) / scaled).otherwise(F.lit(0.0))


def compared(metrics: DataFrame, features: DataFrame, stats: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Metrics met with profile features: adds min, max, weight, scale, dev. ``features`` and ``stats`` (documents, words)
    have a row a profile and metric or a profile: they are the side that is sent around, and ``on`` names profile columns
    that both sides have beforehand."""
    keys = [c for c in features.columns if c in stats.columns]
    profile = features.join(stats, keys) if keys else features.crossJoin(F.broadcast(stats))
    met = metrics.join(F.broadcast(profile), [*(on or []), "metric"])
    corpus = F.try_divide(F.col("words").cast("double"), F.col("documents"))
    met = met.withColumn("scale", scale(F.col("metric"), F.col("mean"), F.col("stddev"), F.col("n_words").cast("double"), corpus))
    return met.where(F.col("scale") >= LEAST_SCALE).withColumn("dev", deviation(F.col("value"), F.col("min"), F.col("max"), F.col("scale")))


def distances(met: DataFrame, by: list[str]) -> DataFrame:
    """(by, distance): the weighted mean deviation over the features that can be held against a draft."""
    found = met.groupBy(*by).agg(F.sum(F.col("weight") * F.col("dev")).alias("a"), F.sum("weight").alias("b"))
    return found.select(*by, rounded(F.coalesce(F.try_divide("a", "b"), F.lit(0.0)), 4).alias("distance"))


def score_rows(docs: DataFrame, features: DataFrame, stats: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(keep, distance) of each draft to one profile, within its own row: no shuffle, no state, so for streams too.

    The profile's features (some fifty rows) and its row of ``stats`` (documents, words) are read once, beforehand. Drafts
    without words are at distance 0; rows that share an id are drafts of their own."""
    s = stats.first()
    corpus = s["words"] / s["documents"] if s["documents"] else None
    made, n = definitions(), F.col("counts.words").cast("double")
    known = [row for row in features.orderBy("metric").collect() if row["metric"] in made]
    above, below = F.lit(0.0), F.lit(0.0)
    for row in known:
        scaled = scale(F.lit(row["metric"]), F.lit(row["mean"]), F.lit(row["stddev"]), n, F.lit(corpus).cast("double"))
        dev = deviation(made[row["metric"]], F.lit(row["min"]).cast("double"), F.lit(row["max"]).cast("double"), F.greatest(scaled, F.lit(1e-300)))
        counts = scaled >= LEAST_SCALE
        above = above + F.when(counts, F.lit(row["weight"]) * dev).otherwise(0.0)
        below = below + F.when(counts, F.lit(row["weight"])).otherwise(0.0)
    distance = F.when(F.col("counts.words") > 0, rounded(F.coalesce(F.try_divide(above, below), F.lit(0.0)), 4)).otherwise(0.0)
    return measured(docs.select(*keep, text), text, needed([r["metric"] for r in known])).select(*keep, distance.alias("distance"))


def with_wordless(found: DataFrame, docs: DataFrame, by: list[str]) -> DataFrame:
    """Adds drafts that have no metric at all: at distance 0 from any profile."""
    return docs.select(*by).join(found, by, "left").withColumn("distance", F.coalesce("distance", F.lit(0.0)))


def feature_violations(met: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, value, min, max, deviation, severity, contribution): features out of range, always soft."""
    dev = rounded(F.col("dev"), 3)
    return met.where("dev > 0").select(*by, "metric", rounded(F.col("value"), 4).alias("value"), "min", "max", dev.alias("deviation"), F.lit("soft").alias("severity"), (F.col("weight") * dev).alias("contribution"))


def avoided_spans(docs: DataFrame, terms: DataFrame, keep: list[str], text: str = "text", on: list[str] | None = None) -> DataFrame:
    """(keep, term, start, end): where avoided terms occur, case-sensitively, in bytes of UTF-8; occurrences of one term
    don't overlap, those of different terms may. ``terms`` has the profiles' few terms in ``term``; they are made one
    array a profile and sent around. A term may hold any characters; time goes with the text and its occurrences."""
    listed = terms.where("term <> ''").distinct()
    listed = listed.groupBy(*on).agg(F.sort_array(F.collect_list("term")).alias("terms")) if on else listed.agg(F.sort_array(F.collect_list("term")).alias("terms"))
    met = docs.join(F.broadcast(listed), on) if on else docs.withColumn("terms", listed.scalar())
    each = met.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("t"), F.explode("terms").alias("term")).where(F.contains(F.col("t"), F.col("term")))
    parts = F.transform(F.split(F.replace(F.col("t"), F.col("term"), F.lit(MARK)), MARK, -1), lambda x: F.octet_length(x))
    each = each.select(*keep, "term", F.slice(parts, F.lit(1), F.size(parts) - 1).alias("parts"), F.octet_length("term").alias("size"))
    each = each.select(*keep, "term", "size", F.explode(_running(F.col("parts"), F.col("size"))).alias("start"))
    return each.select(*keep, "term", F.col("start").cast("bigint").alias("start"), (F.col("start") + F.col("size")).cast("bigint").alias("end"))


def _running(parts: Column, more: Column) -> Column:
    """Running totals of an array, with ``more`` added between elements: totals of blocks of the root of its length first, so
    that none is added up from the start."""
    n = F.size(parts)
    block = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    sums = F.transform(F.sequence(F.lit(0), F.floor(n / block).cast("int")), lambda b: total(F.slice(parts, b * block + 1, block)))
    upto = lambda i, at: total(F.slice(sums, F.lit(1), at)) + total(F.slice(parts, at * block + 1, i - at * block + 1)) + i * more
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: upto(i, F.floor(i / block).cast("int")))).otherwise(F.array().cast("array<int>"))


def hard_counts(docs: DataFrame, terms: list[str], text: str = "text") -> Column:
    """Number of avoided occurrences, for a handful of terms known beforehand: no join."""
    from scriptorium.functions.text import occurrences

    t = F.coalesce(F.col(text), F.lit(""))
    found = [occurrences(t, x) for x in dict.fromkeys(terms) if x]
    return sum(found[1:], found[0]) if found else F.lit(0).cast("bigint")


def on_target(distance: Column, threshold: Column) -> Column:
    """Null without a threshold."""
    return F.when(threshold.isNotNull(), distance <= threshold)
