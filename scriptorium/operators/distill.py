"""From a corpus to a profile: feature ranges and weights per register."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.num import rounded

from . import metrics as m


@dataclass(frozen=True)
class Options:
    """Width of ranges in deviations, size of the vocabulary and its thresholds, terms to avoid. A width that isn't
    positive means the default; the other options stay as given."""

    range_k: float = 1.5
    top_n: int = 40
    min_count: int = 3
    min_docs: int = 2
    avoid: tuple[str, ...] = field(default_factory=tuple)

    @property
    def width(self) -> float:
        return self.range_k if self.range_k > 0 else 1.5


def weight(mean: Column, stddev: Column) -> Column:
    """Steady features weigh more: 1 / (1 + relative deviation), within 0.1 and 1."""
    steady = F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1.0 / (1.0 + F.try_divide(stddev, F.abs(mean)))))
    return rounded(F.when(mean == 0, F.when(stddev == 0, F.lit(0.8)).otherwise(F.lit(0.4))).otherwise(steady), 3)


def features(metrics: DataFrame, by: list[str], range_k: float = 1.5) -> DataFrame:
    """(by, metric, mean, stddev, min, max, weight): one sample a document with words. Averages are combined before the
    shuffle, so it carries one row a task, group and metric."""
    stats = metrics.groupBy(*by, "metric").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sigma"))
    low, high = F.col("mu") - range_k * F.col("sigma"), F.col("mu") + range_k * F.col("sigma")
    low = F.when(F.col("metric") == "reading_grade", low).otherwise(F.greatest(F.lit(0.0), low))
    return stats.select(
        *by, "metric", rounded(F.col("mu"), 4).alias("mean"), rounded(F.col("sigma"), 4).alias("stddev"),
        rounded(low, 4).alias("min"), rounded(high, 4).alias("max"), weight(F.col("mu"), F.col("sigma")).alias("weight"),
    )


def corpus_stats(docs: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by, documents, words): documents without words count too."""
    from scriptorium.functions.text import word_count

    n = F.coalesce(word_count(F.col(text)), F.lit(0)).cast("bigint")
    return docs.select(*by, n.alias("n")).groupBy(*by).agg(F.count("*").alias("documents"), F.sum("n").alias("words"))


def avoid_list(terms: list[str] | tuple[str, ...]) -> list[str]:
    """Terms without empty ones and repeats, in order."""
    return list(dict.fromkeys(t for t in terms if t))


def thin(documents: int) -> bool:
    """Whether a corpus is too small to trust."""
    return documents < 5


def profile_frames(docs: DataFrame, by: list[str], language: str = "en", options: Options = Options(), text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(features, corpus statistics) of every register in ``docs``. ValueError on a language without a module."""
    m.check_language(language)
    return features(m.metrics_long(docs, by, text), by, options.width), corpus_stats(docs, by, text)
