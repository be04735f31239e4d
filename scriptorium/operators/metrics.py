"""The stylometric signature of documents: 49 metrics each, without a shuffle.

All counts of a document come from its own row, so the job is one scan; metrics are then a long table (document, metric,
value), whose set of names is open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as tx

#: The word classes of the English module.
FUNCTION_WORDS = (
    "the", "of", "and", "to", "a", "in", "that", "is", "it", "for",
    "as", "with", "but", "not", "this", "be", "by", "are", "or", "an",
    "from", "at", "which", "you", "we", "they", "its", "into", "than", "then",
)
HEDGES = (
    "maybe", "perhaps", "possibly", "might", "could", "somewhat", "fairly", "relatively", "generally", "usually",
    "likely", "probably", "seems", "appears", "arguably", "presumably", "sort", "roughly", "approximately", "essentially",
)
FIRST_PERSON = ("i", "me", "my", "mine", "we", "us", "our", "ours")
SECOND_PERSON = ("you", "your", "yours")
THIRD_PERSON = ("he", "him", "his", "she", "her", "hers", "it", "its", "they", "them", "their", "theirs")
#: Endings of a contraction, straight apostrophe only.
CONTRACTION = "(?:n't|'re|'ve|'ll|'d|'m|'s) "
#: Signs whose rate is a metric; the dash counts in two spellings.
SIGNS = {"em_dash_rate": ("—", "--"), "semicolon_rate": (";",), "colon_rate": (":",), "paren_rate": ("(",), "exclaim_rate": ("!",), "question_rate": ("?",), "comma_rate": (",",)}
CLASSES = {"hedge_rate": HEDGES, "first_person_rate": FIRST_PERSON, "second_person_rate": SECOND_PERSON, "third_person_rate": THIRD_PERSON}
LANGUAGES = ("en",)


def check_language(language: str | None) -> str:
    """The language module's name; empty means English. ValueError for a language without one."""
    language = language or "en"
    if language not in LANGUAGES:
        raise ValueError(f"unsupported language {language!r}")
    return language


def is_per_thousand(metric: Column) -> Column:
    """Whether a metric counts occurrences in 1000 words."""
    return metric.startswith("fw.") | metric.endswith("_rate")


def measured(docs: DataFrame, text: str = "text", needs: set[str] | None = None) -> DataFrame:
    """Adds ``counts``: a struct of integers that all metrics are made of, or those of them that are named in ``needs`` (and
    ``words``), so that nothing is counted in vain. A null text counts as empty.

    Sentences are counted in one string that only has marks for words and other signs, so nothing is matched a sentence."""
    t = F.coalesce(F.col(text), F.lit(""))
    known = sorted({w for c in (FUNCTION_WORDS, *CLASSES.values()) for w in c})
    needs = {*NAMES, *SIGNS, *(f"w.{w}" for w in known)} if needs is None else needs | {"words"}
    known = [w for w in known if f"w.{w}" in needs]
    long = lambda c: c.cast("bigint")
    total = lambda column: F.aggregate(column, F.lit(0).cast("bigint"), lambda a, x: a + x)
    steps: dict[str, Column] = {}
    if known or needs & {"letters", "syllables", "contractions"}:
        steps["__words"] = tx.words(t)
    if needs & {"syllables", "contractions"}:
        steps["__spaced"] = tx.spaced(F.col("__words"))
    if known:
        steps["__known"] = tx.spaced(F.filter("__words", lambda w: w.isin(known)))
    if needs & {"paragraphs", "sentences", "length_squares", "length_sum"}:
        steps["__marked"] = tx.marked(t)
    if needs & {"sentences", "length_squares", "length_sum"}:
        steps["__lens"] = tx.marked_lengths(F.col("__marked"))
    if needs & {"lines", "headings", "bullets"}:
        steps["__lines"] = F.transform(F.split(t, "\n", -1), tx.trimmed)
    fields: dict[str, Callable[[], Column]] = {
        "words": lambda: long(F.size("__words")) if "__words" in steps else tx.word_count(t).cast("bigint"),
        "letters": lambda: long(F.length(F.array_join("__words", ""))),
        "syllables": lambda: F.when(F.size("__words") > 0, tx.syllables_in(F.col("__spaced"))).otherwise(0),
        "paragraphs": lambda: tx.marked_paragraphs(F.col("__marked")),
        "sentences": lambda: long(F.size("__lens")),
        "length_squares": lambda: total(F.transform("__lens", lambda x: x.cast("bigint") * x)),
        "length_sum": lambda: total(F.col("__lens")),
        "contractions": lambda: long(F.regexp_count("__spaced", F.lit(CONTRACTION))),
        "lines": lambda: long(F.size("__lines")),
        "headings": lambda: long(F.size(F.filter("__lines", lambda x: x.startswith("#")))),
        "bullets": lambda: long(F.size(F.filter("__lines", lambda x: x.rlike("^[-*+] ")))),
    }
    for name, signs in SIGNS.items():
        fields[name] = lambda signs=signs: sum((tx.occurrences(t, s) for s in signs[1:]), tx.occurrences(t, signs[0]))
    for w in known:
        fields[f"w.{w}"] = lambda w=w: tx.occurrences(F.col("__known"), f" {w} ")
    d = docs
    for name, column in steps.items():
        d = d.withColumn(name, column)
    return d.withColumn("counts", F.struct(*[made().alias(n) for n, made in fields.items() if n in needs])).drop(*steps)


#: The counts that are no signs and no words.
NAMES = ("words", "letters", "syllables", "paragraphs", "sentences", "length_squares", "length_sum", "contractions", "lines", "headings", "bullets")
Counts = Callable[[str], Column]


def formulas() -> dict[str, Callable[[Counts], Column]]:
    """Each metric as a function of how a count is read (of a document with words)."""
    rate = lambda names, per=1000.0, of="words": lambda c: sum((c(x) for x in names[1:]), c(names[0])) * per / c(of)
    out: dict[str, Callable[[Counts], Column]] = {
        "sentence_len_mean": lambda c: c("length_sum") / c("sentences"),
        "sentence_len_stddev": lambda c: F.sqrt(c("sentences") * c("length_squares") - c("length_sum") * c("length_sum")) / c("sentences"),
        "reading_grade": lambda c: F.lit(0.39) * (c("words") / c("sentences")) + F.lit(11.8) * (c("syllables") / c("words")) - F.lit(15.59),
        "paragraph_len_mean": lambda c: c("sentences") / c("paragraphs"),
        "word_len_mean": lambda c: c("letters") / c("words"),
        "contraction_rate": rate(["contractions"]),
        "heading_cadence": rate(["headings"], 100.0, "lines"),
        "list_cadence": rate(["bullets"], 100.0, "lines"),
    }
    out |= {name: rate([name]) for name in SIGNS}
    out |= {name: rate([f"w.{w}" for w in members]) for name, members in CLASSES.items()}
    return out | {f"fw.{w}": rate([f"w.{w}"]) for w in FUNCTION_WORDS}


def definitions(names: list[str] | None = None) -> dict[str, Column]:
    """The metrics (those named, or all) as expressions over ``counts``."""
    made = formulas()
    return {n: made[n](lambda x: F.col("counts").getField(x).cast("double")) for n in (names or made)}


def needed(names: list[str]) -> set[str]:
    """The counts that these metrics are made of."""
    made, found = formulas(), set()

    def read(name: str) -> Column:
        found.add(name)
        return F.lit(1.0)

    for n in names:
        made[n](read)
    return found


def metrics_long(docs: DataFrame, keep: list[str], text: str = "text", names: list[str] | None = None) -> DataFrame:
    """Kept columns, ``n_words``, ``metric``, ``value``: all metrics (or those named) of each document that has words, zeros
    included."""
    rows = measured(docs.select(*keep, text), text, needed(names) if names else None).where("counts.words > 0")
    each = F.array(*[F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in definitions(names).items()])
    return rows.select(*keep, F.col("counts.words").alias("n_words"), F.inline(each))


def metrics_wide(docs: DataFrame, keep: list[str], names: list[str], text: str = "text") -> DataFrame:
    """Kept columns and the named metrics as columns."""
    made = definitions(names)
    return measured(docs.select(*keep, text), text, needed(names)).where("counts.words > 0").select(*keep, *[made[n].alias(n) for n in names])
