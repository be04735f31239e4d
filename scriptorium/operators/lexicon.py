"""Distinctive vocabulary: terms that a register uses more than general prose does."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as tx

#: Tokens of markup, addresses and code, and contractions that lost their apostrophe.
NON_PROSE = (
    "http", "https", "www", "com", "org", "net", "html", "htm", "href", "src",
    "alt", "img", "div", "span", "css", "svg", "png", "jpg", "jpeg", "gif",
    "align", "valign", "width", "height", "margin", "padding", "border", "color",
    "font", "style", "class", "rel", "nofollow", "blank", "noopener", "utf",
    "json", "xml", "url", "uri", "api", "id", "ul", "li", "td", "tr", "th",
    "br", "hr", "px", "em", "rem", "auto", "none", "block", "inline", "flex",
    "max", "min", "var", "func", "int", "str", "args", "true", "false", "null",
    "figcaption", "utm", "nbsp", "amp", "quot", "apos",
    "ive", "dont", "cant", "wont", "thats", "youre", "theyre", "weve", "didnt",
    "doesnt", "isnt", "wasnt", "arent", "werent", "wouldnt", "couldnt", "shouldnt",
    "havent", "hasnt", "hadnt", "youll", "theyll", "youd", "theyd",
    "whats", "hes", "shes", "aint",
)


def term_counts(docs: DataFrame, by: list[str], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(by, term, n, docs, total): occurrences, documents, and all occurrences of the group.

    A document's terms are added up before the first shuffle (they are in one task), and a term's documents before the
    second, so a frequent term costs one row a task."""
    kept = F.filter(tx.words(F.col(text)), lambda w: (F.length(w) >= 3) & ~F.contains(w, F.lit("'")) & ~w.isin(*NON_PROSE))
    each = docs.select(*by, doc, F.explode(kept).alias("term")).groupBy(*by, doc, "term").agg(F.count("*").alias("n"))
    counted = each.groupBy(*by, "term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    totals = counted.groupBy(*by).agg(F.sum("n").alias("total"))
    return counted.join(totals, by) if by else counted.withColumn("total", totals.scalar())


def mine(counted: DataFrame, baseline: DataFrame, by: list[str], top_n: int = 40, min_count: int = 3, min_docs: int = 2) -> DataFrame:
    """(by, rank, term, score, n, docs): the terms of most log relative frequency against ``baseline`` (term, base), where
    a term that it lacks counts once. Where the table has ``all``, that is what a term adds to the total (every count of a
    word that its file repeats)."""
    total = baseline.agg(F.sum("all" if "all" in baseline.columns else "base").alias("base_total"))
    eligible = counted.where((F.col("n") >= min_count) & (F.col("docs") >= min_docs))
    met = eligible.join(baseline, "term", "left").withColumn("base_total", total.scalar())
    share = (F.col("n").cast("double") / F.col("total")) / (F.coalesce(F.col("base"), F.lit(1)).cast("double") / F.col("base_total"))
    scored = met.withColumn("raw", F.log(share)).where("raw > 0")
    # Within a group the score goes by this ratio, whose ties are exact.
    ratio = F.col("n").cast("double") / F.coalesce(F.col("base"), F.lit(1))
    order = Window.partitionBy(*by).orderBy(ratio.desc(), "term")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    return ranked.select(*by, F.col("rank").cast("bigint").alias("rank"), "term", F.col("raw").alias("score"), "n", "docs")
