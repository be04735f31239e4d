"""Retrieval of passages by TF-IDF cosine, for one query or a table of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.functions.num import rounded

MIN_WORDS = 20


def chunks(docs: DataFrame, source: str, order: str, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """(source, para, chunk, terms): paragraphs of enough terms; of equal ones only the first by document order stays.

    Which of a boilerplate passage's copies is first is a minimum, combined before the shuffle."""
    min_words = min_words if min_words > 0 else MIN_WORDS
    found = docs.select(F.col(source).alias("source"), F.col(order).alias("__ord"), F.posexplode(tx.paragraphs(F.col(text))).alias("para", "chunk"))
    found = found.withColumn("terms", tx.retrieval_terms(F.col("chunk"))).where(F.size("terms") >= min_words)
    first = found.groupBy("chunk").agg(F.min(F.struct("__ord", "para", "source")).alias("f"))
    return first.select("f.source", F.col("f.para").alias("para"), "chunk", tx.retrieval_terms(F.col("chunk")).alias("terms"))


def counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, n) from ``terms`` arrays; a row's terms are added up before the shuffle."""
    return rows.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))


def idf(chunk_rows: DataFrame) -> DataFrame:
    """(term, df, idf): 1 + ln((chunks + 1) / (df + 1))."""
    n = chunk_rows.agg(F.count("*").alias("n"))
    df = chunk_rows.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.lit(1.0) + F.log((n.scalar() + 1).cast("double") / (F.col("df") + 1)))


def postings(rows: DataFrame, keys: list[str], weights: DataFrame) -> DataFrame:
    """(keys, term, weight): unit vectors of counts times idf; terms without idf are left out."""
    raw = counts(rows, keys).join(weights.select("term", "idf"), "term").withColumn("w", F.col("n") * F.col("idf"))
    return raw.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))).select(*keys, "term", "weight")


def top(bank: DataFrame, weights: DataFrame, queries: DataFrame, query: str, k: int = 3, text: str = "text") -> DataFrame:
    """(query, rank, source, para, score): the ``k`` nearest chunks of each query with any term in common (all of them for
    ``k`` of 0 or less), ties by source, then paragraph. ``bank`` are the chunks' postings: one join on the term, one sum."""
    asked = postings(queries.select(F.col(query).alias("query"), tx.retrieval_terms(F.col(text)).alias("terms")), ["query"], weights)
    met = asked.join(bank.withColumnRenamed("weight", "chunk_weight"), "term")
    scored = met.groupBy("query", "source", "para").agg(F.sum(F.col("weight") * F.col("chunk_weight")).alias("score")).where("score > 0")
    order = Window.partitionBy("query").orderBy(rounded(F.col("score"), 9).desc(), "source", "para")  # sums of another order still tie
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return (ranked.where(F.col("rank") <= k) if k > 0 else ranked).select("query", "rank", "source", "para", "score")
