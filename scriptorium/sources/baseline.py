"""General-prose word frequencies: building the table from raw collections, reading and writing it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import words

#: Fixed values of the book collection: its banners, and the least size of a book in bytes.
START, END = "*** START OF THE PROJECT GUTENBERG", "*** END OF THE PROJECT GUTENBERG"
LEAST_BYTES = 20_000
WIKI = "query struct<pages:map<string,struct<extract:string>>>"


def without_banner(text: Column) -> Column:
    """A book's text between its banners (what is missing doesn't cut)."""
    begin = F.instr(text, START)
    after = F.when(begin > 0, F.regexp_replace(F.substr(text, begin), r"\A[^\n]*(?:\n|\z)", "")).otherwise(text)
    stop = F.instr(after, END)
    return F.when(stop > 0, F.substr(after, F.lit(1), stop - 1)).otherwise(after)


def extracts(raw: DataFrame, column: str = "value") -> DataFrame:
    """(text) of every page in JSON documents of the form query.pages.{id}.extract; what doesn't parse is skipped."""
    pages = F.from_json(F.col(column), WIKI)["query"]["pages"]
    return raw.select(F.explode(F.map_values(pages)).alias("p")).select(F.col("p.extract").alias("text")).where("text is not null")


def word_table(texts: DataFrame, top_n: int, column: str = "text") -> DataFrame:
    """(word, n): the most frequent words, ties by word."""
    counted = texts.select(F.explode(words(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.orderBy(F.col("n").desc(), "word").limit(top_n)


def build(spark: SparkSession, books: str, wiki: str, top_n: int) -> DataFrame:
    """The table of all books of enough bytes and all pages below two folders."""
    read = lambda path, files: spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", files).load(path)
    text = read(books, "*.txt").select(without_banner(F.col("value")).alias("text"))
    return word_table(text.where(F.octet_length("text") >= LEAST_BYTES).unionByName(extracts(read(wiki, "*.json"))), top_n)


def load(spark: SparkSession, path: str) -> DataFrame:
    """(term, base, all) of a file of word, tab, count; blank lines, comments and counts that aren't positive are skipped. Of
    a repeated word the last count holds, so lines are numbered by their place in the (small) file; all its counts are
    part of the total."""
    rows = spark.read.format("text").option("wholetext", True).load(path).select(F.posexplode(F.split("value", "\r?\n")).alias("i", "line"))
    rows = rows.where("trim(line) <> '' and not startswith(line, '#')").select("i", F.split("line", "\t").alias("p")).where(F.size("p") >= 2)
    rows = rows.select("i", F.lower(F.trim(F.col("p")[0])).alias("term"), F.expr("try_cast(trim(p[1]) as bigint)").alias("base")).where("base > 0")
    return rows.groupBy("term").agg(F.max_by("base", "i").alias("base"), F.sum("base").alias("all"))


def save(table: DataFrame, path: str) -> None:
    """A header line and the rows, in order, as one text file's folder."""
    lines = table.select(F.concat_ws("\t", "word", F.col("n").cast("string")).alias("value"))
    head = table.sparkSession.createDataFrame([("# word\tcount",)], "value string")
    head.unionByName(lines).coalesce(1).write.mode("overwrite").text(path)
