"""Corpora of files as tables of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Markdown and plain text, in any case.
FILES = "*.{[mM][dD],[tT][xX][tT]}"


def read_corpus(spark: SparkSession, folder: str, register: str) -> DataFrame:
    """(register, doc_name, doc_ord, text): one row a file below ``folder``, names as paths; invalid UTF-8 becomes U+FFFD.

    ``doc_ord`` orders documents as their paths do: it is the path itself, so no task has to number them."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", FILES).load(folder)
    path = F.url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*(?=/)", ""), F.lit("+"), F.lit("%2B")))
    return files.select(F.lit(register).alias("register"), path.alias("doc_name"), path.alias("doc_ord"), F.col("value").alias("text"))


def numbered(docs: DataFrame, by: str = "register") -> DataFrame:
    """``doc_ord`` as a number within each (small) register, where one is needed for show."""
    return docs.withColumn("doc_ord", F.row_number().over(Window.partitionBy(by).orderBy("doc_name")).cast("bigint") - 1)


def one_draft(spark: SparkSession, text: str, name: str = "draft") -> DataFrame:
    """A single draft as a table."""
    return spark.createDataFrame([(name, text)], "draft_id string, text string")


def keep_only(docs: DataFrame, names: DataFrame, on: str, strict: bool = False) -> DataFrame:
    """Documents on the keep-list (one column ``on``). ``strict``: ValueError if a name on it has no document."""
    if strict:
        lost = [r[0] for r in missing(docs, names, on).orderBy(on).limit(20).collect()]
        if lost:
            raise ValueError(f"the corpus lacks {', '.join(map(str, lost))}")
    return docs.join(names.select(on).distinct(), on, "left_semi")


def missing(docs: DataFrame, names: DataFrame, on: str) -> DataFrame:
    """Names on the keep-list that no document has."""
    return names.select(on).distinct().join(docs, on, "left_anti")


def write_corpus(docs: DataFrame, folder: str) -> None:
    """Mirror a corpus: what the folder held before is gone."""
    docs.write.mode("overwrite").parquet(folder)


def mirror(docs: DataFrame, names: DataFrame, on: str, folder: str) -> DataFrame:
    """The kept part of a corpus as a folder of its own, which is only touched if no name is missing."""
    kept = keep_only(docs, names, on, strict=True)
    write_corpus(kept, folder)
    return docs.sparkSession.read.schema(kept.schema).parquet(folder)
