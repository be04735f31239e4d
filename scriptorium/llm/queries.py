"""The registered queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tokenizer file of the token queries; a parameter of the operators.
TOKENIZER = "byte_bpe_50k.json"


def settle(spark: SparkSession) -> None:
    """Batches that Python gets are bounded by bytes: ten thousand long texts at once would be a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"), ["doc_id"]).drop("slots")


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vamana import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity
    from .sampling import remainder

    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality
    from .sampling import remainder

    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import Rule, groups

    return groups(table(spark, sf_dir, "documents"), Rule(words=3, percent=90)).drop("group")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_fst import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), ["doc_id"])


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), ["doc_id"])


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lang_id
    from .sampling import remainder

    docs = table(spark, sf_dir, "documents")
    model = lang_id.train(docs.where(remainder("doc_id", 4) != 2))
    found = lang_id.identify(docs, model, ["doc_id"])
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derivatives, responses

    made = derivatives(responses(table(spark, sf_dir, "pages")))
    columns = ["warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "source_digest"]
    return made.select(F.col("key").alias("page_id"), *columns, F.col("source_headers")["Content-Length"].alias("source_length"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media
    from .workspace import stage

    made = stage(media.stored_documents(table(spark, sf_dir, "documents"), ["doc_id"]), "media")
    pages = media.sequences(made.select("doc_id", "n_bytes", "html"), ["doc_id", "n_bytes"])
    found = media.resolve(pages, media.features(made.select("digest", "media")), ["doc_id", "n_bytes"])
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mix": op1_source_mix,
        "op2_vector_search": op2_vector_search,
        "op3_toxicity": op3_toxicity,
        "op4_quality": op4_quality,
        "op5_ngram_join": op5_ngram_join,
        "op6_token_counts": op6_token_counts,
        "op7_bpe_roundtrip": op7_bpe_roundtrip,
        "op8_language": op8_language,
        "op9_warc_derivatives": op9_warc_derivatives,
        "op10_media_columns": op10_media_columns,
    }


def oracle_sql() -> dict[str, str]:
    from . import mixing, warc

    return {"op1_source_mix": mixing.ORACLE_SQL, "op9_warc_derivatives": warc.ORACLE_SQL}
