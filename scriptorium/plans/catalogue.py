"""Registered queries of the style engine. Each is checked against the independent SQL of :mod:`.oracles`.

The corpus is the English part of ``documents``. Its texts have few dashes, paragraphs, hedges and the like, so most queries
read them in a decorated form (``STYLED``), which is the same expression in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.functions.num import rounded
from scriptorium.operators import calibrate, distill, hook, lexicon, lint, massage, metrics, profile_algebra, prompts, retrieve, rules
from scriptorium.sources import baseline, markup

from . import oracles
from .oracles import AVOIDED, BASE_FEATURES, CHILD_FEATURES, FUNCTION_WORD_QUERY, HOOK_AVOIDED, JUDGED, LISTING, MARKDOWN_SAMPLES, REFS, REPLIES, STYLED

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "source", "text")


def styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(spark, sf_dir).withColumn("text", F.expr(STYLED))


def labelled(spark: SparkSession, sf_dir: str, quality: int) -> DataFrame:
    chosen = table(spark, sf_dir, "labels").where(F.col("quality") == quality).select("doc_id")
    return styled(spark, sf_dir).join(chosen, "doc_id", "left_semi")


def _wide(names: list[str], source: Callable = styled) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = metrics.metrics_wide(source(spark, sf_dir), ["doc_id"], names)
        return found.select("doc_id", *[rounded(F.col(n), 4).alias(n) for n in names])

    return run


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = plain(spark, sf_dir).select("doc_id", tx.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"))


def segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = metrics.measured(styled(spark, sf_dir), needs={"paragraphs", "sentences"})
    return c.select("doc_id", F.col("counts.paragraphs").alias("n_paras"), F.col("counts.sentences").alias("n_sents"))


def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metrics_long(styled(spark, sf_dir), ["doc_id"]).select("doc_id", "metric", rounded(F.col("value"), 4).alias("value"))


def function_word_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.metrics_long(plain(spark, sf_dir), ["doc_id"], names=[f"fw.{w}" for w in metrics.FUNCTION_WORDS])
    return found.select("doc_id", "metric", rounded(F.col("value"), 4).alias("value"))


def _features(docs: DataFrame) -> DataFrame:
    return distill.features(metrics.metrics_long(docs, []), [])


def feature_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(labelled(spark, sf_dir, 1))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distill.corpus_stats(plain(spark, sf_dir).withColumnRenamed("source", "register"), ["register"])


def baseline_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.word_table(plain(spark, sf_dir), 1000)


def lexicon_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = plain(spark, sf_dir).withColumnRenamed("source", "register")
    general = docs.select(F.explode(tx.words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("base"))
    found = lexicon.mine(lexicon.term_counts(docs, ["register"]), general, ["register"], top_n=10)
    return found.select("register", "rank", "term", rounded(F.col("score"), 4).alias("score"), "n", "docs")


def _paragraphs(docs: DataFrame) -> DataFrame:
    return rules.paragraph_table(docs, ["doc_id"])


def rules_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.mine(_paragraphs(styled(spark, sf_dir)), []).select("rule_id", "param", "support")


def rules_counterexamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paragraphs(styled(spark, sf_dir))
    return rules.counterexamples(p, rules.mine(p, []), [], ["doc_id", "para"])


def rules_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paragraphs(styled(spark, sf_dir))
    return rules.check(p, rules.mine(p, []), ["doc_id"]).select("doc_id", "rule_id", "paragraph", "sentence", "evidence")


def avoided_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([(t,) for t in AVOIDED], "term string")
    return lint.avoided_spans(styled(spark, sf_dir), terms, ["doc_id"])


def _scored(docs: DataFrame, train: DataFrame) -> tuple[DataFrame, DataFrame]:
    met = lint.compared(metrics.metrics_long(docs, ["doc_id"]), _features(train), distill.corpus_stats(train, []))
    return met, lint.with_wordless(lint.distances(met, ["doc_id"]), docs, ["doc_id"])


def style_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = labelled(spark, sf_dir, 1)
    return lint.score_rows(styled(spark, sf_dir), _features(train), distill.corpus_stats(train, []), ["doc_id"])


def feature_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    met, _ = _scored(styled(spark, sf_dir), labelled(spark, sf_dir, 1))
    return lint.feature_violations(met, ["doc_id"]).select("doc_id", "metric", "value", "deviation", "severity")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.split(labelled(spark, sf_dir, 1), "doc_id")


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("doc_id", "split")


def calibration_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _split(spark, sf_dir)
    drafts = parts.where("split = 'holdout'").select("doc_id", "text", F.lit(True).alias("is_target"))
    drafts = drafts.unionByName(labelled(spark, sf_dir, 0).select("doc_id", "text", F.lit(False).alias("is_target")))
    train = parts.where("split = 'train'")
    return lint.score_rows(drafts, _features(train), distill.corpus_stats(train, []), ["doc_id", "is_target"])


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration_scores(spark, sf_dir).select("distance", F.col("is_target").alias("target"))


def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.auc(_classes(spark, sf_dir)).select(rounded(F.col("auc"), 4).alias("auc"))


def youden_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.youden(_classes(spark, sf_dir)).select(*[rounded(F.col(c), 4).alias(c) for c in ("threshold", "tpr", "fpr", "accuracy")])


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.youden(_classes(spark, sf_dir)).select(*[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "tn", "fn")])


def on_target_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    threshold = calibrate.youden(_classes(spark, sf_dir)).select("threshold")
    found = style_distance(spark, sf_dir).withColumn("threshold", threshold.scalar())
    return found.select("doc_id", "distance", lint.on_target(F.col("distance"), F.col("threshold")).alias("on_target"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.chunks(styled(spark, sf_dir), "doc_id", "doc_id")


def chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("source", F.col("para").cast("bigint").alias("para"), F.size("terms").cast("bigint").alias("n_terms"))


def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.idf(_chunks(spark, sf_dir)).select("term", "df", rounded(F.col("idf"), 4).alias("idf"))


def retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir).persist()  # read three times: for weights, postings and their norms
    weights = retrieve.idf(c)
    bank = retrieve.postings(c, ["source", "para"], weights)
    found = retrieve.top(bank, weights, table(spark, sf_dir, "benchmark"), "item_id", k=3)
    return found.select(F.col("query").alias("item_id"), "rank", F.col("source").alias("doc_id"), F.col("para").cast("bigint").alias("para"), rounded(F.col("score"), 4).alias("score"))


def profile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "id string, pos int, weight double"
    merged = profile_algebra.merge(spark.createDataFrame(CHILD_FEATURES, schema), spark.createDataFrame(BASE_FEATURES, schema))
    return merged.select("id", "weight", "source", F.row_number().over(oracles.window_by("pos")).cast("bigint").alias("place"))


def profile_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_algebra.resolve(spark.createDataFrame(LISTING, "path string, stem string, id string, register string"), spark.createDataFrame([(r,) for r in REFS], "ref string"))


def last_assistant_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hook.last_assistant(table(spark, sf_dir, "conversations"), "conv_id", "turn")


def hook_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hook.decisions(last_assistant_turn(spark, sf_dir), "conv_id", HOOK_AVOIDED)


def judging_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(JUDGED, "pos int, rule_id string, class string, severity string, statement string, support double")
    lines = prompts.rule_lines(rows, [])
    return plain(spark, sf_dir).withColumn("lines", lines.scalar()).select("doc_id", prompts.judging_prompt(F.col("text"), F.col("lines")).alias("prompt"))


def verdict_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(JUDGED, "pos int, rule_id string, class string, severity string, statement string, support double")
    replies = spark.createDataFrame(REPLIES, "draft string, reply string")
    each = replies.select("draft", F.inline(prompts.verdicts(F.col("reply")))).withColumnRenamed("id", "rule_id")
    return rules.judged_violations(each, rows, ["draft"]).select("draft", "rule_id", "severity", "evidence")


def massage_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, docs = labelled(spark, sf_dir, 1), styled(spark, sf_dir)
    profile = massage.Profile(_features(train), distill.corpus_stats(train, []), rules.mine(_paragraphs(train), []), avoided=("—", "--"))
    drafts = docs.select(F.col("doc_id").alias("draft_id"), "text")
    _, steps = massage.massage(drafts, profile, massage.replacing({"—": ",", "--": ","}))
    count = lambda c: F.col(c).cast("bigint").alias(c)
    return steps.select(F.col("draft_id").alias("doc_id"), count("revision"), "distance", count("hard_violations"), count("rule_violations"), "accepted")


def massage_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, docs = labelled(spark, sf_dir, 1), styled(spark, sf_dir)
    profile = massage.Profile(_features(train), distill.corpus_stats(train, []), rules.mine(_paragraphs(train), []), avoided=("—", "--"))
    seen = massage.assess(docs.select(F.col("doc_id").alias("draft_id"), "text"), profile).where("not accepted")
    size = lambda c: F.size(f"brief.{c}").cast("bigint").alias(f"n_{c}")
    return massage.briefs(seen, profile).select(F.col("draft_id").alias("doc_id"), "brief.distance", size("features"), size("lexical"), size("rules"))


def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.html_to_prose(F.col("html")).alias("text"))


def markdown_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = spark.createDataFrame(MARKDOWN_SAMPLES, "id int, text string")
    docs = styled(spark, sf_dir).select("doc_id", F.expr(oracles.MARKED_UP).alias("text"))
    every = docs.unionByName(samples.select((-F.col("id")).cast("bigint").alias("doc_id"), "text"))
    return every.select("doc_id", markup.markdown_to_prose(F.col("text")).alias("text"))


def keep_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("kept", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id").join(names, "doc_id", "left").select("doc_id", F.coalesce("kept", F.lit(False)).alias("kept"))


def queries() -> dict[str, Query]:
    wide = {name: _wide(columns, plain if name in FUNCTION_WORD_QUERY else styled) for name, columns in oracles.WIDE.items()}
    own = (
        word_counts, segment_counts, metrics_long, function_word_rates, feature_ranges, corpus_stats, baseline_table, lexicon_mine, rules_mine,
        rules_counterexamples, rules_check, avoided_spans, style_distance, feature_violations, holdout_split, calibration_scores, auc, youden_threshold,
        confusion_matrix, on_target_verdict, chunk_dedup, term_idf, retrieve_topk, profile_merge, profile_resolve, last_assistant_turn, hook_decision,
        judging_prompt, verdict_violations, massage_trajectory, massage_brief, html_extract, markdown_strip, keep_list,
    )
    return wide | {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql()
