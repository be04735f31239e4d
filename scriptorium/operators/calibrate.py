"""Calibration: a threshold that tells target drafts from decoys, and how well it does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.num import rounded

METHOD = "weighted-distance/youden"
LEAST_AUC = 0.6


def holdout_every(n: int) -> int:
    return n if n >= 2 else 4


def split(docs: DataFrame, name: str, every: int = 4) -> DataFrame:
    """Adds ``split``: every n-th document in the order of a hash of its name is held out, the others train.

    Names alone are put in order, per hash bucket, and places added up over the buckets; the texts meet their names again
    afterwards. Names are the documents' keys: rows that share one are held out together."""
    every = holdout_every(every)
    hashed = F.md5(F.col(name).cast("string"))
    rows = docs.select(name).distinct().withColumn("__h", hashed).withColumn("__b", F.substring("__h", 1, 3))
    sizes = rows.groupBy("__b").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))  # 4096 rows at most
    placed = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__h", name)) - 1).join(F.broadcast(starts), "__b")
    held = (F.col("__s") + F.col("__r")) % every == 0
    chosen = placed.select(F.col(name).alias("__name"), F.when(held, "holdout").otherwise("train").alias("split"))
    return docs.join(chosen, F.col(name).eqNullSafe(F.col("__name"))).drop("__name")


def guard(train: int, holdout: int, decoys: int) -> None:
    """ValueError where a class is too small to calibrate on."""
    if decoys < 1:
        raise ValueError("calibration needs at least one decoy document")
    if train < 2 or holdout < 1:
        raise ValueError("calibration needs two documents to train on and one to hold out at least")


def curve(scored: DataFrame) -> DataFrame:
    """(distance, p, n, tp, fp, pos, neg) for each distinct distance of ``scored`` (distance, target): counts at it and up
    to it. Scores have 4 decimals, so this table stays small however many drafts there are."""
    at = scored.groupBy("distance").agg(F.count_if("target").alias("p"), F.count_if(~F.col("target")).alias("n"))
    upto = Window.orderBy("distance").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(0))
    return at.select(
        "distance", "p", "n", F.sum("p").over(upto).alias("tp"), F.sum("n").over(upto).alias("fp"), F.sum("p").over(every).alias("pos"), F.sum("n").over(every).alias("neg")
    )


def auc(scored: DataFrame) -> DataFrame:
    """(auc): how often a target draft is nearer than a decoy, ties half; 0 if either class is empty."""
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") + F.col("p") / 2)) / F.max(F.col("pos").cast("double") * F.col("neg"))
    return curve(scored).agg(F.coalesce(F.when(F.max(F.col("pos") * F.col("neg")) > 0, area), F.lit(0.0)).alias("auc"))


def youden(scored: DataFrame) -> DataFrame:
    """(threshold, tpr, fpr, accuracy, tp, fp, tn, fn): the distance of most TPR - FPR, the smallest where several are."""
    c = curve(scored)
    tpr = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pos")), F.lit(0.0))
    fpr = F.coalesce(F.try_divide(F.col("fp").cast("double"), F.col("neg")), F.lit(0.0))
    rows = c.select(
        F.col("distance").alias("threshold"), tpr.alias("tpr"), fpr.alias("fpr"), ((F.col("tp") + F.col("neg") - F.col("fp")) / (F.col("pos") + F.col("neg")).cast("double")).alias("accuracy"),
        "tp", "fp", (F.col("neg") - F.col("fp")).alias("tn"), (F.col("pos") - F.col("tp")).alias("fn"), (F.col("tp") * F.col("neg") - F.col("fp") * F.col("pos")).alias("gain"),
    )
    # Of rates, equal sums can differ in their last bit; with both classes there, gain orders alike and is whole.
    gain = F.when((F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0), F.col("gain").cast("double")).otherwise(F.col("tpr") - F.col("fpr"))
    return rows.withColumn("gain", gain).orderBy(F.col("gain").desc(), "threshold").limit(1).drop("gain")


def separates(area: Column, tpr: Column, fpr: Column) -> Column:
    return (area >= LEAST_AUC) & (tpr > fpr)


def discriminator(scored: DataFrame) -> DataFrame:
    """One row: threshold, auc, tpr, fpr (4 decimals), method, accuracy, separates."""
    best = youden(scored).crossJoin(F.broadcast(auc(scored)))  # one row each
    r = lambda c: rounded(F.col(c), 4).alias(c)
    return best.select(r("threshold"), r("auc"), r("tpr"), r("fpr"), F.lit(METHOD).alias("method"), "accuracy", separates(F.col("auc"), F.col("tpr"), F.col("fpr")).alias("separates"))
