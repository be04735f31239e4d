import re

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.functions.num import rounded
from scriptorium.operators import metrics

SAMPLES = [
    ("mixed", "Maybe we should go! Is it late? It's late; very late.\n\nThe end."),
    ("dash", "One — two -- three."),
    ("empty", ""),
    ("signs", " ... !! "),
    ("unicode", "Äpfel größer привет 日本語。終わり。"),
    ("edges", "A\r\n\t\r\nb c.d 3.14 e.g. x y\n \nlast’s word"),
]


def scalar_words(t):
    return [w.lower() for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", t)]


def scalar_syllables(w):
    runs = len(re.findall("[aeiouy]+", w))
    return max(1, runs - (w.endswith("e") and runs > 1))


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(SAMPLES, "name string, text string")


def test_words_and_syllables(spark, samples):
    rows = samples.select("text", tx.words(F.col("text")).alias("w")).collect()
    for r in rows:
        assert r.w == scalar_words(r.text)
    words = ["table", "the", "queue", "rhythm", "mm", "idea", "one", "ate", "aerie", "don't", ""]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.syllables(F.col("w")).alias("n")).collect()
    assert {r.w: r.n for r in got} == {w: scalar_syllables(w) if w else 0 for w in words}


def test_segments(samples):
    rows = {r.name: r for r in samples.select("name", F.transform(tx.paragraphs(F.col("text")), tx.sentences).alias("p")).collect()}
    assert rows["mixed"].p == [["Maybe we should go!", "Is it late?", "It's late; very late."], ["The end."]]
    assert rows["empty"].p == [] and rows["signs"].p == [["...", "!!"]]
    assert len(rows["edges"].p) == 3 and rows["edges"].p[1][0] == "b c.d 3.14 e.g."


def test_metrics(samples):
    rows = metrics.metrics_long(samples, ["name"]).collect()
    by = {(r.name, r.metric): r.value for r in rows}
    assert len({m for _, m in by}) == 49
    assert {n for n, _ in by} == {"mixed", "dash", "unicode", "edges"}  # no words, no metrics
    n = len(scalar_words(SAMPLES[0][1]))
    assert by["mixed", "exclaim_rate"] == pytest.approx(1000 / n) and by["mixed", "contraction_rate"] == pytest.approx(1000 / n)
    assert by["mixed", "hedge_rate"] > 0 and by["mixed", "first_person_rate"] > 0 and by["mixed", "paragraph_len_mean"] == 2
    assert by["dash", "em_dash_rate"] == pytest.approx(2000 / 3)
    with pytest.raises(ValueError):
        metrics.check_language("fr")
    assert metrics.check_language("") == "en"


def test_rounding(spark):
    cases = [(0.00005, 4, 0.0001), (-0.00005, 4, -0.0001), (1.2345, 3, 1.235), (2.0, 2, 2.0)]
    for x, places, want in cases:
        assert spark.range(1).select(rounded(F.lit(x), places).alias("v")).first().v == pytest.approx(want, abs=1e-12)
