"""Quality by positive-unlabelled learning.

Trusted positives and unlabelled web text are compared under a class prior estimated from both (no negative label is used):
of the unlabelled rows that a classifier of positive against unlabelled rows puts above a border, at most as large a share
is positive as of the positives, so the least quotient of the two shares over all borders bounds the prior; borders are
chosen by its upper confidence bound, on rows that the classifier was not fitted on. The final classifier minimises the
non-negative unbiased risk ``prior * R+(P) + max(0, R-(U) - prior * R-(P))`` with the logistic loss, stepping back where
the bracket falls below 0. Documents are described by how often each kind of character follows each other kind, how often a word repeats the
one before, and length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import flat, slices, word_hashes
from .sampling import lowest, remainder
from .worker import step
from .workspace import extended

#: Rows that a fit uses of the positives, and as many of the unlabelled (a bound, whatever the input).
SAMPLE_ROWS = 8192
#: A document is kept from this score on.
THRESHOLD = 0.3
STEPS, RATE, DECAY = 600, 0.05, 1e-4
#: The prior's border is chosen with this confidence; a prior stays within these bounds.
DOUBT, LEAST_PRIOR, MOST_PRIOR = 0.1, 0.01, 0.99
#: Kinds of bytes: those of ``OWN_KIND`` each, and lower, upper, digit, blank, control, other sign, non-ASCII.
OWN_KIND = ".,!|*&%$#"
KINDS = 16


def _kinds() -> np.ndarray:
    t = np.full(256, 14, np.uint8)
    t[97:123], t[65:91], t[48:58], t[32], t[:32], t[128:] = 0, 1, 2, 3, 4, 15
    for i, c in enumerate(OWN_KIND):
        t[ord(c)] = 5 + i
    return t


KIND = _kinds()
WIDTH = KINDS * KINDS + 3


def describe(texts: pa.Array) -> np.ndarray:
    """A row a text: square roots of the shares of each pair of kinds, of words that equal the one before, and of word
    begins, and the log of the length."""
    data, offsets = flat(texts)
    sizes = np.diff(offsets)
    kind = KIND[data].astype(np.int64)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    before = np.full(len(kind), 4)
    before[1:] = kind[:-1]
    before[offsets[:-1][sizes > 0]] = 4  # a text begins after a line end
    pairs = np.bincount((row * KINDS + before) * KINDS + kind, minlength=len(texts) * KINDS * KINDS).reshape(len(texts), -1)
    words, at = word_hashes(data, offsets)
    again = np.zeros(len(words) + 1, np.int64)
    if len(words) > 1:
        same = words[1:] == words[:-1]
        same[at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(words))] - 1] = False
        again[2:] = np.cumsum(same)
    counts = np.diff(at)
    repeated = np.sqrt((again[at[1:]] - again[at[:-1]]) / np.maximum(counts, 1))
    rest = np.stack([repeated, np.sqrt(counts / np.maximum(sizes, 1)), np.log1p(sizes)], 1)
    return np.hstack([np.sqrt(pairs / np.maximum(sizes, 1)[:, None]), rest]).astype(np.float32)


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        g = ((describe(texts) - self.centre) / self.scale) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -60, 60).astype(np.float64)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of weights (the last is the bias) and the gradient that a step follows: the risk's where the
    bracket isn't below 0, else that of minus the bracket. The weights' decay is part of both."""
    gp, gu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    bracket = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    up = prior * (_sigmoid(gp) - 1) / len(p)  # of prior * R+(P)
    down_u, down_p = _sigmoid(gu) / len(u), -prior * _sigmoid(gp) / len(p)
    if bracket < 0:
        up, down_u, down_p = 0 * up, -down_u, -down_p
    dp = up + down_p
    gradient = np.concatenate((p.T @ dp + u.T @ down_u + DECAY * w[:-1], [dp.sum() + down_u.sum()]))
    return prior * np.logaddexp(0, -gp).mean() + max(0.0, bracket) + DECAY / 2 * float(w[:-1] @ w[:-1]), gradient


def _descend(gradient: Callable[[np.ndarray], np.ndarray], width: int, steps: int = STEPS) -> np.ndarray:
    """Full-batch Adam from 0."""
    w, m, v = (np.zeros(width) for _ in range(3))
    for step in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def non_negative_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """The linear classifier of the least non-negative risk."""
    centre, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = (positive - centre) / scale, (unlabelled - centre) / scale
    w = _descend(lambda w: risk(w, p, u, prior)[1], p.shape[1] + 1)
    return Model(centre, scale, w[:-1].astype(np.float32), float(w[-1]))


def best_border(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior's estimate from scores of positives and of unlabelled rows."""
    borders = np.unique(positive)
    above = lambda x: 1 - np.searchsorted(np.sort(x), borders, "left") / len(x)
    p, u = above(positive), above(unlabelled)
    slack = np.sqrt(np.log(4 / DOUBT) / 2 / len(unlabelled)) + np.sqrt(np.log(4 / DOUBT) / 2 / len(positive))
    best = int(np.argmin((u + slack) / p))
    return float(min(1.0, u[best] / p[best]))


def _in_order(x: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in an order of their own, so that the halves don't depend on how Spark dealt them."""
    order = np.lexsort((*x.T[::-1], flag))
    return x[order], flag[order]


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled. Each half's scores come from a fit on the other half."""
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    centre, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = (positive - centre) / scale, (unlabelled - centre) / scale
    found = []
    for half in (0, 1):
        fit_p, fit_u, own_p, own_u = p[half::2], u[half::2], p[1 - half :: 2], u[1 - half :: 2]

        def gradient(w: np.ndarray, a: np.ndarray = fit_p, b: np.ndarray = fit_u) -> np.ndarray:
            da, db = (_sigmoid(a @ w[:-1] + w[-1]) - 1) / len(a), _sigmoid(b @ w[:-1] + w[-1]) / len(b)
            return np.concatenate((a.T @ da + b.T @ db + 10 * DECAY * w[:-1], [da.sum() + db.sum()]))

        w = _descend(gradient, p.shape[1] + 1, STEPS // 2)
        found.append(best_border(own_p @ w[:-1], own_u @ w[:-1]))
    return min(max(float(np.mean(found)), LEAST_PRIOR), MOST_PRIOR)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, rows: int = SAMPLE_ROWS, prior: float | None = None, text: str = "text") -> Model:
    """Fit on positives of ``labels`` (doc_id, quality) and on unlabelled ``docs``, at most ``rows`` of each.

    Rows whose crc32 remainder modulo ``folds`` is 0 take no part, nor do null ids. Without ``prior`` it is estimated from
    both samples. Null labels and labels of 0 are no labels; an id labelled more than once counts once, one that several
    rows share stands for all of them. Without any positive or any unlabelled row, every score is the prior (1/2, if not
    given)."""
    usable = labels.where((remainder("doc_id", folds) != 0) & (F.col("quality") == 1))
    positives = lowest(usable, "doc_id", rows, "positive:").withColumn("positive", F.lit(True))
    others = lowest(docs.where(remainder("doc_id", folds) != 0), "doc_id", rows, "unlabelled:").withColumn("positive", F.lit(False))
    chosen = F.broadcast(positives.unionByName(others))  # twice ``rows`` at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                made = describe(part.column("text"))
                values = pa.FixedSizeListArray.from_arrays(pa.array(made.ravel(), pa.float32()), WIDTH).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column("positive"), values], names=["positive", "x"])

    sample = docs.select("doc_id", F.col(text).alias("text")).join(chosen, "doc_id").select("positive", "text")
    found = sample.mapInArrow(step("quality", run), "positive boolean, x array<float>").toArrow()
    flag = found.column("positive").to_numpy().astype(bool)
    x = np.array(found.column("x").combine_chunks().flatten()).reshape(-1, WIDTH)
    x, flag = _in_order(x.astype(np.float64), flag)
    if prior is None:
        prior = estimate_prior(x[flag], x[~flag]) if flag.any() and not flag.all() else 0.5
    prior = min(max(float(prior), LEAST_PRIOR), MOST_PRIOR)
    if not flag.any() or flag.all():
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), float(np.log(prior / (1 - prior))))
    return non_negative_risk(x[flag], x[~flag], prior)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Each row's kept columns with ``score``, from its whole text alone (a null text counts as empty). Equal texts get
    equal scores; an empty table gives an empty one; no kept column may be named ``score``."""
    if "score" in keep:
        raise ValueError("a kept column is named score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                made = pa.array(shared.value.score(part.column("__text")), pa.float64())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], made], names=[*keep, "score"])

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    return source.mapInArrow(step("quality", run), extended(source, "score double"))
