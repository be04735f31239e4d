"""Toxicity of deobfuscated text.

A writer's word goes through a noisy channel: letters become look-alike signs (leetspeak), are set apart (spacing) or are
repeated. Stretches that look so are decoded: a Viterbi search over the lattice of possible letters, under a trigram
language model of characters counted over the whole corpus, gives the likeliest source. A logistic classifier over the
letter n-grams of the restored text gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import flat, slices
from .sampling import lowest, remainder
from .workspace import extended

#: Labelled rows of each class that a fit uses (a bound, whatever the input).
SAMPLE_ROWS = 8192
#: N-grams that the classifier looks at, cells that n-grams are hashed to, lengths in bytes.
FEATURES, CELLS, LENGTHS = 2048, 1 << 20, (4, 5, 6)

#: What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "%": "", "*": "", ".": "", "-": "", "_": "", " ": "",
}
_SIGN = "0-9@$!|+(<€£¡"
_LETTER = "A-Za-z"
_ANY = _LETTER + _SIGN
#: Stretches worth decoding, of any length: letters or signs (each may be repeated) set apart by runs of gaps; else signs
#: right before letters or after the last one, or a letter three times in a row, where dots and the like may stand within.
_SUSPECT = re.compile(
    rf"(?<![{_ANY}])(?:"
    rf"([{_ANY}])\1*+(?:[ .\-_*]++([{_ANY}])\2*+){{3,}}(?![{_ANY}])"
    rf"|(?=(?:[{_ANY}]|[.\-_*]++(?=[{_ANY}]))*?(?:[{_SIGN}][{_LETTER}]|(?<=[{_LETTER}])[0134578$]{{1,2}}(?![{_ANY}])|([{_LETTER}])\3\3))"
    rf"[{_ANY}]++(?:[.\-_*]++[{_ANY}]++)*+"
    rf")",
    re.IGNORECASE,
)
_LETTERS, _ALL = re.compile(f"[{_LETTER}]"), re.compile(f"[{_ANY}]")
#: Longer stretches are not kept in the cache.
CACHED = 64


# The language model ---------------------------------------------------------------------------------------------------


def letter_codes() -> np.ndarray:
    """Bytes to 1..26 for letters of either case, else 0: the border."""
    t = np.zeros(256, np.int64)
    t[97:123] = t[65:91] = np.arange(1, 27)
    return t


CODES = letter_codes()


def character_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(cell, n): how often each trigram of letters and borders occurs in all texts; 27**3 cells at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, np.int64)
        for batch in batches:
            for part in slices(batch, "__text"):
                data, offsets = flat(part.column("__text"))
                x = CODES[data]
                begins = offsets[:-1][np.diff(offsets) > 0]
                p1 = np.zeros_like(x)
                p1[1:] = x[:-1]
                p1[begins] = 0
                p2 = np.zeros_like(x)
                p2[1:] = p1[:-1]
                p2[begins] = 0
                p2[p1 == 0] = 0  # what stands before a border doesn't matter
                total += np.bincount((p2 * 27 + p1) * 27 + x, minlength=27**3)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full])], names=["cell", "n"])

    made = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("__text")).mapInArrow(run, "cell int, n bigint")
    return made.groupBy("cell").agg(F.sum("n").alias("n"))


class Decoder:
    """Viterbi decoding of one stretch; ``logs[a, b, c]`` is the log-probability of c after a, b."""

    #: Log-probabilities of the channel: a letter or sign as it is, a look-alike, a letter repeated or a gap put in.
    KEPT, LIKE, EXTRA = 0.0, -0.7, -0.3

    def __init__(self, counts: np.ndarray) -> None:
        n = counts.reshape(27, 27, 27).astype(np.float64)
        lower = (n.sum(0) + 0.5) / (n.sum((0, 1))[:, None] * 0 + n.sum((0, 2))[:, None] + 0.5 * 27)
        self.logs = np.log((n + 20 * lower[None]) / (n.sum(2, keepdims=True) + 20))

    def decode(self, stretch: str) -> str:
        """The likeliest letters. States are the last two letters written; a sign may be a look-alike, a run of gaps nothing
        or the border of two words, and a letter or sign equal to the one before may be an extra."""
        logs = self.logs
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        before = ""
        for sign in stretch.lower():
            nxt: dict[tuple[int, int], tuple[float, tuple]] = {}
            letters = [(sign, self.KEPT)] if "a" <= sign <= "z" else [(c, self.LIKE) for c in LEET.get(sign, "")]
            options = [(ord(c) - 96, cost) for c, cost in letters]
            gap = LEET.get(sign) == ""
            if gap and LEET.get(before) == "":
                continue
            skip = gap or sign == before
            for (a, b), (score, path) in best.items():
                if gap and b:
                    got = score + logs[a, b, 0]
                    if got > nxt.get((0, 0), (-math.inf,))[0]:
                        nxt[0, 0] = (got, (path, -64))
                for c, cost in options:
                    got = score + cost + logs[a, b, c]
                    if got > nxt.get((b, c), (-math.inf,))[0]:
                        nxt[b, c] = (got, (path, c))
                if skip or not options:
                    got = score + self.EXTRA
                    if got > nxt.get((a, b), (-math.inf,))[0]:
                        nxt[a, b] = (got, path)
            best, before = nxt, sign
        score, path = max(((s + logs[a, b, 0], p) for (a, b), (s, p) in best.items()), key=lambda x: x[0])
        out: list[str] = []
        while path:
            path, c = path
            out.append(chr(96 + c))
        return "".join(reversed(out))


# Restoring ------------------------------------------------------------------------------------------------------------

_SIGNS = np.zeros(256, bool)
_SIGNS[[ord(c) for c in "0123456789@$!|+(<"]] = True
_SIGNS[0x80:] = [0xA1 <= b <= 0xA3 or b == 0xAC for b in range(0x80, 0x100)]  # last bytes of those beyond ASCII
_LAST_SIGNS = np.zeros(256, bool)
_LAST_SIGNS[[ord(c) for c in "0134578$"]] = True
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE2, 0x82]] = True
_GAPS = np.zeros(256, bool)
_GAPS[[ord(c) for c in " .-_*"]] = True


def suspicious(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that may hold such a stretch: a sign right before a letter or right after one, a letter three times in a row,
    or letters and signs set apart. One vectorised look; what it flags is searched properly."""
    letter, sign, gap = CODES[data] > 0, _SIGNS[data], _GAPS[data]
    low = data | 0x20
    hit = np.zeros(len(data), bool)
    if len(data) > 2:
        hit[1:] |= letter[1:] & sign[:-1]
        hit[:-1] |= letter[:-1] & _LAST_SIGNS[data[1:]]
        hit[2:] |= letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
    # Set apart: repeats and runs of gaps as one, without the first bytes of signs beyond ASCII.
    kept = np.flatnonzero(~_LEADS[data])
    if len(kept) > 6:
        same = (low[kept[1:]] == low[kept[:-1]]) | (gap[kept[1:]] & gap[kept[:-1]])
        kept = kept[np.concatenate(([True], ~same))]
    if len(kept) > 6:
        x, g, c = (letter | sign)[kept], gap[kept], letter[kept]
        apart = x[6:] & g[5:-1] & x[4:-2] & g[3:-3] & x[2:-4] & g[1:-5] & x[:-6]
        hit[kept[6:][apart & (c[6:] | c[4:-2] | c[2:-4] | c[:-6])]] = True
    where = np.flatnonzero(hit)
    return np.searchsorted(where, offsets[1:]) > np.searchsorted(where, offsets[:-1])


class Restorer:
    def __init__(self, counts: np.ndarray) -> None:
        self.decoder = Decoder(counts)
        self.decode = lru_cache(maxsize=100_000)(self.decoder.decode)

    def _one(self, m: re.Match) -> str:
        if len(_LETTERS.findall(m[0])) < (2 if m[1] else 1) or len(_ALL.findall(m[0])) < 3:  # numbers, and too short
            return m[0]
        return self.decode(m[0]) if len(m[0]) <= CACHED else self.decoder.decode(m[0])

    def restore(self, text: str) -> str:
        return _SUSPECT.sub(self._one, text)

    def texts(self, column: pa.Array) -> pa.Array:
        """A column with its suspicious rows restored (null as empty)."""
        data, offsets = flat(column)
        rows = np.flatnonzero(suspicious(data, offsets))
        if not len(rows):
            return column
        out = column.to_pylist()
        for i in rows:
            out[i] = self.restore(out[i])
        return pa.array(out, pa.string())


# N-grams and the classifier -------------------------------------------------------------------------------------------


def _folded() -> np.ndarray:
    t = np.full(256, 32, np.uint8)
    t[97:123] = t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


FOLDED = _folded()


def gram_cells(data: np.ndarray) -> list[np.ndarray]:
    """For each length, the cells of the n-grams that begin at each byte of a blank-separated batch."""
    x = FOLDED[data].astype(np.uint32)
    out, h = [], x * np.uint32(0)
    for n in range(1, max(LENGTHS) + 1):
        tail = x[n - 1 :]
        h = h[: len(tail)] * np.uint32(0x01000193) + tail * np.uint32(0x9E3779B1)
        if n in LENGTHS:
            y = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out.append((y ^ (y >> np.uint32(13))) >> np.uint32(12))
    return out


def spaced(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column's bytes with blanks around every row, so that no n-gram spans two rows' letters, and row offsets."""
    data, offsets = flat(column)
    pad = max(LENGTHS)
    sizes = np.diff(offsets)
    at = np.concatenate(([0], np.cumsum(sizes + pad)))
    out = np.full(at[-1] + 1, 32, np.uint8)
    if len(data):
        out[np.arange(len(data)) + np.repeat(at[:-1] + 1 - offsets[:-1], sizes)] = data
    return out, at


def row_hits(column: pa.Array, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of the n-grams whose cell has a number of 0 or more."""
    data, at = spaced(column)
    rows, found = [], []
    for cells in gram_cells(data):
        f = number[cells]
        where = np.flatnonzero(f >= 0)
        rows.append(np.searchsorted(at, where, "right") - 1)
        found.append(f[where])
    pairs = np.sort(np.concatenate(rows).astype(np.int64) << 20 | np.concatenate(found).astype(np.int64))
    pairs = pairs[np.concatenate((np.ones(min(1, len(pairs)), bool), pairs[1:] != pairs[:-1]))]
    return pairs >> 20, pairs & (1 << 20) - 1


@dataclass
class Model:
    counts: np.ndarray
    cells: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of each cell; several may share one
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    @property
    def restorer(self) -> Restorer:
        if "_restorer" not in self.__dict__:
            self.__dict__["_restorer"] = Restorer(self.counts)
        return self.__dict__["_restorer"]

    @property
    def number(self) -> np.ndarray:
        if "_number" not in self.__dict__:
            made = np.full(CELLS, -1, np.int16)
            made[self.cells] = self.feature
            self.__dict__["_number"] = made
        return self.__dict__["_number"]

    def score(self, column: pa.Array) -> np.ndarray:
        rows, found = row_hits(self.restorer.texts(column), self.number)
        g = self.bias + np.bincount(rows, self.weight[found], len(column)) if len(self.cells) else np.full(len(column), self.bias)
        return 1 / (1 + np.exp(-np.clip(g, -60, 60)))


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1.0, rounds: int = 12, block: int = 1024) -> tuple[np.ndarray, float]:
    """Weighted ridge logistic regression by Newton's method on 0/1 features; the bias isn't held back. Rows are turned to
    numbers a block at a time."""
    size = x.shape[1] + 1
    hold = np.full(size, ridge)
    hold[-1] = 1e-6
    w = np.zeros(size)
    for _ in range(rounds):
        grad, hess = hold * w, np.diag(hold)
        for at in range(0, len(x), block):
            part = np.ones((len(x[at : at + block]), size))
            part[:, :-1] = x[at : at + block]
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            own = weights[at : at + block]
            grad += part.T @ (own * (p - y[at : at + block]))
            hess += (part * (own * p * (1 - p) + 1e-9)[:, None]).T @ part
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, rows: int = SAMPLE_ROWS, text: str = "text") -> Model:
    """The language model over all ``docs``; the classifier on labelled rows whose crc32 remainder modulo ``folds`` is not
    0, at most ``rows`` of each class, weighted back to the classes' true numbers. Null labels are no labels. With labels
    of one class or none the score is that share for every text."""
    counted = character_counts(docs, text).toArrow()
    counts = np.zeros(27**3, np.int64)
    counts[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    usable = labels.where((remainder("doc_id", folds) != 0) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    n = {r[0]: r[1] for r in usable.groupBy("toxic").count().collect()}
    model = Model(counts)
    if not n.get(1) or not n.get(0):
        model.bias = 30.0 if n.get(1) else -30.0
        return model
    picked = [lowest(usable.where(F.col("toxic") == y), "doc_id", rows, f"toxic{y}:").withColumn("y", F.lit(y)) for y in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # twice ``rows`` at most
    sample = docs.select("doc_id", F.col(text).alias("text")).join(chosen, "doc_id").select("y", "text")
    plain = Model(counts)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, CELLS), np.int32)
        every = np.arange(CELLS, dtype=np.int32)
        for batch in batches:
            for part in slices(batch):
                at, cells = row_hits(plain.restorer.texts(part.column("text")), every)
                y = part.column("y").to_numpy(zero_copy_only=False)[at]
                for k in (0, 1):
                    total[k] += np.bincount(cells[y == k], minlength=CELLS)
        full = np.flatnonzero(total.any(0))
        made = [pa.array(full, pa.int32()), pa.array(total[0][full], pa.int64()), pa.array(total[1][full], pa.int64())]
        yield pa.RecordBatch.from_arrays(made, names=["cell", "without", "with_"])

    per_cell = sample.mapInArrow(present, "cell int, without bigint, with_ bigint").groupBy("cell").agg(F.sum("without").alias("a"), F.sum("with_").alias("b"))
    n0, n1 = min(n[0], rows), min(n[1], rows)
    # Pearson's statistic, signed: n-grams that mark the positive class.
    rate = (F.col("a") + F.col("b")) / float(n0 + n1)
    z = (F.col("b") / float(n1) - F.col("a") / float(n0)) / F.sqrt(rate * (1 - rate) + 1e-6)
    best = per_cell.where("b >= 2").withColumn("z", z).where("z > 0").orderBy(F.col("z").desc(), "cell").limit(FEATURES).toArrow()
    model.cells = best.column("cell").to_numpy().astype(np.int64)
    chosen_cells = Model(counts, model.cells, np.arange(len(model.cells)))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                at, found = row_hits(chosen_cells.restorer.texts(part.column("text")), chosen_cells.number)
                bounds = np.searchsorted(at, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("y"), lists], names=["y", "found"])

    got = sample.mapInArrow(dense, "y int, found array<int>").toArrow()
    y = got.column("y").to_numpy().astype(np.float64)
    lists = got.column("found").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    x = np.zeros((len(y), len(model.cells)), np.uint8)
    x[np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = 1
    # N-grams that always come together (of one word, say) are one feature.
    firsts: dict[bytes, int] = {}
    patterns = np.packbits(x, axis=0)
    model.feature = np.array([firsts.setdefault(patterns[:, j].tobytes(), len(firsts)) for j in range(x.shape[1])])
    x = x[:, np.unique(model.feature, return_index=True)[1]]
    model.weight, model.bias = logistic(x, y, np.where(y == 1, n[1] / n1, n[0] / n0))
    return model


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

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    return source.mapInArrow(run, extended(source, "score double"))
