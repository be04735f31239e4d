"""Language identification as multilingual mixture inference.

Each language is a distribution of byte trigrams, counted over all training texts. A document is a mixture: its units (a
few words each) are drawn from one language each, and expectation-maximisation estimates the proportions. Starting from
all languages, the one with the least share is taken out as long as that improves the penalised likelihood (BIC); what
remains is the document's language set, and the largest share names it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import flat, slices
from .worker import step
from .workspace import extended

#: Trigram cells of a language model; what the driver holds is this many numbers a language.
CELLS = 1 << 16
#: Words in a unit.
UNIT_WORDS = 8
ROUNDS = 8
SMOOTHING = 0.5
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Bytes to bytes: letters and all non-ASCII stay, A-Z lower-cased; what is left is blank."""
    t = np.full(256, 32, np.uint8)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


LETTERS = _letters()


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, position, word begins here) of every byte trigram that ends in or right after a word. Nothing spans rows."""
    x = LETTERS[data]
    begins = offsets[:-1][np.diff(offsets) > 0]
    p1 = np.empty_like(x)
    p1[1:], p1[begins] = x[:-1], 32
    p2 = np.empty_like(x)
    p2[1:], p2[begins] = p1[:-1], 32
    cells = (p2.astype(np.uint32) * np.uint32(0x9E3779B1) + p1.astype(np.uint32) * np.uint32(0x85EBCA6B) + x.astype(np.uint32) * np.uint32(0xC2B2AE35))
    cells = (cells ^ (cells >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)
    at = np.flatnonzero((x != 32) | (p1 != 32))
    return cells[at], at, ((x != 32) & (p1 == 32))[at]


def counts(docs: DataFrame, language: str = "lang", text: str = "text") -> DataFrame:
    """(lang, cell, n) over all rows whose language is not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "__text"):
                data, offsets = flat(part.column("__text"))
                names = np.array(part.column("__lang").to_pylist(), object)
                cells, at, _ = trigrams(data, offsets)
                bounds = np.searchsorted(at, offsets)
                for name in set(names):
                    mine = np.repeat(names == name, np.diff(bounds))
                    total[name] = total.get(name, 0) + np.bincount(cells[mine], minlength=CELLS)
        for name, n in total.items():
            full = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array(n[full], pa.int64())], names=["lang", "cell", "n"])

    source = docs.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(language).alias("__lang"), F.col(text).alias("__text"))
    return source.mapInArrow(step("lang_id", run), "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


class Model:
    """``names`` and, for each, log-probabilities of the cells."""

    def __init__(self, counted: pa.Table) -> None:
        lang, cell, n = (counted.column(c).to_numpy() for c in ("lang", "cell", "n"))
        self.names = sorted(set(lang))
        self.logs = np.zeros((len(self.names), CELLS), np.float32)
        for i, name in enumerate(self.names):
            mine = np.full(CELLS, SMOOTHING)
            mine[cell[lang == name]] += n[lang == name]
            self.logs[i] = np.log(mine / mine.sum())

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods of every unit under every language, and each row's range of units."""
        cells, at, begins = trigrams(data, offsets)
        words = np.flatnonzero(begins)
        rows = np.searchsorted(at[words], offsets)  # each row's range of words
        order = np.arange(len(words)) - np.repeat(rows[:-1], np.diff(rows))
        heads = np.flatnonzero(order % UNIT_WORDS == 0)
        logs = np.empty((len(heads), len(self.names)))
        for i in range(len(self.names)) if len(heads) else []:
            logs[:, i] = np.add.reduceat(self.logs[i][cells], words[heads], dtype=np.float64)
        return logs, np.searchsorted(heads, rows)

    def fit(self, like: np.ndarray, row: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of each row after EM from ``share`` (zeros stay), and its log-likelihood without the units' maxima."""
        n = np.bincount(row, minlength=len(share))[:, None]
        for _ in range(ROUNDS):
            part = like * share[row]
            part /= np.maximum(part.sum(1, keepdims=True), 1e-300)
            share = np.stack([np.bincount(row, part[:, i], len(share)) for i in range(part.shape[1])], 1) / np.maximum(n, 1)
        fit = np.log(np.maximum((like * share[row]).sum(1), 1e-300))
        return share, np.bincount(row, fit, len(share))

    def proportions(self, logs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Each row's language proportions over its chosen language set (zeros elsewhere)."""
        rows, size = len(bounds) - 1, len(self.names)
        sizes = np.diff(bounds)
        row = np.repeat(np.arange(rows), sizes)
        like = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -300)) if len(logs) else logs
        share, fit = self.fit(like, row, np.full((rows, size), 1.0 / size))
        penalty = 0.5 * np.log(np.maximum(sizes, 2))  # for each language more
        active = np.flatnonzero(sizes > 0) if size > 1 else np.zeros(0, int)
        alive = np.ones((rows, size), bool)
        while len(active):
            out = np.where(alive[active], share[active], np.inf).argmin(1)
            inner = np.isin(row, active)
            renumber = np.full(rows, -1)
            renumber[active] = np.arange(len(active))
            mask = alive[active].copy()
            mask[np.arange(len(active)), out] = False
            start = np.where(mask, np.maximum(share[active], 1e-3), 0)
            less, less_fit = self.fit(like[inner], renumber[row[inner]], start / start.sum(1, keepdims=True))
            better = less_fit + penalty[active] >= fit[active]
            won = active[better]
            share[won], fit[won], alive[won] = less[better], less_fit[better], mask[better]
            active = won[alive[won].sum(1) > 1]
        return share

    def predict(self, texts: pa.Array) -> list[tuple[str, float, float]]:
        """Language, score and fit of each text: its main language and that one's share, and how much likelier the mixture
        makes one of its trigrams than blind chance would (a logarithm; 0 and less: the text is in no learned language)."""
        data, offsets = flat(texts)
        logs, bounds = self.units(data, offsets)
        if not self.names:
            return [(UNKNOWN, 0.0, 0.0)] * len(texts)
        share = self.proportions(logs, bounds)
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        most = logs.max(1) if len(logs) else np.zeros(0)
        like = most + np.log(np.maximum((np.exp(np.maximum(logs - most[:, None], -300)) * share[row]).sum(1), 1e-300))
        _, at, _ = trigrams(data, offsets)
        found = np.diff(np.searchsorted(at, offsets))
        fit = np.bincount(row, like, len(texts)) / np.maximum(found, 1) + np.log(CELLS)
        out = []
        for i, b in enumerate(share.argmax(1)):
            known = bounds[i + 1] > bounds[i]
            if known and not ((data[offsets[i] : offsets[i + 1]] & 0xDF) - 65 < 26).any():  # no ASCII letter: look closer
                known = any(c.isalpha() for c in texts[i].as_py())
            out.append((self.names[b], float(min(1.0, share[i, b])), float(fit[i])) if known else (UNKNOWN, 0.0, 0.0))
        return out


def train(docs: DataFrame, language: str = "lang", text: str = "text") -> Model:
    """Counts over all given documents; the driver gets ``CELLS`` numbers a language at most."""
    return Model(counts(docs, language, text).toArrow())


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Each row's kept columns with ``lang_pred``, ``score`` and ``fit`` (:meth:`Model.predict`), from its whole text.

    A null text or one without letters is ``und`` with score and fit 0, as is every text under a model of no language. Of
    languages with equal shares the first by name is taken. Equal texts get equal answers; an empty table gives an empty
    one; a kept column may not have an added name (ValueError)."""
    if set(keep) & {"lang_pred", "score", "fit"}:
        raise ValueError("a kept column has the name of an added one")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                found = shared.value.predict(part.column("__text"))
                made = [pa.array([x[j] for x in found], kind) for j, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *made], names=[*keep, "lang_pred", "score", "fit"])

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    return source.mapInArrow(step("lang_id", run), extended(source, "lang_pred string, score double, fit double"))
