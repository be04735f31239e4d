"""Texts as flat UTF-8 buffers, so that numpy sees a batch of documents as one byte array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step works on; its temporaries are a fixed multiple of this.
SLICE_BYTES = 2 << 20

U64 = np.uint64


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null as empty) and the row offsets into them."""
    col = pc.fill_null(col, "") if col.null_count else col
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch by bytes of text; a single longer text is a slice of its own, whole."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, begin = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise and wrapping."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def blank_table() -> np.ndarray:
    """True for the bytes that separate words: space and 9 to 13."""
    t = np.zeros(256, bool)
    t[[9, 10, 11, 12, 13, 32]] = True
    return t


def lower_table() -> np.ndarray:
    """Byte to byte, A-Z lower-cased."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


BLANK, LOWER = blank_table(), lower_table()
_BASE = U64(0x9E3779B97F4A7C15) | U64(1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_BYTE64 = mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD6E8FEB86659FD93))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        p = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        p[0] = 1
        _powers[name] = np.multiply.accumulate(p)
    kept = _powers[name][:n]
    if len(_powers[name]) > 4 * SLICE_BYTES:  # a giant text must not leave its table behind
        _powers[name] = np.ones(1, np.uint64)
    return kept


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and each row's range of them."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inner = ~BLANK[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = np.flatnonzero(inner & (first[:n] | ~np.concatenate(([False], inner[:-1]))))
    ends = np.flatnonzero(inner & (first[1:] | ~np.concatenate((inner[1:], [False])))) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE64[LOWER[data]] * _power("up", _BASE, n), out=sums[1:])
    words = mix((sums[ends] - sums[begins]) * _power("down", _BASE_INV, n)[begins] + (ends - begins).astype(np.uint64))
    return words, np.searchsorted(begins, offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words in each row and each row's range of them; a row of fewer words has one, of all
    its words; a row without words has none."""
    words, at = word_hashes(data, offsets)
    counts = np.diff(at)
    per_row = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out_at = np.concatenate(([0], np.cumsum(per_row)))
    if len(words) == 0:
        return np.zeros(0, np.uint64), out_at
    run = np.zeros(max(len(words) - k + 1, 0), np.uint64)
    for j in range(k):
        run = run * U64(0xD1342543DE82EF95) + words[j : j + len(run)]
    run = mix(run + U64(k))
    inside = np.zeros(len(words), bool)
    long_rows = np.flatnonzero(counts >= k)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, at[:-1][long_rows], 1)
    np.add.at(marks, at[1:][long_rows] - k + 1, -1)
    inside = np.cumsum(marks[:-1]) > 0
    out = np.empty(out_at[-1], np.uint64)
    target = np.ones(len(out), bool)
    short_rows = np.flatnonzero((counts > 0) & (counts < k))
    target[out_at[:-1][short_rows]] = False
    out[target] = run[inside[: len(run)]]
    for r in short_rows:
        h = U64(0)
        with np.errstate(over="ignore"):
            for w in words[at[r] : at[r + 1]]:
                h = h * U64(0xD1342543DE82EF95) + w
            out[out_at[r]] = mix(np.array([h + U64(counts[r])], np.uint64))[0]
    return out, out_at
