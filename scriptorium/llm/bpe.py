"""BPE encoding by backtracking, and decoding by an offset table.

Encoding takes the longest token that starts at each place (all of them found by one Aho-Corasick pass over the
pre-token), accepts it if the pair-compatibility table says that BPE leaves it beside its left neighbour, tries shorter
tokens otherwise and steps back when none fits. A place from which the rest was found impossible is never tried again, so
the work is linear. The result is exactly BPE's. Decoding copies bytes from one buffer of all tokens by an offset table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_tables import Tables, pretokens, tables
from .worker import keeps, step
from .workspace import extended

#: Pre-tokens whose encodings a worker keeps. Memory, not results, depends on it.
CACHE_WORDS = 1_000_000
#: Longer pre-tokens (rare, and large) are not kept.
LONGEST_KEPT = 64


class Recent(dict):
    """A dict that makes what it misses by ``make`` and forgets the half not asked for lately.

    Only memory depends on the bound: a forgotten value is made again."""

    def __init__(self, make: Callable[[str], object]) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: str) -> object:
        got = self.older.get(word)
        if got is None:
            got = self.make(word)
            if len(word) > LONGEST_KEPT:
                return got
        if len(self) >= CACHE_WORDS // 2:
            self.older = dict(self)
            self.clear()
        self[word] = got
        return got


class Encoder:
    def __init__(self, t: Tables) -> None:
        self.t = t
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(t.pieces):
            self.automaton.add_word(piece.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.size = [len(p) for p in t.pieces]
        self.shorter = [next((t.rank[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in t.rank), -1) for p in t.pieces]
        self.public = np.asarray(t.public, np.int32)
        self.words = Recent(self.packed)

    def ranks(self, data: bytes) -> list[int]:
        """The BPE tokens (as ranks) of one pre-token."""
        text, total = data.decode("latin-1"), len(data)
        longest, size, shorter, apart = self.automaton.iter_long, self.size, self.shorter, self.t.apart
        out: list[int] = []
        dead: set[int] = set()
        found = longest(text)
        at, token = 0, next(found)[1]
        greedy = token  # what the automaton gave last: while it is taken, its scan goes on from the right place
        while True:
            end = at + size[token]
            if end not in dead and (not out or apart(out[-1], token)):
                out.append(token)
                at = end
                if at == total:
                    return out
                if token != greedy:
                    found = longest(text, at)
                token = greedy = next(found)[1]
                continue
            token = shorter[token]
            while token < 0:  # nothing fits here after what stands to the left
                dead.add(at)
                last = out.pop()
                at -= size[last]
                token = shorter[last]
            greedy = -1

    def packed(self, word: str) -> bytes:
        """Public ids of one pre-token as 32-bit integers."""
        return self.public[self.ranks(word.encode("utf-8", "surrogatepass"))].tobytes()

    def encode(self, text: str) -> np.ndarray:
        parts: list[bytes] = []
        for part, special in self.t.sections(text):
            if special is not None:
                parts.append(np.int32(special).tobytes())
            else:
                parts.extend(map(self.words.__getitem__, pretokens(part)))
        return np.frombuffer(b"".join(parts), np.int32)


class Rows:
    """Byte strings in one buffer with an offset table, picked by number: ``offsets[i]`` to ``offsets[i+1]`` is row i."""

    def __init__(self, rows: list[bytes]) -> None:
        self.offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        self.buffer = np.frombuffer(b"".join(rows), np.uint8)

    def pick(self, ids: np.ndarray) -> bytes:
        begins = self.offsets[ids]
        sizes = self.offsets[ids + 1] - begins
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        return self.buffer[np.arange(ends[-1]) + np.repeat(begins - (ends - sizes), sizes)].tobytes()


class Decoder:
    """Token bytes, and the ids' decimal forms, by offset table."""

    def __init__(self, t: Tables) -> None:
        named = dict(zip(t.public, t.pieces)) | {i: s.encode() for s, i in t.added.items()}
        self.bytes = Rows([named.get(i, b"") for i in range(max(named) + 1)])
        self.decimal = Rows([b"%d," % i for i in range(max(named) + 1)])

    def decode(self, ids: np.ndarray) -> str:
        """Bytes that are no UTF-8 become U+FFFD, as for any byte-level decoder."""
        return self.bytes.pick(ids).decode("utf-8", "replace")

    def listed(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return self.decimal.pick(ids)[:-1]


_codecs: dict[str, tuple[Encoder, Decoder]] = {}


def codec(path: str) -> tuple[Encoder, Decoder]:
    """One pair a process and file: workers are reused, so the tables are built once, until another operator's task."""
    if path not in _codecs:
        _codecs[path] = (Encoder(tables(path)), Decoder(tables(path)))
        keeps("bpe", forget)
    return _codecs[path]


def forget() -> None:
    """Lets go of all tables and kept encodings."""
    _codecs.clear()
    tables.cache_clear()


def _over_texts(df: DataFrame, column: str, schema: str, columns: list[str], work: Callable[[str], tuple]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(c) for c in keep]
            rows = [work(x.as_py() or "") for x in batch.column("__text")]
            made = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*keep, *names])

    keep = [c for c in columns]
    fields = [x.strip().split(" ", 1) for x in schema.split(";")]
    names, spark_kinds = [f[0] for f in fields], [f[1] for f in fields]
    kinds = [{"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[k] for k in spark_kinds]
    if set(names) & set(keep):
        raise ValueError(f"columns {sorted(set(names) & set(keep))} exist already; keep others or rename them")
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias("__text"))
    return source.mapInArrow(step("bpe", run), extended(source, ", ".join(f"`{n}` {k}" for n, k in zip(names, spark_kinds))))


def encode_decode(df: DataFrame, path: str, keep: list[str], column: str = "text") -> DataFrame:
    """Each row's kept columns with ``ids`` (array of token ids) and ``decoded`` (text), for every whole text.

    A null or empty text has no ids and decodes to the empty text. Columns that are not kept don't matter, whatever
    their names; repeated rows are encoded each. An empty table gives an empty table. ``path`` must be readable on the
    executors (a library's data file or one shipped with the job)."""

    def work(text: str) -> tuple:
        encoder, decoder = codec(path)
        ids = encoder.encode(text)
        return ids, decoder.decode(ids)

    return _over_texts(df, column, "ids array<int>; decoded string", keep, work)


def digests(df: DataFrame, path: str, keep: list[str], column: str = "text") -> DataFrame:
    """The round trip of :func:`encode_decode` with only counts and digests leaving the worker: ``n_tokens``,
    ``ids_sha256`` (decimal ids joined by commas) and ``decoded_sha256``. Same defined cases."""

    def work(text: str) -> tuple:
        encoder, decoder = codec(path)
        ids = encoder.encode(text)
        decoded = decoder.decode(ids).encode()
        return len(ids), hashlib.sha256(decoder.listed(ids)).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _over_texts(df, column, "n_tokens bigint; ids_sha256 string; decoded_sha256 string", keep, work)
