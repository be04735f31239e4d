"""Token counts by a compiled finite-state transducer.

Reading a pre-token byte by byte, BPE's tokenization of every prefix ends in one token: the suffix of the prefix, among
the vocabulary's, that BPE leaves beside the last token of what stands before it. So a deterministic machine that knows
(a) the longest suffix read that begins some token, and (b) the last token and relative count at each place inside that
suffix, can go on: each transition says by how much the count changes. States are compiled on demand and shared by all
texts; word ends return to the start.

Around it stands the machine of the pre-tokenizer, whose states say which kind of piece is being read, where in it the
transducer is, and what was read but can't be dealt with yet (a blank, or the beginning of a contraction). Every text is cut
into chunks. What a chunk does is a map from the state it is entered in to the state it is left in and a count: up to the
first certain border in it that depends on the state; from there on it is known. Maps compose associatively, so the
chunks of a text are combined by a prefix scan in a logarithmic number of rounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Recent
from .bpe_tables import Tables, pretokens, tables
from .workspace import extended

#: Transitions that a worker keeps before it compiles anew. Memory, not results, depends on it.
MOST_TRANSITIONS = 1_500_000

#: Characters in a chunk.
CHUNK_CHARS = 4096

#: A border for certain, whatever stands around: after a letter, before one blank that a letter follows. (No pattern of
#: the pre-tokenizer spans it, and none looks behind.)
_BORDER = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


class Transducer:
    """``step(state, byte)`` gives (next state, change of the count)."""

    def __init__(self, t: Tables) -> None:
        self.t = t
        self.children: dict[int, int] = {}
        self.depth, self.token = [0], [-1]
        for i, piece in enumerate(t.pieces):
            node = 0
            for b in piece:
                key = node << 8 | b
                nxt = self.children.get(key)
                if nxt is None:
                    nxt = self.children[key] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                    self.token.append(-1)
                node = nxt
            self.token[node] = i
        self.fail = [0] * len(self.depth)
        order = sorted(((self.depth[key >> 8], key, n) for key, n in self.children.items()))
        for _, key, n in order:
            up, b = key >> 8, key & 255
            if up:
                self.fail[n] = self._goto(self.fail[up], b)
        self.suffix = [0] * len(self.depth)  # the longest proper suffix that is a token
        for _, _, n in order:
            f = self.fail[n]
            self.suffix[n] = f if self.token[f] >= 0 else self.suffix[f]
        self.begin()

    def _goto(self, node: int, byte: int) -> int:
        while True:
            nxt = self.children.get(node << 8 | byte)
            if nxt is not None:
                return nxt
            if not node:
                return 0
            node = self.fail[node]

    def begin(self) -> None:
        """Forget compiled states; state 0 is the start of a word."""
        first = (0, ((-1, 0),))
        self.states: list[tuple] = [first]
        self.number: dict[tuple, int] = {first: 0}
        self.steps: dict[int, tuple[int, int]] = {}

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """One transition. A state is (trie node, for each place within the node's suffix: last token, count relative to
        the present)."""
        node, history = self.states[state]
        nxt = self._goto(node, byte)
        cut = nxt if self.token[nxt] >= 0 else self.suffix[nxt]
        while True:
            last, count = history[-self.depth[cut]]
            token = self.token[cut]
            if last < 0 or self.t.apart(last, token):
                break
            cut = self.suffix[cut]
        change = count + 1
        kept = [(a, c - change) for a, c in history[len(history) - self.depth[nxt] :]]
        key = (nxt, (*kept, (token, 0)))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        got = self.steps[state << 8 | byte] = (to, change)
        return got

    def count(self, word: bytes) -> int:
        """Tokens of one pre-token."""
        if len(self.steps) > MOST_TRANSITIONS:
            self.begin()
        return self.feed(0, word)[1]

    def feed(self, state: int, data: bytes) -> tuple[int, int]:
        """The state after these bytes, and by how much the count has changed."""
        total, steps = 0, self.steps
        for b in data:
            go = steps.get(state << 8 | b)
            if go is None:
                go = self.compile(state, b)
            state = go[0]
            total += go[1]
        return state, total

    def numbered(self, key: tuple) -> int:
        """The number of a state that was told as it is in ``states``: numbers change when states are compiled anew."""
        state = self.number.get(key)
        if state is None:
            state = self.number[key] = len(self.states)
            self.states.append(key)
        return state


#: Kinds of characters: letters, numbers, white space (the blank among it) and others.
_KINDS = (("L", regex.compile(r"\p{L}")), ("N", regex.compile(r"\p{N}")), ("S", regex.compile(r"\s")))
#: The contractions that are pieces of their own, and the beginnings of longer ones.
CONTRACTIONS, BEGUN = ("'s", "'t", "'m", "'d", "'re", "'ve", "'ll"), ("'r", "'v", "'l")

#: Kind of the piece that is read ("" for none, "Q" for what may become a contraction), state of the transducer in it, and
#: what isn't in there yet.
State = tuple[str, tuple, str]
#: A chunk's map: what stands before its first certain border, the count from there on, the state it is left in. Without a
#: border all of it is in the first.
ChunkMap = tuple[str, int, State | None]


class Counter:
    def __init__(self, t: Tables, chunk_chars: int = CHUNK_CHARS) -> None:
        self.t, self.fst, self.chunk_chars = t, Transducer(t), chunk_chars
        self.words = Recent(lambda w: self.fst.count(w.encode("utf-8", "surrogatepass")))
        self.kinds: dict[str, str] = {}
        self.start: State = ("", self.fst.states[0], "")

    def kind(self, sign: str) -> str:
        found = self.kinds.get(sign)
        if found is None:
            if len(self.kinds) > 100_000:
                self.kinds.clear()
            found = self.kinds[sign] = next((k for k, pattern in _KINDS if pattern.fullmatch(sign)), "O")
        return found

    def run(self, entry: State, text: str) -> tuple[State, int]:
        """The state after a stretch that is entered in a state, and by how much the count has changed."""
        piece, key, held = entry
        at, total = self.fst.numbered(key), 0

        def read(state: int, signs: str) -> int:
            nonlocal total
            state, change = self.fst.feed(state, signs.encode("utf-8", "surrogatepass"))
            total += change
            return state

        for sign in text:
            kind = self.kind(sign)
            if piece == "Q":
                held += sign
                if held in CONTRACTIONS:
                    read(0, held)
                    piece, at, held = "", 0, ""
                    continue
                if held in BEGUN:
                    continue
                at = read(0, "'")
                piece = "O"
                if len(held) > 2:  # the letter after the sign begins a piece
                    piece, at = "L", read(0, held[1])
                held = ""
            if piece == "S":
                if kind == "S":
                    at, held = read(at, held), sign
                    continue
                # The run ends before its last sign: a blank goes with what follows, another is a piece of its own.
                begun = read(0, held)
                piece, at, held = (kind, begun, "") if held == " " else ("", 0, "")
            if piece == kind:  # "S" never gets here
                at = read(at, sign)
            elif kind == "S":
                piece, at, held = "S", 0, sign
            elif sign == "'":
                piece, at, held = "Q", 0, sign
            else:
                piece, at = kind, read(0, sign)
        return (piece, self.fst.states[at], held), total

    def end(self, state: State) -> int:
        """What the count still changes by if nothing follows, or a border does."""
        piece, key, held = state
        if piece == "S":
            return self.fst.feed(self.fst.numbered(key), held.encode("utf-8", "surrogatepass"))[1]
        return sum(self.fst.feed(0, c.encode())[1] for c in held)

    def chunk(self, text: str) -> ChunkMap:
        """Between the first and the last certain border whole pieces are counted, each with the transducer."""
        first = _BORDER.search(text)
        if first is None:
            return text, 0, None
        begin = last = first.start()
        for size in (256, 4096, len(text)):  # the last border is near the end
            for m in _BORDER.finditer(text, max(begin, len(text) - size)):
                last = m.start()
            if last > begin:
                break
        left, more = self.run(self.start, text[last:])
        return text[:begin], sum(map(self.words.__getitem__, pretokens(text[begin:last]))) + more, left

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First a, then b."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        left, more = self.run(a[2], b[0])
        if b[2] is None:
            return a[0], a[1] + more, left
        return a[0], a[1] + more + self.end(left) + b[1], b[2]

    def apply(self, m: ChunkMap, entry: State) -> tuple[State, int]:
        """The state that a chunk is left in if it is entered in this one, and the change of the count."""
        left, more = self.run(entry, m[0])
        return (left, more) if m[2] is None else (m[2], more + self.end(left) + m[1])

    def scan(self, maps: list[ChunkMap], entry: State) -> list[tuple[State, int]]:
        """The state after each chunk and its count, by the two sweeps of a work-efficient scan, each of a logarithmic number
        of rounds of independent steps: maps of ever longer stretches upwards, the states they are entered in downwards."""
        levels = [maps]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([self.compose(*below[i : i + 2]) if i + 1 < len(below) else below[i] for i in range(0, len(below), 2)])
        entries = [entry]
        for level in reversed(levels[:-1]):
            entries = [entries[i // 2] if i % 2 == 0 else self.apply(level[i - 1], entries[i // 2])[0] for i in range(len(level))]
        return [self.apply(m, e) for m, e in zip(maps, entries)]

    def count(self, text: str) -> int:
        total, n = 0, self.chunk_chars
        for part, special in self.t.sections(text):
            if special is not None:
                total += 1
                continue
            after = self.scan([self.chunk(part[i : i + n]) for i in range(0, len(part), n)], self.start)
            total += sum(count for _, count in after) + self.end(after[-1][0])
        return total


_counters: dict[tuple[str, int], Counter] = {}


def counter(path: str, chunk_chars: int) -> Counter:
    if (path, chunk_chars) not in _counters:
        _counters[path, chunk_chars] = Counter(tables(path), chunk_chars)
    return _counters[path, chunk_chars]


def token_counts(df: DataFrame, path: str, keep: list[str], column: str = "text", limit: int = 1024, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Each row's kept columns with ``n_bytes`` (of UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    A null or empty text has 0 bytes and 0 tokens. Repeated rows count each; an empty table gives an empty one; columns
    that are not kept don't matter. A kept column may not have the name of one that is added (ValueError)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = counter(path, chunk_chars)
            counts = pa.array([made.count(x.as_py() or "") for x in batch.column("__text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in [*keep, "n_bytes"]], counts], names=[*keep, "n_bytes", "n_tokens"])

    if set(keep) & {"n_bytes", "n_tokens", "over_limit"}:
        raise ValueError("a kept column has the name of an added one")
    text = F.col(f"`{column}`")
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), text.alias("__text"))
    return source.mapInArrow(run, extended(source, "n_tokens bigint")).withColumn("over_limit", F.col("n_tokens") > limit)
