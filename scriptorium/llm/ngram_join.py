"""Exact Jaccard join of word n-gram sets by prefix trees, and the groups that its links make.

Sets that may be linked are brought together first. All n-grams are dealt by hash into one more part than two linked sets
of a size band can differ in n-grams, so such sets agree on a whole part: the keys of a set are its parts. Very common
n-grams, as a count table of a fixed number of cells over all texts tells them, are left out of the parts, and parts
without any n-gram are no keys; a few more parts make up for those, and sets that have still more of them get keys of a
second kind (:func:`part_keys`). Keys are shuffled in packed buckets, a set's name once for all of its keys in one. Sets
with a key in common make candidate groups, which are joined in blocks of bounded size. In a block the n-grams have one order, the commonest first, and the sets go into a trie in that order. The sets then
walk the trie: the overlap with a path counts for all sets below it, and a subtree is left where size, position and what
remains can't reach the threshold any more.

Equal sets (exact copies above all) are one class from the start and never meet as pairs. Every linked pair of different
sets is found in one block and counted for both; pairs themselves are returned as far as groups need them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import U64, flat, mix, shingle_hashes, slices
from .components import components
from .members import perhaps_among
from .worker import release, step
from .workspace import extended, stage

#: Cells of the count table, dealt into chunks; a bit of each is all that is sent to every task.
CELL_BITS, CHUNK_BITS = 20, 14
#: Cells with so many times the mean, and so many standard deviations of chance more, are common.
COMMON, CHANCE = 1.2, 4
#: Tasks whose counts are added up at once.
TASKS = 64
#: The share of a set's n-grams that may be common without more keys.
SPARE = 0.2
#: Keys in a bucket, about; their number in bytes and that of a set's name, as they are shuffled. Keys or names that fall
#: together only make more candidates.
BUCKET_KEYS, SHORT = 2_000_000, 5
#: n-grams in a block; larger candidate groups are joined block by block.
BLOCK_GRAMS = 4_000_000
#: Candidates up to so many (some 120 bytes each) are sent to the texts; more and the texts are shuffled to them.
SENT_ROWS = 100_000
#: What the bits of a block's common n-grams may take.
BITMAP_BYTES = 32 << 20


@dataclass(frozen=True)
class Rule:
    """Runs of ``words`` words; a link from ``percent`` percent Jaccard similarity on."""

    words: int = 5
    percent: int = 80

    def needed(self, a: int, b: int) -> int:
        """The least intersection of linked sets of these sizes: 100 * i >= percent * (a + b - i)."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def bands(self, n: int) -> list[int]:
        """Size bands of a set and of the larger ones it may link with; linked sets have one in common."""
        edges = _edges(self.percent)
        low, high = np.searchsorted(edges, [n, n * 100 // self.percent], "right")
        return list(range(int(low), int(high) + 1))


    def parts(self, band: int) -> tuple[int, int]:
        """Into how many parts a size band's n-grams are dealt, and how many of them a set may leave empty: as many as the
        band's least partners leave on average without some of their n-grams, and some more."""
        if (self.percent, band) not in _PARTS:
            edges = _edges(self.percent)
            least, most = (edges[band - 1] if band else 1) * self.percent / 100 * (1 - SPARE), int(edges[band]) - 1
            differ = 2 * most * (100 - self.percent) // (100 + self.percent)
            count = differ + 1
            for _ in range(4 if differ else 0):
                empty = count * np.exp(-least / count)
                count = differ + 1 + int(np.ceil(empty + np.sqrt(empty)))
            _PARTS[self.percent, band] = count, count - differ - 1
        return _PARTS[self.percent, band]


_EDGES: dict[int, np.ndarray] = {}
_PARTS: dict[tuple[int, int], tuple[int, int]] = {}


def _edges(percent: int) -> np.ndarray:
    """Sizes at which bands begin, each 1 / threshold times the one before."""
    if percent not in _EDGES:
        base = 100 / min(percent, 99)
        _EDGES[percent] = np.unique(np.ceil(base ** np.arange(1, int(np.log(1e12) / np.log(base)))))
    return _EDGES[percent]


# Common n-grams -------------------------------------------------------------------------------------------------------


def common_cells(docs: DataFrame, rule: Rule, text: str = "text") -> tuple[np.ndarray, int]:
    """Which cells the n-grams of all texts hit far more often than others, and how many n-grams there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            for part in slices(batch, "__text"):
                grams, _ = shingle_hashes(*flat(part.column("__text")), rule.words)
                np.add.at(total, grams >> U64(64 - CELL_BITS), 1)
        if total.any():
            rows = [chunk.tobytes() for chunk in total.reshape(-1, 1 << CHUNK_BITS).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], names=["chunk", "counts"])

    def added(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(1 << CHUNK_BITS, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    source = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{text}`").alias("__text"))
    made = source.mapInArrow(step("ngram_join", run), "chunk int, counts binary").withColumn("some", F.floor(F.spark_partition_id() / TASKS))
    some = made.groupBy("chunk", "some").applyInArrow(added, "chunk int, counts binary")
    found = some.groupBy("chunk").applyInArrow(added, "chunk int, counts binary").toArrow()
    counts = np.zeros((1 << (CELL_BITS - CHUNK_BITS), 1 << CHUNK_BITS), np.int64)
    for chunk, x in zip(found.column("chunk").to_pylist(), found.column("counts")):
        counts[chunk] = np.frombuffer(x.as_buffer(), np.int64)
    mean = counts.mean()
    return counts.ravel() > COMMON * mean + CHANCE * np.sqrt(mean) + 1, int(counts.sum())


# Sets -----------------------------------------------------------------------------------------------------------------

_SEEDS = mix(np.arange(11, 14, dtype=np.uint64))


def signature(grams: np.ndarray) -> bytes:
    """128 bits that name a set of hashes."""
    return b"".join(int(mix(grams ^ s).sum(dtype=np.uint64)).to_bytes(8, "big") for s in _SEEDS[:2])


def short_name(sig: bytes) -> int:
    """A set's name among candidates: the first bits of its signature."""
    return int.from_bytes(sig[:SHORT], "big")


def row_sets(column: pa.Array, rule: Rule) -> Iterator[np.ndarray]:
    grams, at = shingle_hashes(*flat(column), rule.words)
    for begin, end in zip(at[:-1], at[1:]):
        own = np.sort(grams[begin:end])
        yield own[np.concatenate((np.ones(min(1, len(own)), bool), own[1:] != own[:-1]))]


def signed(docs: DataFrame, keep: list[str], rule: Rule, text: str = "text") -> DataFrame:
    """Kept columns with ``n`` (size of the set), ``sig`` (its name; null if it is empty) and ``cid`` (40 bits of that)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                found = list(row_sets(part.column("__text"), rule))
                sigs = [signature(g) if len(g) else None for g in found]
                cids = [s and short_name(s) for s in sigs]
                made = [pa.array([len(g) for g in found], pa.int64()), pa.array(sigs, pa.binary()), pa.array(cids, pa.int64())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *made], names=[*keep, "n", "sig", "cid"])

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    return source.mapInArrow(step("ngram_join", run), extended(source, "n bigint, sig binary, cid bigint"))


# Candidates -----------------------------------------------------------------------------------------------------------


def _dealt(grams: np.ndarray, owner: np.ndarray, rows: int, count: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The parts that hold n-grams: owners, numbers and keys; and how many each owner has. Every owner's n-grams are in
    order; it has ``count`` parts, and ``salt`` goes into its keys."""
    if not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    part = (grams >> U64(32)) * count[owner] >> U64(32)
    starts = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (part[1:] != part[:-1]))))
    own, part = owner[starts], part[starts]
    return own, part, mix(np.add.reduceat(mix(grams ^ _SEEDS[2]), starts) + mix(salt[own] + part)), np.bincount(own, minlength=rows)


def part_keys(sets: list[np.ndarray], rule: Rule, common: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the set, key) of every key: linked sets of different n-grams have one in common.

    Two linked sets meet in the band of the larger one. Without common n-grams they differ in no more n-grams than before,
    so of the band's parts more agree than one of them leaves empty, unless both leave more empty than the band reckons
    with. Such sets also have the parts of all their n-grams as keys, and, if these leave as many empty, the numbers of
    the empty ones."""
    rows = [(i, band) for i, s in enumerate(sets) if len(s) for band in rule.bands(len(s)) if rule.parts(band)[0] > 1]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    number, bands = np.array(rows).T
    count, spare = np.array([rule.parts(b) for b in bands]).T
    salt = mix(bands.astype(np.uint64) << U64(32))
    rare = [s[~common(s)] for s in sets]

    def dealt(source: list[np.ndarray], chosen: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        picked = [source[i] for i in number[chosen]]
        owner = np.repeat(np.arange(len(picked)), [len(p) for p in picked])
        return _dealt(np.concatenate(picked), owner, len(picked), count[chosen].astype(np.uint64), salt)

    own, _, keys, full = dealt(rare, np.arange(len(rows)), salt)
    owners, found = [number[own]], [keys]
    short = np.flatnonzero(count - full > spare)
    if len(short):
        second = salt[short] + U64(1 << 62)
        own, part, keys, full = dealt(sets, short, second)
        owners.append(number[short[own]]), found.append(keys)
        for j in np.flatnonzero(count[short] - full > spare[short]):
            empty = np.setdiff1d(np.arange(count[short[j]], dtype=np.uint64), part[own == j])
            owners.append(np.full(len(empty), number[short[j]])), found.append(mix(mix(second[j] + empty) + U64(1)))
    return np.concatenate(owners), np.concatenate(found)


def _stars(cids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys in order, the least set that has each, and (set, least) of the others, each pair once."""
    order = np.lexsort((cids, keys))
    cids, keys = cids[order], keys[order]
    fresh = np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))
    least = cids[fresh][np.cumsum(fresh) - 1]
    rest = cids != least
    return keys[fresh], cids[fresh], np.unique(np.stack([cids[rest], least[rest]], 1), axis=0)


def met(cids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer (cid, key) rows that connect the same: of the sets here that share a key, the least stands for all; each other
    one meets that one at a key of its own."""
    keys, least, pairs = _stars(cids, keys)
    own = mix(pairs[:, 0].view(np.uint64) ^ _SEEDS[0])
    return np.concatenate((least, pairs[:, 0], pairs[:, 1])), np.concatenate((keys, own, own))


def _narrow(values: np.ndarray) -> np.ndarray:
    """The low bytes of 64-bit numbers, a row each."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :SHORT]


def _wide(rows: bytes) -> np.ndarray:
    out = np.zeros((len(rows) // SHORT, 8), np.uint8)
    out[:, :SHORT] = np.frombuffer(rows, np.uint8).reshape(-1, SHORT)
    return out.view("<u8").ravel()


def packed(cids: np.ndarray, keys: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(bucket, names, counts, keys) of each bucket that the keys' high bits deal rows into: a name and how many of the keys
    are its own (255 at most, then it comes again), and of the keys the low bits."""
    bucket = ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32)
    order = np.lexsort((cids, bucket))
    cids, keys, bucket = cids[order], _narrow(keys[order]), bucket[order]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(cids)), bool), (cids[1:] != cids[:-1]) | (bucket[1:] != bucket[:-1]))))
    sizes = np.diff(starts, append=len(cids))
    pieces = -(-sizes // 255)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(starts, pieces) + 255 * nth
    counts, names, of = np.diff(starts, append=len(cids)).astype(np.uint8), _narrow(cids[starts]), bucket[starts]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(of)), bool), of[1:] != of[:-1])))
    for a, b in zip(first, [*first[1:], len(of)]):
        yield int(of[a]), names[a:b].tobytes(), counts[a:b].tobytes(), keys[starts[a] : starts[b] if b < len(of) else len(keys)].tobytes()


def unpacked(names: bytes, counts: bytes, keys: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(cid, low bits of the key) of every row of a bucket, of as many of its pieces as are laid end to end."""
    return np.repeat(_wide(names).astype(np.int64), np.frombuffer(counts, np.uint8)), _wide(keys)


def candidates(docs: DataFrame, rule: Rule, text: str = "text") -> DataFrame:
    """(u, v): sets that share a key, each with the least of them. What a batch of texts shares is brought together before
    the shuffle, so a key that a third of all rows have is no third of the rows that are shuffled."""
    cells, grams = common_cells(docs, rule, text)
    shared = docs.sparkSession.sparkContext.broadcast(cells)
    buckets = 1 + int(grams * sum(rule.parts(b)[0] for b in rule.bands(1000)) / 1000 / BUCKET_KEYS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            cids, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for part in slices(batch, "__text"):
                sets = list(row_sets(part.column("__text"), rule))
                own, found = part_keys(sets, rule, lambda g: common[(g >> U64(64 - CELL_BITS)).astype(np.int64)])
                names = np.array([short_name(signature(s)) if len(s) else 0 for s in sets], np.int64)
                cids.append(names[own]), keys.append(found)
            rows = list(packed(*met(np.concatenate(cids), np.concatenate(keys)), buckets))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["bucket", "names", "counts", "keys"])

    def meet(table: pa.Table) -> pa.Table:
        _, _, pairs = _stars(*unpacked(*(b"".join(table.column(c).to_pylist()) for c in ("names", "counts", "keys"))))
        release()
        return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})

    rows = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{text}`").alias("__text")).mapInArrow(step("ngram_join", run), "bucket int, names binary, counts binary, keys binary")
    return rows.groupBy("bucket").applyInArrow(meet, "u bigint, v bigint")


# The trie -------------------------------------------------------------------------------------------------------------


class Trie:
    """Path-compressed trie of ordered sets; set ``i`` is the i-th in lexicographic order, so a subtree is a range."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        size = np.array([len(s) for s in sets])
        # node: begin, end (positions of its segment), first, last (its range of sets)
        self.begin, self.end, self.first, self.last = [0], [0], [0], [len(sets) - 1]
        self.children: list[list[int]] = [[]]
        shared = [0] + [self._common(sets[i - 1], sets[i]) for i in range(1, len(sets))]
        self._grow(0, 0, len(sets) - 1, 0, np.array(shared))
        self.least = [int(size[a : b + 1].min()) for a, b in zip(self.first, self.last)]
        self.most = [int(size[a : b + 1].max()) for a, b in zip(self.first, self.last)]

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def _grow(self, node: int, first: int, last: int, depth: int, shared: np.ndarray) -> None:
        todo = [(node, first, last, depth)]
        while todo:
            node, first, last, depth = todo.pop()
            while first <= last and len(self.sets[first]) == depth:  # sets that end here sort first
                first += 1
            at = first
            while at <= last:
                stop = at
                while stop < last and shared[stop + 1] > depth:
                    stop += 1
                end = len(self.sets[at]) if stop == at else int(shared[at + 1 : stop + 1].min())
                child = len(self.begin)
                self.begin.append(depth), self.end.append(end), self.first.append(at), self.last.append(stop), self.children.append([])
                self.children[node].append(child)
                todo.append((child, at, stop, end))
                at = stop + 1


def _ranked(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int, int]:
    """Each set as sorted ranks, the commonest n-gram of all first (ties by hash), how many different ones there are, and
    how many of them more than one set holds.

    Ranks have 32 bits and temporaries go as soon as they can: an executor's tasks hold several blocks at once."""
    every = np.concatenate(sets)
    order = np.argsort(every)
    every = every[order]
    fresh = np.concatenate(([True], every[1:] != every[:-1]))
    del every
    counts = np.diff(np.flatnonzero(fresh), append=len(fresh)).astype(np.int32)
    rank = np.empty(len(counts), np.int32)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
    number = np.cumsum(fresh, dtype=np.int32)
    number -= 1
    ranks = np.empty(len(order), np.int32)
    ranks[order] = rank[number]
    ranked = np.split(ranks, np.cumsum([len(s) for s in sets])[:-1])
    for one in ranked:
        one.sort()
    return ranked, len(counts), int((counts > 1).sum())


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1])))


class Holders:
    """Which sets hold each n-gram: bits for the commonest n-grams, a word for 64 of them and each set; lists for the rest.
    An n-gram of one set alone is in neither, as nothing shares it."""

    def __init__(self, ordered: list[np.ndarray], shared: int) -> None:
        rows = len(ordered)
        owner = np.repeat(np.arange(rows, dtype=np.int32), [len(r) for r in ordered])
        tokens = np.concatenate(ordered)
        words = min(-(-shared // 64), max(1, BITMAP_BYTES // (8 * rows)))
        self.in_bits, self.shared = min(words * 64, shared), shared
        self.bits = np.zeros((words, rows), np.uint64)
        low = np.flatnonzero(tokens < self.in_bits)
        if len(low):
            held, word = owner[low], tokens[low] >> 6
            starts = _runs(word.astype(np.int64) * rows + held)  # a set's ranks are in order
            self.bits[word[starts], held[starts]] = np.bitwise_or.reduceat(U64(1) << (tokens[low] & 63).astype(np.uint64), starts)
        self.before = np.zeros((words + 1, rows), np.int32)
        np.cumsum(np.bitwise_count(self.bits), 0, dtype=np.int32, out=self.before[1:])
        high = np.flatnonzero((tokens >= self.in_bits) & (tokens < shared))
        high = high[np.argsort(tokens[high], kind="stable")]
        self.owner = owner[high]
        self.at = np.searchsorted(tokens[high], np.arange(self.in_bits, shared + 1))

    def passed(self, rank: int, mine: np.ndarray) -> np.ndarray:
        """How many n-grams up to this rank (one of those in bits) each of these sets holds."""
        word, mask = rank >> 6, U64((2 << (rank & 63)) - 1)
        return self.before[word, mine] + np.bitwise_count(self.bits[word, mine] & mask)

    def overlap(self, segment: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """How many n-grams of a segment (ranks in order) each of these sets (numbers in order) holds."""
        found = np.zeros(len(mine), np.int64)
        low, end = np.searchsorted(segment, [self.in_bits, self.shared])
        if low:
            word = segment[:low] >> 6
            starts = _runs(word)
            masks = np.bitwise_or.reduceat(U64(1) << (segment[:low] & 63).astype(np.uint64), starts)[:, None]
            word = word[starts]
            step = max(1, (1 << 18) // len(mine))
            for i in range(0, len(word), step):
                found += np.bitwise_count(self.bits[word[i : i + step, None], mine] & masks[i : i + step]).sum(0, dtype=np.int64)
        if end > low:
            numbers = segment[low:end] - self.in_bits
            begin, stop = self.at[numbers], self.at[numbers + 1]
            sizes = stop - begin
            holders = self.owner[np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
            place = np.minimum(np.searchsorted(mine, holders), len(mine) - 1)
            found += np.bincount(place[mine[place] == holders], minlength=len(mine))
        return found


def block_links(sets: list[np.ndarray], rule: Rule, part: np.ndarray | None = None, home: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A forest of pairs of numbers of linked sets, which connects what is connected, and how many links each set has: all
    pairs count. Sets are hashes, different and not empty. Sets of one part whose ``home`` is false are not compared with
    each other (another task does).

    All sets go down the trie together: at a node those stay whose overlap with its path, by size, position and what
    remains, can still reach the threshold with a set below it."""
    if len(sets) < 2:
        return [], np.zeros(len(sets), np.int64)
    ranked, different, shared = _ranked(sets)
    order = sorted(range(len(sets)), key=lambda i: ranked[i].astype(">u4").tobytes())
    ordered = [ranked[i] for i in order]
    del ranked
    trie, holders = Trie(ordered), Holders(ordered, shared)
    size = np.array([len(r) for r in ordered], np.int64)
    begins = np.cumsum(size) - size
    part = np.zeros(len(order), np.int64) if part is None else np.asarray(part)[order]
    home = np.ones(len(order), bool) if home is None else np.asarray(home)[order]
    keys = np.repeat(np.arange(len(ordered)), size) * np.int64(different) + np.concatenate(ordered)  # (set, n-gram), in order

    def needed(a: np.ndarray, b: int) -> np.ndarray:
        return -(-rule.percent * (a + b) // (100 + rule.percent))

    above = np.arange(len(ordered))  # union-find

    def roots(of: np.ndarray) -> np.ndarray:
        at = above[of]
        while True:
            up = above[at]
            if (up == at).all():
                above[of] = at
                return at
            at = up

    counts = np.zeros(len(ordered), np.int64)
    links = []
    every = np.arange(len(ordered))
    stack = [(c, every, np.zeros(len(ordered), np.int64)) for c in reversed(trie.children[0])]
    while stack:
        node, mine, overlap = stack.pop()
        first, last, depth = trie.first[node], trie.last[node], trie.end[node]
        # A pair is met at the later of its sets.
        upto = int(np.searchsorted(mine, last))
        mine, overlap = mine[:upto], overlap[:upto]
        n = size[mine]
        stay = (n * 100 >= rule.percent * trie.least[node]) & (n * rule.percent <= 100 * trie.most[node])
        # Nothing that a set lacks of the path so far comes back: the most that can be shared is known before the segment.
        stay &= overlap + trie.most[node] - trie.begin[node] >= needed(n, trie.least[node])
        mine, overlap = mine[stay], overlap[stay]
        if not len(mine):
            continue
        segment = ordered[first][trie.begin[node] : depth]
        overlap = overlap + holders.overlap(segment, mine)
        n = size[mine]
        if size[first] == depth:  # one set at most ends here
            linked = mine[(mine < first) & (overlap >= needed(n, depth)) & ((part[mine] != part[first]) | home[first])]
            counts[linked] += 1
            counts[first] += len(linked)
            if len(linked):
                found, where = np.unique(roots(linked), return_index=True)
                own = roots(np.array([first]))[0]
                fresh = found != own
                links += [(order[x], order[first]) for x in linked[where[fresh]]]
                above[found[fresh]] = own
        if trie.children[node]:
            low = trie.least[node]
            end = int(segment[-1])
            passed = holders.passed(end, mine) if end < holders.in_bits else np.searchsorted(keys, mine * different + end, "right") - begins[mine]
            stay = (overlap + trie.most[node] - depth >= needed(n, low)) & (overlap + n - passed >= needed(n, low))
            mine, overlap = mine[stay], overlap[stay]
            if len(mine):
                stack.extend((c, mine, overlap) for c in reversed(trie.children[node]))
    found = np.zeros(len(order), np.int64)
    found[order] = counts
    return links, found


# The join -------------------------------------------------------------------------------------------------------------


def _tasks(members: DataFrame, rule: Rule, block: int) -> DataFrame:
    """Adds ``tasks``: the blocks of its candidate group that each set takes part in. A small group is one block. A larger
    one is cut into size bands of ratio 1 / threshold, and those by hash into parts; a part meets the parts of its own
    band and of the two next to it, since no others hold sets of similar size. ``side`` tells a component's parts apart;
    pairs of one part belong to the first of its tasks, all others meet in one task only."""
    ratio = float(np.log(100 / rule.percent)) if rule.percent < 100 else 0.01
    sized = members.withColumn("band", F.floor(F.log("n") / ratio + 1e-9))
    bands = sized.groupBy("component", "band").agg(F.sum("n").alias("grams"))
    whole = bands.groupBy("component").agg(F.sum("grams").alias("all_grams"))
    parts = bands.withColumn("parts", F.ceil(F.col("grams") / block))
    near = [parts.select("component", (F.col("band") - step).alias("band"), F.col("parts").alias(name)) for step, name in ((1, "above"), (-1, "below"))]
    parts = parts.join(whole, "component").join(near[0], ["component", "band"], "left").join(near[1], ["component", "band"], "left")

    def numbers(count: Column) -> Column:
        return F.when(F.coalesce(count, F.lit(0)) > 0, F.sequence(F.lit(0).cast("bigint"), count - 1)).otherwise(F.array().cast("array<bigint>"))

    mine = sized.join(parts.drop("grams"), ["component", "band"]).withColumn("part", F.pmod(F.xxhash64("sig"), "parts"))
    name = lambda b1, i1, b2, i2: F.concat_ws(":", b1, i1, b2, i2)
    band, part = F.col("band"), F.col("part")
    # A task compares all that it holds, so a part needs one of its own only where it meets no other.
    own = F.transform(F.filter(numbers(F.col("parts")), lambda j: j != part), lambda j: name(band, F.least(part, j), band, F.greatest(part, j)))
    alone = (F.col("parts") == 1) & F.col("above").isNull() & F.col("below").isNull()
    up = F.transform(numbers(F.col("above")), lambda j: name(band, part, band + 1, j))
    down = F.transform(numbers(F.col("below")), lambda j: name(band - 1, j, band, part))
    tasks = F.when(F.col("all_grams") <= block, F.array(F.lit("all"))).when(alone, F.array(name(band, part, band, part))).otherwise(F.concat(own, up, down))
    return mine.withColumn("tasks", tasks).withColumn("side", F.xxhash64("band", "part")).select("sig", "rep", "n", "component", "tasks", "side")


def links(docs: DataFrame, marked: DataFrame, rule: Rule, text: str = "text", block: int = BLOCK_GRAMS) -> DataFrame:
    """Links (u, v) between signatures of different sets, enough to connect what is connected, and rows (u, null, n) whose
    sum for a signature is the number of different sets linked with it. ``marked`` is :func:`signed` with ``doc_id`` kept."""
    groups = components(candidates(docs, rule, text))
    classes = marked.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("cid").alias("cid"))
    members = classes.join(groups.withColumnRenamed("node", "cid"), "cid")
    members = stage(members, "members")
    chosen = _tasks(members, rule, block).withColumnRenamed("sig", "member")
    texts = docs.select(F.col("doc_id").alias("__id"), F.col(text).alias("__text"))
    if members.count() <= SENT_ROWS:
        chosen = F.broadcast(chosen)
    else:
        texts, chosen = perhaps_among(texts, F.col("__id"), members, F.col("rep")), chosen.hint("merge")
    texts = texts.join(chosen, F.col("__id").eqNullSafe(F.col("rep")))

    def joined(table: pa.Table) -> pa.Table:
        by_sig: dict[bytes, tuple[np.ndarray, int, bool]] = {}
        for batch in table.to_batches():
            for part in slices(batch, "__text"):
                columns = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("member", "side", "place"))
                for grams, sig, side, place in zip(row_sets(part.column(part.schema.get_field_index("__text")), rule), *columns):
                    if sig not in by_sig and len(grams) and signature(grams) == sig:  # rows may share an id, and a text too
                        by_sig[sig] = grams, side, place == 0
        names = sorted(by_sig)
        own, sides, homes = ([by_sig[s][k] for s in names] for k in range(3))
        found, counts = block_links(own, rule, np.array(sides, np.int64), np.array(homes, bool))
        del own, by_sig
        release()
        some = np.flatnonzero(counts)
        u, v = [names[a] for a, _ in found] + [names[i] for i in some], [names[b] for _, b in found] + [None] * len(some)
        return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary()), "n": pa.array([0] * len(found) + counts[some].tolist(), pa.int64())})

    blocks = texts.select("__text", "component", F.posexplode("tasks").alias("place", "task"), "side", "member")
    return blocks.groupBy("component", "task").applyInArrow(joined, "u binary, v binary, n bigint")


def groups(docs: DataFrame, rule: Rule, keep: list[str] | None = None, text: str = "text", block: int = BLOCK_GRAMS) -> DataFrame:
    """Each row's kept columns (``doc_id`` among them) with ``n_shingles`` (size of its set), ``component_id`` (the least
    doc_id that links reach from it), ``class_id`` (the least doc_id with an equal set), ``n_links`` (how many different
    sets are linked with its own; exact) and ``group`` (bytes that name the group; null for an empty set).

    A null text, or one without words, has an empty set: it is linked with nothing and is its own component. Equal sets
    are linked, but count in ``n_links`` as one. Rows may repeat, and rows of null or shared ids are told apart by their sets; ``component_id``
    and ``class_id`` leave null ids out and are null only where there is no other. An empty table gives an empty one."""
    keep = keep or ["doc_id"]
    if "doc_id" not in keep or set(keep) & {"n_shingles", "component_id", "class_id", "n_links", "group", "n", "sig", "cid"}:
        raise ValueError("keep doc_id, and no column with the name of an added one")
    marked = stage(signed(docs, keep, rule, text), "sets")
    met = stage(links(docs, marked, rule, text, block), "links")
    roots = components(met.where("v is not null").select("u", "v"))
    linked = met.where("v is null").groupBy(F.col("u").alias("sig")).agg(F.sum("n").alias("n_links"))
    classes = marked.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"))
    placed = classes.join(roots.withColumnRenamed("node", "sig"), "sig", "left").join(linked, "sig", "left")
    placed = placed.select("sig", "rep", F.coalesce("component", "sig").alias("group"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    least = placed.groupBy("group").agg(F.min("rep").alias("component_id"))
    where = placed.join(least, "group").select("sig", "group", "component_id", F.col("rep").alias("class_id"), "n_links")
    columns = [F.col(f"`{c}`") for c in keep]
    added = ["component_id", "class_id", "n_links", "group"]
    with_set = marked.where("n > 0").join(where, "sig").select(*columns, F.col("n").alias("n_shingles"), *added)
    alone = [F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(None).cast("binary").alias("group")]
    return with_set.unionByName(marked.where("n = 0").select(*columns, F.col("n").alias("n_shingles"), *alone))
