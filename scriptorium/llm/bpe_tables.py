"""What a byte-level BPE vocabulary file says, as tables: token bytes, merges, and which neighbours BPE leaves apart."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import regex

#: Fixed values of the byte-level pre-tokenizer: the pattern, and the byte ranges that stand for themselves.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))

_ANY = regex.compile(PRETOKEN)
#: The same language over texts of U+0000 to U+024F without the odd characters on which ``re`` and Unicode classes
#: differ (U+001C to U+001F, superscript digits and fractions); twice as fast.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_PLAIN = re.compile(rf" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
_ODD = re.compile("[^\\x00-\\x1b\\x20-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f]")


def pretokens(text: str) -> list[str]:
    """The pieces within which merges happen; together they are the text."""
    return (_ANY if _ODD.search(text) else _PLAIN).findall(text)


def byte_symbols() -> dict[str, int]:
    """Symbol to byte: printable bytes stand for themselves, the others are numbered from U+0100 in order."""
    own = {b for low, high in PRINTABLE for b in range(low, high + 1)}
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tables:
    """``ids`` are ranks here: single bytes first, then tokens in the order of their merges. ``public`` turns a rank into
    the file's id. Only files whose pieces are exactly bytes plus merges are taken."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = spec["normalizer"] is None and pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]
        if model["type"] != "BPE" or not plain or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE file")
        symbols = byte_symbols()
        raw = lambda token: bytes(symbols[c] for c in token)
        vocab = {raw(token): i for token, i in model["vocab"].items()}
        self.pieces: list[bytes] = [bytes([b]) for b in range(256)]
        rank = {p: i for i, p in enumerate(self.pieces)}
        self.split: list[tuple[int, int]] = [(i, i) for i in range(256)]
        self.merge: dict[tuple[int, int], int] = {}
        for pair in model["merges"]:
            left, right = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            pair_ranks, whole = (rank[left], rank[right]), left + right
            if whole in rank:
                raise ValueError("a token has two merges")
            rank[whole] = self.merge[pair_ranks] = len(self.pieces)
            self.split.append(pair_ranks)
            self.pieces.append(whole)
        if set(rank) != set(vocab):
            raise ValueError("vocabulary and merges differ")
        self.rank, self.public = rank, [vocab[p] for p in self.pieces]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError("added tokens with rules of their own")
        self._added = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self._apart: dict[int, bool] = {}

    def sections(self, text: str) -> list[tuple[str, int | None]]:
        """Text cut at the strings of added tokens: (stretch, None) or (string, its id)."""
        if not self._added or not any(x in text for x in self.added):
            return [(text, None)] if text else []
        return [(x, self.added.get(x)) for x in self._added.split(text) if x]

    def apart(self, left: int, right: int) -> bool:
        """True if BPE, given the bytes of these two tokens in a row, ends with just these two.

        Undo the later of the two tokens' merges, step by step, and see whether at the moment that both inner neighbours
        existed, a merge across the border was due first. An answer is kept per pair (the pair-compatibility table)."""
        key = left << 20 | right
        known = self._apart.get(key)
        if known is not None:
            return known
        a, b, before, answer = left, right, len(self.pieces), True
        while True:
            across = self.merge.get((a, b))
            if across is not None and across < before:
                answer = False
                break
            if a < 256 and b < 256:
                break
            if a > b:  # of two merges, the later one is undone; only the part at the border matters
                before, a = a, self.split[a][1]
            else:  # at equal rank the left copy is merged first
                before, b = b + 1, self.split[b][0]
        if len(self._apart) > 1_000_000:
            self._apart.clear()
        self._apart[key] = answer
        return answer

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE by repeatedly merging the first of the lowest pairs: slow, for tests and odd cases."""
        parts = list(data)
        while len(parts) > 1:
            best = min(((self.merge.get(p, len(self.pieces)), i) for i, p in enumerate(zip(parts, parts[1:]))))
            if best[0] == len(self.pieces):
                break
            parts[best[1] : best[1] + 2] = [best[0]]
        return parts


@lru_cache(maxsize=2)
def tables(path: str) -> Tables:
    return Tables(path)
