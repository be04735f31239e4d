"""Interleaved document sequences with media columns.

HTML parsing turns a page into an ordered array of structs: text, or a reference to media with its caption. A media store
holds payloads as losslessly stored 8-bit samples, named by the digest of the stored form; a join on the digest resolves
references, and position and caption stay on the row that is resolved.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import extended

#: Samples in a row of a stored image; payloads are padded with blanks to a multiple.
WIDTH = 192
#: A media reference in ``src`` begins so and goes on with the digest of the stored form.
SCHEME = "media:"
ITEM = "struct<pos:int,kind:string,text:string,digest:string,caption:string>"

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Elements whose text is no prose; those of them that any element but ``HEAD_ONLY`` ends, as HTML lets their end tags out.
_SILENT, _HEAD = {"script", "style", "head", "title", "template"}, {"head", "title"}
_HEAD_ONLY = {"base", "link", "meta", "title", "script", "style", "noscript", "template", "head", "html"}
#: Elements that end a text item, and those of them that no figure holds.
_BLOCK = {"p", "div", "article", "section", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "table", "blockquote", "figure", "header", "footer", "nav", "body", "main", "aside", "pre"}
_OUTSIDE = {"article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "header", "footer", "nav", "body", "main"}


def padded(text: bytes) -> bytes:
    """The text with bytes 32 appended up to a positive multiple of ``WIDTH``."""
    return text + b" " * (WIDTH - len(text) % WIDTH if len(text) % WIDTH or not text else 0)


def store(payload: bytes) -> bytes:
    """A greyscale PNG of 8-bit samples, ``WIDTH`` wide."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with filter type 0
    raw[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def load(media: bytes) -> bytes:
    """The samples of :func:`store`'s form; ValueError on anything that is damaged or of another kind."""
    if media[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, packed, size = 8, [], None
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + data):
            raise ValueError("a damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + n
    if size is None or size[0] != WIDTH or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("another kind of image")
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(size[1], WIDTH + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Sample statistics: number of distinct values, mean, deviation, entropy in bits."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts / counts.sum()
    mean = float(share @ np.arange(256))
    deviation = float(np.sqrt(share @ (np.arange(256) - mean) ** 2))
    p = share[share > 0]
    return f"distinct={len(p)};mean={mean:.4f};deviation={deviation:.4f};entropy={abs(float((p * np.log2(p)).sum())):.4f}"


_TAG = re.compile("<[A-Za-z/!?]")


class _Sequence(HTMLParser):
    """Items in the order of the page. ``figures`` are the open ones, inner ones last, each with its media, its caption so
    far and what it lies in; ``caption`` says whether the innermost one's caption is open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent: Counter[str] = Counter()  # open elements whose text is no prose
        self.figures: list[dict] = []
        self.caption = self.sourceless = False
        self.depth: Counter[str] = Counter()  # open elements that may hold a figure

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Of any kind: what it is in HTML, a comment up to the next sign that ends a tag."""
        return self.rawdata.find(">", i) + 1 or -1

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.items.append({"pos": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})
        self.words = []

    def end_figure(self) -> None:
        """Media without a caption in an inner figure get that of the one around it."""
        own = self.figures.pop()
        caption = " ".join("".join(own["caption"]).split())
        if caption:
            for item in own["media"]:
                item["caption"] = caption
        elif self.figures:
            self.figures[-1]["media"] += own["media"]
        self.caption = False

    def media(self, src: str, alt: str | None) -> None:
        self.flush()
        digest = src[len(SCHEME) :] if src.startswith(SCHEME) else None
        item = {"pos": len(self.items), "kind": "media", "text": None if digest else src, "digest": digest, "caption": alt or None}
        self.items.append(item)
        if self.figures:
            self.figures[-1]["media"].append(item)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in _HEAD_ONLY:
            self.silent["head"] = self.silent["title"] = 0
        if tag in _SILENT:
            self.silent[tag] += 1
        if any(self.silent.values()):
            return
        if tag in _OUTSIDE:
            while self.figures:
                self.end_figure()
        if tag in _BLOCK:
            self.flush()
            if self.caption and self.figures[-1]["said"]:
                self.caption = False  # its end tag is missing, or what follows is prose of its own
        own = dict(attrs)
        if tag == "figure":
            self.figures.append({"media": [], "caption": [], "said": False, "depth": self.depth.copy()})
            self.caption = False
        elif tag == "figcaption":
            self.flush()
            self.caption = bool(self.figures)
        elif tag in ("img", "video", "audio"):
            self.sourceless = tag != "img" and not own.get("src")
            if own.get("src"):
                self.media(own["src"], own.get("alt"))
        elif tag == "source" and self.sourceless and own.get("src"):
            self.sourceless = False  # the first that is given
            self.media(own["src"], None)
        elif tag in ("div", "li", "td", "article", "section", "main", "body"):
            self.depth[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.silent["head"] = self.silent["title"] = 0
        elif self.silent[tag] > 0:
            self.silent[tag] -= 1
        if any(self.silent.values()):
            return
        while self.figures and 0 < self.depth[tag] <= self.figures[-1]["depth"][tag]:
            self.end_figure()  # what it lies in ends
        if self.depth[tag] > 0:
            self.depth[tag] -= 1
        if tag in _BLOCK:
            self.flush()
        if tag == "figcaption":
            self.caption = False
        elif tag == "figure" and self.figures:
            self.end_figure()
        elif tag in ("video", "audio"):
            self.sourceless = False

    def handle_data(self, data: str) -> None:
        if any(self.silent.values()):
            return
        if self.caption:
            self.figures[-1]["said"] |= bool(data.strip())
        (self.figures[-1]["caption"] if self.caption else self.words).append(data)


def _closed(html: str) -> str:
    """With an end to a comment or tag that the page breaks off in: the parser would look for it again and again."""
    if html.rfind("<!--") > html.rfind("-->"):
        return html + "-->"
    return html + ">" if _TAG.search(html, html.rfind(">") + 1) else html


def sequence(html: str | None) -> list[dict]:
    """A page's items in order. A figure's caption goes to its media (else ``alt``), an outer figure's only to those that no
    inner caption names; media without the store's scheme keep their address in ``text`` and have no digest, a video's or
    audio's first source stands for it. Missing end tags are filled in as HTML has it: a head ends with the first element
    that is no part of one, a figure with what it lies in or before a section or heading, its caption with the figure or
    with a block after the caption's first. Any characters make a page; no page, no items."""
    parser = _Sequence()
    parser.feed(_closed(html or ""))
    parser.close()
    while parser.figures:
        parser.end_figure()
    parser.flush()
    return parser.items


def sequences(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """Each page's kept columns with ``items``: an array of :data:`ITEM`. A null page has an empty array; repeated pages
    are each parsed; an empty table gives an empty one. No kept column may be named ``items``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            items = pa.array([sequence(x.as_py()) for x in batch.column("__html")], kind)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], items], names=[*keep, "items"])

    if "items" in keep:
        raise ValueError("a kept column is named items")
    source = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").alias("__html"))
    return source.mapInArrow(run, extended(source, f"items array<{ITEM}>"))


def resolve(seqs: DataFrame, media: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each media item: kept columns, ``pos``, ``caption``, ``digest`` and what ``media`` has of that digest
    (nulls where it has nothing). ``media`` has one row a digest, so a digest that a third of all items refer to is only
    met by small rows, whose partition Spark may split. Repeated pages give repeated rows; a null digest meets nothing; empty
    tables give an empty one. No kept column may have the name of an added one (ValueError)."""
    if set(keep) & {"pos", "caption", *media.columns}:
        raise ValueError("a kept column has the name of an added one")
    items = seqs.select(*[F.col(f"`{c}`") for c in keep], F.explode("items").alias("item")).where("item.kind = 'media'")
    items = items.select(*[F.col(f"`{c}`") for c in keep], "item.pos", "item.caption", "item.digest")
    return items.join(media, "digest", "left")


def stored_documents(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Each document as a page that shows its text as an image, a line before and one after it: kept columns, ``n_bytes`` of
    the text, ``html``, ``digest`` and ``media`` (the stored form). A null text counts as empty, equal texts have equal
    forms, an empty table gives an empty one. No kept column may have the name of an added one (ValueError)."""
    if set(keep) & {"n_bytes", "html", "digest", "media"}:
        raise ValueError("a kept column has the name of an added one")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("__text")
            for begin in range(0, batch.num_rows, 64):  # a few stored forms at a time
                part = batch.slice(begin, 64)
                raw = [(x.as_py() or "").encode() for x in column.slice(begin, 64)]
                media = [store(padded(x)) for x in raw]
                digest = [hashlib.sha256(m).hexdigest() for m in media]
                html = [
                    f'<article><p>{len(x.split())} words<figure><img src="{SCHEME}{d}"><figcaption>{len(x)} bytes</figcaption></figure><p>{x.count(b"\n") + 1} lines</article>'
                    for d, x in zip(digest, raw)
                ]
                made = [pa.array([len(x) for x in raw], pa.int64()), pa.array(html), pa.array(digest), pa.array(media, pa.binary())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *made], names=[*keep, "n_bytes", "html", "digest", "media"])

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    return source.mapInArrow(run, extended(source, "n_bytes bigint, html string, digest string, media binary"))


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes of (digest, media) give when read back; one row a digest, repeats being equal. No media, no rows;
    ValueError on media that are null or no stored form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, stored in zip(batch.column("digest"), batch.column("media")):
                form = stored.as_py() or b""
                payload = load(form)
                rows.append((digest.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(form), hashlib.sha256(form).hexdigest(), feature(payload)))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=names)

    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    made = media.select("digest", "media").mapInArrow(run, schema)
    return made.groupBy("digest").agg(*[F.min(c).alias(c) for c in names[1:]])
