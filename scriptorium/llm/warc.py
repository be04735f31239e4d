"""WARC derivatives: from response records, the metadata and plain-text conversion records that refer to them.

Every derivative names its source by WARC-Refers-To, keeps the source's target address, date, other headers and payload
digest, and has an identifier and block digest of its own. All of it is expressions on columns, but for character
references, which an Arrow step resolves; records are only turned to bytes (and read again) at the edges.

Every pattern takes time in proportion to the page: what a page leaves open reaches to its end, as HTML has it, and no
pattern for a tag looks beyond the next tag.
"""

from __future__ import annotations

import gzip
import html as standard
import io
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Elements whose content is no text of the page, what ends a head without an end tag, and elements that begin a line.
HIDDEN = ("script", "style", "noscript", "template", "svg")
FLOW = r"body|p|div|h[1-6]|article|section|main|nav|header|footer|aside|table|ul|ol|dl|form|a|span|b|i|em|strong|img|blockquote|pre|figure|br|hr"
BLOCKS = ("p", "div", "br", "hr", "li", "ul", "ol", "dl", "dt", "dd", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "nav", "article", "section", "header", "footer", "main", "aside", "blockquote", "pre", "figure", "figcaption", "title", "body", "form", "option")

#: The steps from HTML to text: pattern (in the common part of Java's and RE2's languages) and replacement, in order.
TEXT_STEPS = (
    (r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{t}(?:\s[^<>]*)?>.*?(?:</{t}\s*>|\z)" for t in HIDDEN), ""),
    (rf"(?is)<head(?:\s[^<>]*)?>.*?(?:</head\s*>|(?=<(?:{FLOW})[\s>/])|\z)", ""),
    (r"(?i)</?(?:" + "|".join(BLOCKS) + r")(?:\s[^<>]*)?/?>", "\n"),
    (r"</?[A-Za-z!?][^<>]*>", ""),
)
#: A character reference; the standard's table tells how far a name reaches.
REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?")
#: How blanks are settled afterwards.
SPACE_STEPS = ((r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+", ""), (r"[ \n]+$", ""))
TITLE, LANGUAGE, LINKS = r"(?i)<title(?:\s[^<>]*)?>([^<]*)", r'(?i)<html(?:\s[^<>]*?)?\slang="([^"<>]*)"', r"(?i)<a\s[^<>]*?href="
#: The date of pages whose source names none.
NO_DATE = "1970-01-01T00:00:00Z"

#: Blocks of records read that leave in one batch.
BATCH_BYTES = 8 << 20


def _resolved(m: re.Match) -> str:
    return standard.unescape(m[0]).replace("\u00a0", " ")


def unescape(text: str) -> str:
    """All named and numeric references of HTML5 resolved once; one to a no-break space gives a blank."""
    return REFERENCE.sub(_resolved, text)


@F.arrow_udf(StringType())
def resolve(column: pa.Array) -> pa.Array:
    return pa.array([t if t is None or "&" not in t else unescape(t) for t in column.to_pylist()], pa.string())


def page_text(html: Column) -> Column:
    """The plain text of a page, a line for each block."""
    for pattern, by in TEXT_STEPS:
        html = F.regexp_replace(html, pattern, by)
    html = resolve(html)
    for pattern, by in SPACE_STEPS:
        html = F.regexp_replace(html, pattern, by)
    return html


def identifier(kind: Column, key: Column, uri: Column, payload: Column) -> Column:
    """A record id that reruns repeat: a digest of kind, key, address and the source's payload in the form of a UUID."""
    h = F.md5(F.concat(kind, F.lit("|"), F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), uri, F.lit("|"), payload))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame, key: str = "page_id", uri: str = "url", html: str = "html", date: Column | None = None) -> DataFrame:
    """Pages as response records: ``key``, record_id, target_uri, date, headers (map) and payload.

    Null addresses and pages count as empty; line ends in an address are percent-encoded, so none adds a header. ``date`` is
    when a page was fetched (a timestamp; ``NO_DATE`` without one, or where it is null). Other columns don't matter, whatever
    their names; an empty table gives an empty one."""
    address, payload = F.coalesce(F.col(f"`{uri}`"), F.lit("")), F.coalesce(F.col(f"`{html}`"), F.lit(""))
    address = F.replace(F.replace(address, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    when = F.lit(NO_DATE) if date is None else F.coalesce(F.date_format(F.to_utc_timestamp(date, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(NO_DATE))
    rows = pages.select(F.col(f"`{key}`").alias("key"), address.alias("target_uri"), when.alias("date"), payload.alias("payload"))
    headers = F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("Content-Length"), F.octet_length("payload").cast("string"))
    name = identifier(F.lit("response"), F.col("key"), F.col("target_uri"), digest(F.col("payload")))
    return rows.select("key", name.alias("record_id"), "target_uri", "date", headers.alias("headers"), "payload")


def derivatives(source: DataFrame) -> DataFrame:
    """The metadata and the conversion record of each response: key, warc_type, record_id, refers_to, target_uri, date,
    content_type, content_length (bytes), block_digest, source_digest (of the response's payload), source_headers (map)
    and block (string).

    ``source`` is as :func:`responses` makes it. An empty payload gives an empty conversion; repeated responses give
    repeated records with equal ids; no responses, no records."""
    html = F.col("payload")
    # Line breaks may be written as references too, so blanks are folded after they are resolved: no title adds a field.
    title = F.trim(F.regexp_replace(resolve(F.regexp_extract(html, TITLE, 1)), r"[ \t\r\n\f]+", " "))
    fields = F.concat(
        F.lit("title: "), title,
        F.lit("\r\nlanguage: "), F.regexp_extract(html, LANGUAGE, 1),
        F.lit("\r\noutlinks: "), F.regexp_count(html, F.lit(LINKS)).cast("string"),
        F.lit("\r\n"),
    )
    rows = source.select(
        "key", "record_id", "target_uri", "date", F.col("headers").alias("source_headers"), digest(html).alias("source_digest"),
        F.explode(F.array(
            F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
            F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain; charset=utf-8").alias("content_type"), page_text(html).alias("block")),
        )).alias("made"),
    )
    rows = rows.select("key", F.col("record_id").alias("refers_to"), "target_uri", "date", "source_headers", "source_digest", "made.*")
    return rows.select(
        "key", F.col("kind").alias("warc_type"), identifier(F.col("kind"), F.col("key"), F.col("target_uri"), F.col("source_digest")).alias("record_id"), "refers_to",
        "target_uri", "date", "content_type", F.octet_length("block").cast("bigint").alias("content_length"), digest(F.col("block")).alias("block_digest"),
        "source_digest", "source_headers", "block",
    )


# Bytes at the edges ---------------------------------------------------------------------------------------------------


def serialise(warc_type: str, record_id: str, target_uri: str, date: str, content_type: str, block: bytes, more: dict[str, str]) -> bytes:
    """One WARC/1.1 record. ValueError for a line end in a header."""
    headers = {"WARC-Type": warc_type, "WARC-Record-ID": record_id, "WARC-Date": date, "WARC-Target-URI": target_uri, **more, "Content-Type": content_type, "Content-Length": str(len(block))}
    if any("\r" in x or "\n" in x for pair in headers.items() for x in pair if x):
        raise ValueError("a line end in a header")
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(file: BinaryIO) -> dict[str, str]:
    """Header lines up to the blank one. Names count without regard to case and are told as they are first met (those of the
    standard as it has them); a repeated header's values are joined by commas, a line that begins with a blank goes on
    with the one before."""
    found: dict[str, str] = {}
    names = {n.lower(): n for n in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Refers-To", "WARC-Block-Digest", "Content-Type", "Content-Length")}
    last = None
    while line := file.readline():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            return found
        if text[0] in " \t" and last:
            found[last] = f"{found[last]} {text.strip()}".strip()
            continue
        name, colon, value = text.partition(":")
        if not colon:
            raise ValueError(f"no header: {text[:80]!r}")
        last = names.setdefault(name.strip().lower(), name.strip())
        found[last] = f"{found[last]}, {value.strip()}" if last in found else value.strip()
    raise ValueError("headers without an end")


def parse(data: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file, plain or gzip (a member a record, or any), one record at a time; ValueError
    where it is damaged."""
    file = io.BufferedReader(io.BytesIO(data) if isinstance(data, bytes) else data)
    if file.peek(2)[:2] == b"\x1f\x8b":
        file = io.BufferedReader(gzip.GzipFile(fileobj=file))
    try:
        while line := file.readline():
            if not line.strip():  # blank lines between records
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record: {line[:80]!r}")
            headers = _headers(file)
            size = headers.get("Content-Length", "")
            if not size.isdigit():
                raise ValueError("a record without a length")
            block = file.read(int(size))
            if len(block) < int(size) or file.read(4) != b"\r\n\r\n":
                raise ValueError("a record of another length")
            yield headers, block
    except (EOFError, OSError, zlib.error) as broken:
        raise ValueError("damaged compression") from broken


def to_bytes(records: DataFrame) -> DataFrame:
    """(record_id, record): the bytes of every derivative, ready to be laid end to end in files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                more = {"WARC-Refers-To": r["refers_to"], "WARC-Block-Digest": r["block_digest"], "WARC-Refers-To-Payload-Digest": r["source_digest"]}
                more |= {f"WARC-Source-{k}": v for k, v in r["source_headers"]}
                rows.append(serialise(r["warc_type"], r["record_id"], r["target_uri"], r["date"], r["content_type"], r["block"].encode(), more))
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array(rows, pa.binary())], names=["record_id", "record"])

    return records.drop("key").mapInArrow(run, "record_id string, record binary")


def from_bytes(files: DataFrame, content: str = "content") -> DataFrame:
    """(headers map, block binary) of every record in a column of file contents (plain or gzip), such as Spark's binaryFile
    source has; a file is one value there, so of 2 GB at most. Null and empty contents hold no records. Records leave in
    batches of ``BATCH_BYTES``, so what a compressed file unfolds to is never held whole."""

    def batch(rows: list[tuple[dict[str, str], bytes]]) -> pa.RecordBatch:
        kind = pa.map_(pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([list(h.items()) for h, _ in rows], kind), pa.array([b for _, b in rows], pa.binary())], names=["headers", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for data in given.column("content"):
                rows, size = [], 0
                for record in parse(data.as_py() or b""):
                    rows.append(record)
                    size += len(record[1])
                    if size > BATCH_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
                yield batch(rows)

    return files.select(F.col(f"`{content}`").alias("content")).mapInArrow(run, "headers map<string,string>, block binary")


#: The query's rows in DuckDB, written apart from the patterns above: hidden parts are cut out one kind after another, and
#: of references it knows those that the pages hold.
ORACLE_SQL = """
WITH source AS (SELECT page_id, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS uri, coalesce(html, '') AS page FROM pages),
shown AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(page, '<!--(.|\n)*?-->', '', 'g'),
    '(?i)<(script)\\b[^<>]*>(.|\n)*?</script\\s*>', '', 'g'), '(?i)<(style)\\b[^<>]*>(.|\n)*?</style\\s*>', '', 'g'),
    '(?i)<head>(.|\n)*?</head>', '', 'g') AS body FROM source),
lines AS (SELECT page_id, regexp_replace(regexp_replace(body,
    '(?i)</?(address|p|div|br|hr|li|ul|ol|dl|dt|dd|tr|table|h[1-6]|nav|article|section|header|footer|main|aside|blockquote|pre|figure|figcaption|title|body|form|option)(\\s[^<>]*)?/?>', chr(10), 'g'),
    '<[^<>]+>', '', 'g') AS t FROM shown),
plain AS (
  SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;?', '&', 'g') AS t FROM lines),
texts AS (SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \\t\\r\\f]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g'), ' ' || chr(10)) AS block FROM plain),
titles AS (
  SELECT page_id, regexp_replace(replace(replace(replace(replace(regexp_extract(page, '<title>([^<]*)', 1), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&#39;', chr(39)), '&amp;?', '&', 'g') AS title,
         regexp_extract(page, '<html lang="([^"]*)"', 1) AS lang, (length(page) - length(replace(page, '<a href=', ''))) // 8 AS links FROM source),
made AS (
  SELECT s.*, 'metadata' AS kind, 'application/warc-fields' AS content_type,
         'title: ' || trim(regexp_replace(title, '[ \t\r\n\f]+', ' ', 'g')) || chr(13) || chr(10) || 'language: ' || lang || chr(13) || chr(10) || 'outlinks: ' || links || chr(13) || chr(10) AS block
  FROM source s JOIN titles USING (page_id)
  UNION ALL SELECT s.*, 'conversion', 'text/plain; charset=utf-8', block FROM source s JOIN texts USING (page_id)),
named AS (
  SELECT *, md5(kind || '|' || page_id || '|' || uri || '|sha256:' || sha256(page)) AS own, md5('response|' || page_id || '|' || uri || '|sha256:' || sha256(page)) AS of FROM made)
SELECT page_id, kind AS warc_type, '<urn:uuid:' || own[1:8] || '-' || own[9:12] || '-' || own[13:16] || '-' || own[17:20] || '-' || own[21:32] || '>' AS record_id,
       '<urn:uuid:' || of[1:8] || '-' || of[9:12] || '-' || of[13:16] || '-' || of[17:20] || '-' || of[21:32] || '>' AS refers_to, uri AS target_uri, '1970-01-01T00:00:00Z' AS date, content_type,
       CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, 'sha256:' || sha256(page) AS source_digest, CAST(strlen(page) AS VARCHAR) AS source_length
FROM named
"""
