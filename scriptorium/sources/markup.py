"""Markdown and HTML to prose, as chains of pattern replacements that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The element names that count as tags; anything else in angle brackets is prose.
TAGS = (
    "a abbr address article aside b bdi bdo blockquote br button canvas caption cite code col colgroup data datalist dd del "
    "details dfn dialog div dl dt em embed fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html i "
    "iframe img input ins kbd label legend li link main map mark menu meta meter nav noscript object ol optgroup option output p "
    "param picture pre progress q rp rt ruby s samp script section select small source span strong style sub summary sup svg "
    "table tbody td template textarea tfoot th thead time title tr track u ul var video wbr path g rect circle line polygon "
    "polyline defs use"
).split()
TAG = r"(?i)</?(?:" + "|".join(TAGS) + r")\b[^<>]*>"
COMMENT = r"(?s)<!--.*?-->"
FRONT_MATTER = r"(?s)\A---\n(?:(?:.*?\n)??---(?:\n|\z)|.*\z)"
FIGURE = r"(?is)<figure\b[^>]*>.*?</figure>"

#: Steps of each chain: pattern and replacement, in order. Patterns are in the part that Java and RE2 share.
MARKDOWN = (
    (FIGURE, ""),
    (COMMENT, ""),
    (TAG, ""),
    (r"!\[[^\]]*\]\([^)]*\)", ""),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"https?://[^\t\n\f\r ]+", ""),
)
HTML = (
    (COMMENT, ""),
    *((rf"(?is)<{t}\b[^>]*>.*?</{t}>", "") for t in ("script", "style", "head")),
    (r"(?is)^.*<body[^>]*>", ""),
    (r"(?is)</body>.*", ""),
    (FIGURE, ""),
    *((rf"(?i)<h{n}\b[^>]*>", "\n\n" + "#" * n + " ") for n in range(1, 7)),
    (r"(?i)</h[1-6]>", "\n"),
    (r"(?i)</(?:p|blockquote|li|div|ul|ol)>", "\n\n"),
    (r"(?i)<li\b[^>]*>", "- "),
    (r"(?i)<br[\t\n\f\r ]*/?>", "\n"),
    (TAG, ""),
)
#: Named characters, straightened: name and what it becomes, in order.
NAMED = (
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#8217;", "'"), ("&#8216;", "'"), ("&rsquo;", "'"), ("&lsquo;", "'"),
    ("&#8220;", '"'), ("&#8221;", '"'), ("&ldquo;", '"'), ("&rdquo;", '"'), ("&#8212;", "--"), ("&mdash;", "--"), ("&#8230;", "..."), ("&hellip;", "..."),
)
NUMERIC = r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"
AFTER = ((r"&[a-zA-Z]+;", ""), (r"(?m)^[ \t]+", ""), (r"\n{3,}", "\n\n"))


def _chain(text: Column, steps: tuple) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def strip_front_matter(text: Column) -> Column:
    """Without a leading block between lines of three dashes (to the end, if it isn't closed)."""
    return F.regexp_replace(text, FRONT_MATTER, "")


def markdown_to_prose(text: Column) -> Column:
    """Markdown without front matter, figures, comments, known tags, images, link targets and bare addresses; headings and
    bullets stay."""
    return _chain(strip_front_matter(text), MARKDOWN)


def numeric_characters(text: Column) -> Column:
    """Numeric character references resolved, each distinct one once; numbers that are no character become U+FFFD."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(NUMERIC), F.lit(0)))
    inner = lambda e: F.substr(e, F.lit(3), F.length(e) - 3)
    code = lambda e: F.when(F.lower(inner(e)).startswith("x"), F.conv(F.substr(inner(e), F.lit(2)), 16, 10)).otherwise(inner(e)).cast("bigint")
    valid = lambda n: (n > 0) & (n < 0x110000) & ~((n >= 0xD800) & (n < 0xE000))
    char = lambda e: F.when(valid(code(e)), F.decode(F.unhex(F.lpad(F.hex(code(e)), 8, "0")), "UTF-32")).otherwise("�")
    return F.aggregate(found, text, lambda t, e: F.replace(t, e, char(e)))


def html_to_prose(html: Column) -> Column:
    """The body's prose with headings and bullets as Markdown: known tags go, characters are resolved."""
    text = _chain(html, HTML)
    for name, by in NAMED:
        text = F.replace(text, F.lit(name), F.lit(by))
    return _chain(numeric_characters(text), AFTER)
