"""Segmentation of prose as column expressions: paragraphs, sentences, words, syllables, retrieval terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token languages of the style engine.
WORD = "[\\p{L}\\p{M}]+(?:['’][\\p{L}\\p{M}]+)*"
SENTENCE_END = "([.!?]+(?:[\\t\\n\\f\\r ]+|\\z)|[。！？؟।]+)"
BLANK_LINE = "\\n[\\t\\n\\f\\r ]*\\n"
#: All white space of Unicode, for trimming and collapsing.
SPACE = "[\\s\\x0B\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
#: A character that no text holds, to split at.
CUT = "\u0001"
#: Noncharacters that stand for a word and between paragraphs.
A_WORD, A_PARAGRAPH = "\ufdd0", "\ufdd1"
VOWELS = "aeiouy"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and marks, with apostrophes inside; digits and underscores never match."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+\\z", "")


def collapsed(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", " ")


def paragraphs(text: Column) -> Column:
    """Stretches between blank lines, trimmed; empty ones are left out."""
    return F.filter(F.transform(F.split(text, BLANK_LINE, -1), trimmed), lambda p: p != "")


def sentences(paragraph: Column) -> Column:
    """Sentences with their stops, white space collapsed."""
    cut = F.split(F.regexp_replace(collapsed(paragraph), SENTENCE_END, f"$1{CUT}"), CUT, -1)
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def marked(text: Column) -> Column:
    """A text's shape in one string: a mark for each word, its other signs, a mark after each sentence and between
    paragraphs. What :func:`paragraphs`, :func:`sentences` and :func:`word_count` say of a text can be read off it."""
    shape = F.regexp_replace(F.regexp_replace(text, WORD, A_WORD), BLANK_LINE, A_PARAGRAPH)
    shape = F.regexp_replace(F.regexp_replace(shape, f"{SPACE}+", " "), f" ?{A_PARAGRAPH} ?|^ | \\z", A_PARAGRAPH)
    return F.regexp_replace(shape, f"([.!?]+(?: +|\\z|(?={A_PARAGRAPH}))|[。！？؟।]+)", f"$1{CUT}")


def marked_paragraphs(shape: Column) -> Column:
    """Number of paragraphs."""
    return F.regexp_count(shape, F.lit(f"[^{A_PARAGRAPH}]+")).cast("bigint")


def marked_lengths(shape: Column) -> Column:
    """The words of each sentence."""
    cut = F.filter(F.split(shape, f"[{CUT}{A_PARAGRAPH}]", -1), lambda s: F.trim(s) != "")
    return F.transform(cut, lambda s: F.length(s) - F.length(F.replace(s, F.lit(A_WORD), F.lit(""))))


def spaced(tokens: Column) -> Column:
    """Tokens in one string, each between blanks of its own: what happens within a token is then a pattern of the string,
    and whole-string expressions stay in generated code."""
    return F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))


def occurrences(text: Column, literal: str) -> Column:
    """How often a literal occurs, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("bigint")


def syllables_in(spaced_words: Column) -> Column:
    """Syllables of all words of :func:`spaced`: vowel runs, less a final e that is a run of its own after another, one
    at least for each word."""
    runs = F.regexp_count(spaced_words, F.lit(f"[{VOWELS}]+"))
    silent = F.regexp_count(spaced_words, F.lit(f"[{VOWELS}][^ ]*[^{VOWELS} ][{VOWELS}]*e "))
    bare = F.regexp_count(spaced_words, F.lit(f" [^{VOWELS} ]+ "))
    return (runs - silent + bare).cast("bigint")


def syllables(word: Column) -> Column:
    """Syllables of one word; 0 of the empty one."""
    return F.when(word == "", F.lit(0).cast("bigint")).otherwise(syllables_in(F.concat(F.lit(" "), word, F.lit(" "))))


def retrieval_terms(text: Column) -> Column:
    """Words of three letters or more without any apostrophe."""
    return F.filter(words(text), lambda w: (F.length(w) >= 3) & ~w.rlike("['’]"))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def one_line(text: Column, n: int) -> Column:
    return truncated(F.trim(collapsed(text)), n)


def first_sentence(paragraph: Column) -> Column:
    return F.coalesce(F.try_element_at(sentences(paragraph), F.lit(1)), paragraph)
