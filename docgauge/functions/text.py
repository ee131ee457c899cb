"""Text comparisons used by the answer and page operators."""

from pyspark.sql import Column, functions as F

from docgauge import constants as K
from docgauge.functions.let import bind

_BLANK = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WHITESPACE = f"[{_BLANK}]+"
# As WHITESPACE, but a single plain space is no match: it would be replaced by itself, once for every word of a text.
_RUN = f"[{_BLANK}&&[^ ]][{_BLANK}]*| [{_BLANK}]+"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _RUN, " "))


def normalize_for_match(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def contains_quote(text: Column, quote: Column) -> Column:
    """Substring of the normalised text first; only when that misses, the share of quote words in the vocabulary."""
    return bind(
        normalize_for_match(quote), lambda needle: bind(normalize_for_match(text), lambda hay: holds(hay, needle))
    )


def holds(haystack: Column, needle: Column, known: Column | None = None) -> Column:
    """``contains_quote`` of texts that are normalised already. ``known``: words of the haystack, at least those that the needle has too."""
    words = F.split(needle, " ")
    vocabulary = F.array_intersect(words, F.split(haystack, " ")) if known is None else known
    present = bind(vocabulary, lambda known: F.size(F.filter(words, lambda word: F.array_contains(known, word))))
    return (
        F.when(haystack.isNull() | needle.isNull() | (needle == ""), F.lit(False))
        .when(F.contains(haystack, needle), F.lit(True))
        .when(F.size(words) < K.MIN_QUOTE_WORDS, F.lit(False))
        .otherwise(present / F.size(words) >= K.QUOTE_OVERLAP)
    )


def cited_urls(answer: Column) -> Column:
    """URLs in an answer in the order named, trailing punctuation off."""
    found = F.regexp_extract_all(answer, F.lit(r"""(https?://[^\s)>\]"'`]+)"""), F.lit(1))
    return F.array_distinct(F.transform(found, lambda url: F.regexp_replace(url, "[.,;:!?]+$", "")))


def clean_resolution(text: Column) -> Column:
    """Drops advice sentences that only make sense to someone running a command-line tool."""
    sentences = F.split(text, r"(?<=[.!?])\s+")
    kept = F.filter(sentences, lambda sentence: ~sentence.rlike(K.COMMAND_LINE_ADVICE))
    return F.nullif(F.trim(F.array_join(kept, " ")), F.lit(""))


def looks_like_html(body: Column) -> Column:
    fenced = F.regexp_replace(body, r"(?ms)^(`{3,}|~{3,})[^\n]*\n.*?\n\1[ \t]*$", "")
    sample = F.left(F.regexp_replace(fenced, r"`[^`\n]+`", "``"), F.lit(2000))
    return sample.rlike(r"(?i)<!doctype\s|<html[\s>]|<head[\s>]|<body[\s>]")


def sanitize(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\u0000-\u001f\u007f<>]", ""), WHITESPACE, " "))
