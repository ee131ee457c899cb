"""Dates as pages write them.

A fixed list of formats stands in for a browser's lenient date parser: ISO dates and date-times, RFC 1123
header dates, and English month names before or after the day. Other spellings are null.
"""

from pyspark.sql import Column, functions as F

from docgauge import constants as K
from docgauge.functions.let import bind

_ISO = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?)?$"
_FORMATS = ("MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy")


def to_date(value: Column) -> Column:
    """A timestamp, or null; only years 1995 to 2100 count."""
    return bind(F.regexp_replace(F.trim(value), r"(?i)(\d)(st|nd|rd|th)", "$1"), _parse)


def _parse(cleaned: Column) -> Column:
    # "Wed, 21 Oct 2015 07:28:00 GMT": the weekday carries no information and the zone is always GMT.
    header = F.try_to_timestamp(
        F.initcap(F.regexp_extract(cleaned, r"(?i), (.*) (gmt|utc)$", 1)), F.lit("d MMM yyyy HH:mm:ss")
    )
    is_header = cleaned.rlike(r"(?i)^[a-z]{3}, \d{1,2} [a-z]{3} \d{4} \d{2}:\d{2}:\d{2} (gmt|utc)$")
    words = F.regexp_replace(F.regexp_replace(cleaned, r"[,.]", " "), r"\s+", " ")
    words = F.regexp_replace(F.trim(F.initcap(words)), r"\bSept\b", "Sep")
    found = F.when(cleaned.rlike(_ISO), F.try_to_timestamp(cleaned)).when(is_header, header).otherwise(bind(words, _named))
    return bind(found, lambda at: F.when(F.year(at).between(1995, 2100), at))


def _named(words: Column) -> Column:
    return F.when(
        words.rlike(r"^([A-Z][a-z]+ \d{1,2}|\d{1,2} [A-Z][a-z]+) \d{4}$"),
        F.coalesce(*[F.try_to_timestamp(words, F.lit(fmt)) for fmt in _FORMATS]),
    )


def dates_in(text: Column, now: Column) -> Column:
    """Every plausible date in a text, newest first; more than a day ahead of ``now`` is ignored."""
    matches = F.concat(
        *[F.coalesce(F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.array().cast("array<string>")) for p in K.DATE_PATTERNS]
    )
    dates = F.transform(matches, lambda m: to_date(m))
    limit = now + F.expr("interval 1 day")
    return F.sort_array(F.filter(dates, lambda d: d.isNotNull() & (d <= limit)), asc=False)


def first_date_in(text: Column, now: Column) -> Column:
    return F.get(dates_in(text, now), F.lit(0))
