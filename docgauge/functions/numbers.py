"""Rounding, grades and number wording shared by every scored operator."""

from pyspark.sql import Column, functions as F

from docgauge import constants as K


def rounded(value: Column, scale: int) -> Column:
    """Half-up rounding on the binary double; Spark's own ``round`` works on its decimal rendering."""
    return F.floor(value * scale + F.lit(0.5)) / F.lit(scale)


def round1(value: Column) -> Column:
    return rounded(value, 10)


def percent(earned: Column, possible: Column) -> Column:
    return F.when(possible > 0, F.floor(earned / possible * 100 + F.lit(0.5)).cast("int"))


def clamp01(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def grade_for(score: Column) -> Column:
    graded = F.when(score.isNull(), None)
    for floor, grade in K.GRADE_FLOORS:
        graded = graded.when(score >= floor, F.lit(grade))
    return graded.otherwise(F.lit("F"))


def status_for_credit(credit: Column, passing: float = 1.0, warning: float = 0.5) -> Column:
    return (
        F.when(credit.isNull(), None)
        .when(credit >= passing, "pass")
        .when(credit >= warning, "warn")
        .otherwise("fail")
    )


def number_text(value: Column) -> Column:
    """A double as people write it: no trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def grouped_text(value: Column) -> Column:
    """Thousands separators: 40,000."""
    return F.format_number(value, 0)


def plural(count: Column, one: str, many: str | None = None) -> Column:
    return F.concat(count.cast("string"), F.when(count == 1, f" {one}").otherwise(f" {many or one + 's'}"))


def list_of(items: Column, last_joiner: str = " and ") -> Column:
    """``a, b and c`` from an array of strings."""
    size = F.size(items)
    return F.when(size <= 1, F.array_join(items, "")).otherwise(
        F.concat(
            F.array_join(F.slice(items, F.lit(1), F.greatest(size - 1, F.lit(0))), ", "),
            F.lit(last_joiner),
            F.element_at(items, -1),
        )
    )
