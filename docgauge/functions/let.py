"""Evaluating an expression once where a formula needs it several times."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    Column expressions have no local variables: naming a costly one five times computes it up to five times. A
    one-element array transformed by ``use`` gives it a name.
    """
    return F.get(F.transform(F.array(value), lambda bound: use(bound)), F.lit(0))
