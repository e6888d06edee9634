"""Arithmetic with IEEE results where ANSI SQL raises or returns null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INFINITY = float("nan"), float("inf")


def as_column(x: Column | float | int | bool | str) -> Column:
    """A name is a column, anything else that isn't a Column a literal."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fdiv(a: Column | float, b: Column | float) -> Column:
    """a / b as IEEE does it: x/0 is an infinity, 0/0 is NaN; a null on either side gives null.

    Each side stands in the expression twice only, so that nested quotients of windows stay small.
    """
    a, b = as_column(a).cast("double"), as_column(b).cast("double")
    return F.coalesce(F.try_divide(a, b), a * (b + F.lit(INFINITY)))  # no quotient: b is 0, or a side is null


def finite(x: Column, digits: int | None = None) -> Column:
    """x, rounded if digits is given; null where it isn't a finite number."""
    kept = F.when(~F.isnan(x) & (F.abs(x) < INFINITY), x)
    return kept if digits is None else F.round(kept, digits) + F.lit(0.0)


def RD(x: Column, digits: int = 2) -> Column:
    return F.round(as_column(x), digits)


def ABS(x: Column) -> Column:
    return F.abs(as_column(x))


def LN(x: Column) -> Column:
    """Natural logarithm; -infinity at 0, NaN below."""
    x = as_column(x).cast("double")
    return F.when(x == 0, F.lit(-INFINITY)).when(x < 0, F.lit(NAN)).otherwise(F.ln(F.when(x > 0, x)))


def POW(x: Column, n: Column | float) -> Column:
    return F.pow(as_column(x), as_column(n))


def SQRT(x: Column) -> Column:
    return F.sqrt(as_column(x))


def SIN(x: Column) -> Column:
    return F.sin(as_column(x))


def COS(x: Column) -> Column:
    return F.cos(as_column(x))


def TAN(x: Column) -> Column:
    return F.tan(as_column(x))


def MAX(a: Column | float, b: Column | float) -> Column:
    """The larger of two values; a null is passed over."""
    return F.greatest(as_column(a), as_column(b))


def MIN(a: Column | float, b: Column | float) -> Column:
    return F.least(as_column(a), as_column(b))


def IF(condition: Column, a: Column | float, b: Column | float) -> Column:
    """a where the condition is true, else b; a null condition takes b."""
    return F.when(condition, as_column(a)).otherwise(as_column(b))
