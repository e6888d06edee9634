"""Filters given as (column, operator, value), all of which must hold."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "=": Column.__eq__,
    "==": Column.__eq__,
    "!=": Column.__ne__,
    "<>": Column.__ne__,
    "<": Column.__lt__,
    "<=": Column.__le__,
    ">": Column.__gt__,
    ">=": Column.__ge__,
    "like": lambda c, v: c.like(v),
    "not like": lambda c, v: ~c.like(v),
    "in": lambda c, v: c.isin(*v),
    "not in": lambda c, v: ~c.isin(*v),
    "is null": lambda c, v: c.isNull(),
    "is not null": lambda c, v: c.isNotNull(),
}

Filter = tuple[str, str, Any]


def predicate(filters: Iterable[Filter] | None) -> Column:
    """The conjunction of the filters; true without any. Values are typed literals, never SQL text."""

    def one(column: str, operator: str, value: Any) -> Column:
        compare = _COMPARE.get(" ".join(operator.lower().split()))
        if compare is None:
            raise ValueError(f"unknown operator {operator!r}")
        return compare(F.col(column), value)

    return reduce(Column.__and__, (one(*f) for f in filters or ()), F.lit(True))
