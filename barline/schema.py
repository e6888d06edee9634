"""Tables, views and enumerations of the market catalogue. Schemas are fixed here and never inferred."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import types as T

_TEXT, _NUMBER, _DAY = T.StringType(), T.DoubleType(), T.DateType()


def _schema(keys: dict[str, T.DataType], **rest: T.DataType) -> T.StructType:
    fields = [T.StructField(name, kind, False) for name, kind in keys.items()]
    return T.StructType(fields + [T.StructField(name, kind) for name, kind in rest.items()])


_CODE, _CODE_DAY = {"code": _TEXT}, {"code": _TEXT, "trade_date": _DAY}
_BARS = dict.fromkeys(("open", "high", "low", "close", "volume", "amount"), _NUMBER)

TABLES: dict[str, T.StructType] = {
    "stock_list": _schema(_CODE, name=_TEXT),
    "index_list": _schema(_CODE, name=_TEXT),
    "trade_date": _schema({"trade_date": _DAY}),
    "stock_daily": _schema(_CODE_DAY, **_BARS),
    "index_daily": _schema(_CODE_DAY, **_BARS),
    "capital_daily": _schema(_CODE_DAY, total_share=_NUMBER, float_share=_NUMBER),
    "stock_dividend": _schema(_CODE_DAY, category=_TEXT, dividend=_NUMBER, bonus_ratio=_NUMBER, rights_ratio=_NUMBER, rights_price=_NUMBER),
}
VIEWS = ("stock_view", "index_view", "stock_dividend_view", "qfq_stock_daily_view")


def keys_of(schema: T.StructType) -> list[str]:
    """The primary key: the columns that can't be null."""
    return [field.name for field in schema if not field.nullable]


class Exchange(StrEnum):
    SZ = "SZ"
    SH = "SH"
    BJ = "BJ"


class KlinePeriod(StrEnum):
    MINUTE_1 = "1m"
    MINUTE_5 = "5m"
    MINUTE_15 = "15m"
    MINUTE_30 = "30m"
    MINUTE_60 = "1h"
    DAY = "day"
    WEEK = "week"
    MONTH = "month"
    QUARTER = "quar"
    YEAR = "year"


class DividendType(StrEnum):
    NONE = "none"
    FRONT = "front"
    BACK = "back"


class CodeFormat(StrEnum):
    PURE_CODE = "pure_code"
    SUFFIX = "suffix"
    PREFIX_DOT = "prefix_dot"
    PREFIX = "prefix"


class DateFormat(StrEnum):
    PURE_NUM = "pure_num"
    HYPHEN = "hyphen"
    SLASH = "slash"
    DOT = "dot"
    CHINESE = "chinese"
    HYPHEN_DATETIME = "hyphen_datetime"
    SLASH_DATETIME = "slash_datetime"
    CHINESE_DATETIME = "chinese_datetime"
    DATE_CLASS = "date_class"
    DATETIME_CLASS = "datetime_class"


class InsertMode(StrEnum):
    APPEND = "append"
    REPLACE = "replace"
    IGNORE = "ignore"


#: First day of trading.
FIRST_DAY = "1990-12-19"


class MarketError(Exception):
    """An error with a code, shown as [code] message."""

    code = 500

    def __init__(self, message: str, code: int | None = None):
        self.code = code or self.code
        super().__init__(f"[{self.code}] {message}")


class TableError(MarketError):
    code = 501


class SourceError(MarketError):
    code = 502


class ConfigError(MarketError):
    code = 504
