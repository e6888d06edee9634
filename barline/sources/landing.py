"""Cleaning of vendor files as they land: one function for each kind, from text or numbers to the catalogue's schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.codes import normalize_index_code, normalize_stock_code
from barline.functions.dates import normalize_trade_date
from barline.schema import CodeFormat, DateFormat

#: Dividend fields of a vendor and their columns.
DIVIDEND_FIELDS = {"Type": "category", "Bonus": "dividend", "ShareBonus": "bonus_ratio", "Allotment": "rights_ratio", "AllotPrice": "rights_price"}
#: Bar lengths and price adjustments as two vendors' requests spell them.
TERMINAL_PERIODS = {"1m": "1m", "5m": "5m", "15m": "15m", "30m": "30m", "1h": "1h", "day": "1d", "week": "1w", "month": "1mon", "quar": "1q", "year": "1y"}
TERMINAL_ADJUSTMENTS = {"none": "none", "front": "front", "back": "back"}
ARCHIVE_PERIODS = {"5m": "5", "15m": "15", "30m": "30", "1h": "60", "day": "d", "week": "w", "month": "m"}
ARCHIVE_ADJUSTMENTS = {"none": "3", "front": "2", "back": "1"}
#: Fields of the archive's bars besides code and date, and their columns.
ARCHIVE_FIELDS = {
    "open": "open", "high": "high", "low": "low", "close": "close", "preclose": "pre_close", "volume": "volume", "amount": "amount", "turn": "turnover",
    "tradestatus": "trade_status", "pctChg": "pct_chg", "peTTM": "pe_ttm", "pbMRQ": "pb_mrq", "psTTM": "ps_ttm", "pcfNcfTTM": "pcf_ncf_ttm",
}


def number(text: str) -> Column:
    """A double from text; null from an empty or unreadable one."""
    return F.col(text).cast("string").try_cast("double")


def day(text: str) -> Column:
    """A date from any usual spelling; null from a null one."""
    return F.when(F.col(text).isNotNull(), normalize_trade_date(F.col(text), DateFormat.DATE_CLASS))


def trade_dates(raw: DataFrame, date: str = "date") -> DataFrame:
    return raw.select(day(date).alias("trade_date")).where("trade_date is not null").distinct()


def securities(raw: DataFrame, index: bool = False) -> DataFrame:
    """code in pure digits and trimmed name."""
    code = normalize_index_code if index else normalize_stock_code
    return raw.select(code(F.col("code")).alias("code"), F.trim("name").alias("name")).where("code is not null")


def daily_bars(raw: DataFrame, index: bool = False) -> DataFrame:
    """Bars with a close above 0. A missing price is the first there is of close, open, high and low; missing volume and amount are 0."""
    code = normalize_index_code if index else normalize_stock_code
    price = {c: number(c) for c in ("close", "open", "high", "low")}
    fallback = F.coalesce(*price.values())
    bars = raw.select(
        code(F.col("code")).alias("code"),
        day("date").alias("trade_date"),
        *[F.coalesce(price[c], fallback).alias(c) for c in ("open", "high", "low", "close")],
        *[F.coalesce(number(c), F.lit(0.0)).alias(c) for c in ("volume", "amount")],
    )
    return bars.where("close > 0 and not isnan(close) and code is not null and trade_date is not null")


def dividends(raw: DataFrame) -> DataFrame:
    fields = [(F.col(old).cast("string") if new == "category" else number(old)).alias(new) for old, new in DIVIDEND_FIELDS.items()]
    return raw.select(normalize_stock_code(F.col("code")).alias("code"), day("date").alias("trade_date"), *fields)


def capital(raw: DataFrame) -> DataFrame:
    return raw.select(normalize_stock_code(F.col("code")).alias("code"), F.to_date(F.col("date").cast("string"), "yyyyMMdd").alias("trade_date"), number("Zgb").alias("total_share"), number("Ltgb").alias("float_share"))


def archive_bars(raw: DataFrame) -> DataFrame:
    """The archive's bars with all its fields: pure code, trade_date and numbers; empty text is null. Rows without a code or a date go."""
    fields = [number(old).alias(new) for old, new in ARCHIVE_FIELDS.items()]
    return raw.select(normalize_stock_code(F.col("code")).alias("code"), day("date").alias("trade_date"), *fields).where("code is not null and trade_date is not null")


@dataclass(frozen=True)
class Vendor:
    """What a vendor lands: cleaning functions by kind of file, None for a kind that it doesn't have; and how its requests are spelled."""

    periods: dict[str, str]
    adjustments: dict[str, str]
    code_form: CodeFormat
    date_form: DateFormat
    lower_code: bool = False
    kinds: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def clean(self, kind: str, raw: DataFrame) -> DataFrame:
        """A landed file of a kind in the catalogue's form."""
        if kind not in self.kinds:
            raise ValueError(f"the vendor has no {kind}; it has {', '.join(sorted(self.kinds))}")
        return self.kinds[kind](raw)

    def period(self, period: str) -> str:
        return _spelled(self.periods, "period", period)

    def adjustment(self, adjustment: str) -> str:
        return _spelled(self.adjustments, "adjustment", adjustment)

    def code(self, code: Column, index: bool = False) -> Column:
        """A code as requests spell it; null if it can't be read."""
        made = (normalize_index_code if index else normalize_stock_code)(code, self.code_form)
        return F.lower(made) if self.lower_code else made

    def date(self, date: Column) -> Column:
        return normalize_trade_date(date, self.date_form)


def _spelled(names: dict[str, str], what: str, value: str) -> str:
    if str(value) not in names:
        raise ValueError(f"the vendor has no {what} {value}; it has {', '.join(names)}")
    return names[str(value)]


#: The vendors by name, with all kinds of files that each has.
VENDORS: dict[str, Vendor] = {
    "terminal": Vendor(TERMINAL_PERIODS, TERMINAL_ADJUSTMENTS, CodeFormat.SUFFIX, DateFormat.PURE_NUM, kinds={
        "trade_date": trade_dates, "stock_list": securities, "index_list": partial(securities, index=True), "stock_daily": daily_bars,
        "index_daily": partial(daily_bars, index=True), "stock_dividend": dividends, "capital_daily": capital,
    }),
    "archive": Vendor(ARCHIVE_PERIODS, ARCHIVE_ADJUSTMENTS, CodeFormat.PREFIX_DOT, DateFormat.HYPHEN, lower_code=True, kinds={"stock_daily": archive_bars, "stock_list": securities}),
}
