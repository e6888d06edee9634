"""Price views: bars with names and capital, dividend factors, and forward-adjusted prices.

Each function takes and returns DataFrames. Factors run from each row to the series' end, so a filter on dates belongs
after the view, and Catalyst leaves it there; a filter on codes moves below the windows by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.functions.series import Series

KEYS = ["code", "trade_date"]
BAR = ("open", "high", "low", "close", "volume", "amount")


def stock_view(daily: DataFrame, stocks: DataFrame, capital: DataFrame) -> DataFrame:
    """Bars of listed stocks with name and shares; bars without capital are left out."""
    return daily.join(stocks, "code").join(capital, KEYS).select("code", "name", "trade_date", *BAR, "total_share", "float_share")


def index_view(daily: DataFrame, indexes: DataFrame) -> DataFrame:
    return daily.join(indexes, "code").select("code", "name", "trade_date", *BAR)


def _actions(dividends: DataFrame, zero: bool) -> DataFrame:
    """Per share instead of per ten."""

    def tenth(name: str, default: float | None = 0.0):
        return (F.coalesce(F.col(name), F.lit(default)) if zero else F.col(name)) / 10

    price = F.coalesce("rights_price", F.lit(0.0)) if zero else F.col("rights_price")
    return dividends.select(*KEYS, tenth("dividend").alias("d"), tenth("bonus_ratio").alias("br"), tenth("rights_ratio").alias("rr"), price.alias("rp"))


def dividend_view(daily: DataFrame, dividends: DataFrame, s: Series | None = None) -> DataFrame:
    """close, pre_close, adjust_ratio and qfq_factor of every bar.

    adjust_ratio: the price after a day's distribution by the price before it (the open, where there is none
    above 0). qfq_factor: the product of the later rows' positive ratios.
    """
    s = s or Series()
    joined = daily.join(_actions(dividends, zero=True), KEYS, "left")
    before = s.REF("close")
    base = F.coalesce(F.when(before > 0, before), F.col("open"))
    d, br, rr, rp = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("d", "br", "rr", "rp"))
    after = (base - d + rr * rp) / F.greatest(1 + br + rr, F.lit(1.0))
    ratios = joined.select(*KEYS, "close", before.alias("pre_close"), F.try_divide(after, base).alias("adjust_ratio"))
    following = F.coalesce(s.REF("adjust_ratio", -1), F.lit(1.0))
    rest = s.rows.rowsBetween(0, W.unboundedFollowing)
    factor = F.exp(F.sum(F.when(following > 0, F.ln(F.when(following > 0, following))).otherwise(0.0)).over(rest))
    return ratios.select("*", factor.alias("qfq_factor"))


def adjusted_view(daily: DataFrame, stocks: DataFrame, capital: DataFrame, dividends: DataFrame, s: Series | None = None) -> DataFrame:
    """stock_view with qfq_factor and adjusted prices (times it), volume and amount (divided by it)."""
    factors = dividend_view(daily, dividends, s).select(*KEYS, "qfq_factor")
    view = stock_view(daily, stocks, capital).join(factors, KEYS)
    prices = [(F.col(c) * F.col("qfq_factor")).alias(f"adj_{c}") for c in BAR[:4]]
    return view.select("*", *prices, *[(F.col(c) / F.col("qfq_factor")).alias(f"adj_{c}") for c in BAR[4:]])


def forward_factors(prices: DataFrame, dividends: DataFrame, s: Series | None = None) -> DataFrame:
    """trade_date and forward_factor of every price row of every series.

    Unlike dividend_view: the first row has ratio 1, a null rights price makes a ratio null (and so the factors before
    it), and ratios of 0 or less multiply like others.
    """
    s = s or Series()
    joined = prices.select(*KEYS, "close").join(_actions(dividends, zero=False), KEYS, "left")
    before = s.REF("close")
    after = (before - F.col("d") + F.col("rr") * F.col("rp")) / F.greatest(1 + F.col("br") + F.col("rr"), F.lit(1.0))
    ratio = F.when((before > 0) & F.col("d").isNotNull(), F.try_divide(after, before)).otherwise(1.0)
    following = F.coalesce(s.REF(F.col("ratio"), -1), F.lit(1.0))
    factor = F.product(following).over(s.rows.rowsBetween(0, W.unboundedFollowing))
    return joined.select(*KEYS, ratio.alias("ratio")).select(*KEYS, factor.alias("forward_factor"))


def dividend_days(prices: DataFrame, dividends: DataFrame) -> DataFrame:
    """The dividends of days that have prices."""
    return dividends.join(prices, KEYS, "left_semi")
