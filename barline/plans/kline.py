"""Everything a price chart of a security shows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.codes import normalize_stock_code
from barline.functions.numeric import fdiv
from barline.functions.series import Series
from barline.functions.technical import BIAS, CCI
from barline.operators import smoothed
from barline.operators.catalog import Catalog
from barline.plans.adjust import adjusted_view

AVERAGES = (5, 10, 20, 30, 60, 120, 250)


def round_numbers(df: DataFrame, digits: int = 2) -> DataFrame:
    """df with every floating-point column rounded."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema])


def kline(adjusted: DataFrame, s: Series | None = None, digits: int = 2) -> DataFrame:
    """The adjusted view with change, averages, RSI, MACD, KDJ, CCI, BIAS and signals, rounded.

    Windows first, then one pass for all recursive columns: two shuffles by code.
    """
    s = s or Series()
    names = [f"adj_{x}" for x in ("open", "high", "low", "close")]
    _, h, low, c = (F.col(n) for n in names)
    scaled = F.col("adj_volume") / 1000000
    windows = {
        "pct_chg": (fdiv(c, s.REF(c)) - 1) * 100,
        **{f"MA{n}": s.MA(c, n) for n in AVERAGES},
        "CCI": CCI(c, h, low, 14, s),
        **dict(zip(("BIAS60", "BIAS120", "BIAS250"), BIAS(c, 60, 120, 250, s), strict=True)),
        "VOL5": s.MA(scaled, 5),
        "VOL34": s.MA(scaled, 34),
    }
    recursive = (smoothed.macd(names[3]), smoothed.kdj(names[3], names[1], names[2], s=s), smoothed.rsi(names[3], 14, s), smoothed.w_jx(*names, s=s))
    made = smoothed.add(adjusted.dropna(subset=["open", "close", "high", "low"]), *recursive, s=s, more=windows)
    shown = {"trade_date": F.date_format("trade_date", "yyyy-MM-dd"), "adj_volume": scaled, "adj_amount": F.col("adj_amount") / 10000}
    return round_numbers(made.withColumns(shown), digits)


def chart(catalog: Catalog, code: str | Iterable[str], first: str | None = None, last: str | None = None, s: Series | None = None, digits: int = 2) -> DataFrame:
    """kline of some codes (in any spelling that normalize_stock_code reads) between two days, ends included, in order of code and day.

    Only the codes' rows are read. The days are cut after the windows, so the first ones have averages of the days before them; adjustment factors run
    to the last stored day. A code that isn't stored gives no rows.
    """
    wanted = catalog.spark.createDataFrame([(x,) for x in ([code] if isinstance(code, str) else code)], "code string").select(normalize_stock_code(F.col("code")).alias("code"))
    known = [row["code"] for row in wanted.where("code is not null").collect()]  # those that the caller gave
    daily, stocks, capital, dividends = (catalog.read(name).where(F.col("code").isin(known)) for name in ("stock_daily", "stock_list", "capital_daily", "stock_dividend"))
    made = kline(adjusted_view(daily, stocks, capital, dividends, s), s, digits)
    for limit, keeps in ((first, F.col("trade_date") >= F.lit(first)), (last, F.col("trade_date") <= F.lit(last))):
        made = made.where(keeps) if limit else made
    return made.orderBy("code", "trade_date")


def viewport(df: DataFrame, rows: int = 200, s: Series | None = None) -> DataFrame:
    """The last rows of each series."""
    s = s or Series()
    newest = F.row_number().over(W.partitionBy(*s.keys).orderBy(F.desc(s.order)))
    return df.withColumn("_newest", newest).where(F.col("_newest") <= rows).drop("_newest")


def labels(stocks: DataFrame) -> DataFrame:
    """code, name and the label "code - name", in order of code."""
    return stocks.select("code", "name", F.concat_ws(" - ", "code", "name").alias("label")).orderBy("code")


def code_of_label(label):
    return F.trim(F.split(label, " - ")[0])
