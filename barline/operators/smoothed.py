"""Indicators that smooth recursively.

Each one is given by columns to make ready with windows, recursive steps, and columns to finish with windows. add() runs any
number of them together: one stage of windows, one pass of recursive steps, one stage of windows, however many there are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.numeric import ABS, IF, LN, MAX, RD, fdiv
from barline.functions.series import Series
from barline.functions.technical import ATR
from barline.operators.recursive import DMA, EMA, SMA, AbsDev, Extreme, Linear, Place, Step, Total, Weighted, with_recursive

S = Series()


@dataclass(frozen=True)
class Smoothed:
    """Names of steps and of columns made ready start with an underscore; they are dropped at the end."""

    steps: dict[str, Step]
    done: dict[str, Column]
    ready: dict[str, Column] = field(default_factory=dict)


def add(df: DataFrame, *indicators: Smoothed, s: Series = S, more: dict[str, Column] | None = None) -> DataFrame:
    """df with the finished columns of the indicators, and more columns of windows over df."""
    ready = {name: c for i in indicators for name, c in i.ready.items()} | (more or {})
    steps = {name: step for i in indicators for name, step in i.steps.items()}
    made = with_recursive(df.select("*", *[c.alias(name) for name, c in ready.items()]), steps, s)
    done = [c.alias(name) for i in indicators for name, c in i.done.items()]
    return made.select(*df.columns, *(more or {}), *done)


def macd(close: str = "close", short: int = 12, long: int = 26, m: int = 9) -> Smoothed:
    """DIF, DEA and MACD."""
    steps = {"_macd_s": EMA(close, short), "_macd_l": EMA(close, long), "_dif": Linear(("_macd_s", "_macd_l"), factors=(1.0, -1.0)), "_dea": EMA("_dif", m)}
    dif, dea = F.col("_dif"), F.col("_dea")
    return Smoothed(steps, {"DIF": RD(dif), "DEA": RD(dea), "MACD": RD((dif - dea) * 2)})


def kdj(close: str = "close", high: str = "high", low: str = "low", n: int = 9, m1: int = 3, m2: int = 3, s: Series = S) -> Smoothed:
    """K, D and J; a flat window gives NaN, which stays."""
    floor = s.LLV(low, n)
    rsv = fdiv(F.col(close) - floor, s.HHV(high, n) - floor) * 100
    steps = {"_k": EMA("_rsv", 2 * m1 - 1), "_d": EMA("_k", 2 * m2 - 1)}
    return Smoothed(steps, {"K": F.col("_k"), "D": F.col("_d"), "J": F.col("_k") * 3 - F.col("_d") * 2}, {"_rsv": rsv})


def kdj_in_steps(close: str = "close", high: str = "high", low: str = "low", n: int = 9, m1: int = 3, m2: int = 3) -> Smoothed:
    """kdj() without windows, for rows that come one by one: the state has the last n highs and lows."""
    steps: dict[str, Step] = {"_high_n": Extreme((high,), n=n), "_low_n": Extreme((low,), n=n, lowest=True), "_rsv": Place((close, "_low_n", "_high_n"))}
    later = kdj(close, high, low, n, m1, m2)
    return Smoothed(steps | later.steps, later.done)


def rsi(close: str = "close", n: int = 24, s: Series = S) -> Smoothed:
    """RSI. The rises start from 0 on the first row, the moves on the second."""
    move = s.DIFF(close)
    steps = {"_rsi_r": SMA("_rise", n), "_rsi_m": SMA("_move", n)}
    return Smoothed(steps, {"RSI": RD(fdiv(F.col("_rsi_r"), F.col("_rsi_m")) * 100)}, {"_rise": MAX(move, 0.0), "_move": ABS(move)})


def ktn(close: str = "close", high: str = "high", low: str = "low", n: int = 20, m: int = 10, s: Series = S) -> Smoothed:
    """KTN_UPPER, KTN_MID and KTN_LOWER."""
    c, h, l_ = F.col(close), F.col(high), F.col(low)
    mid, width = F.col("_ktn"), F.col("_ktn_atr") * 2
    done = {"KTN_UPPER": mid + width, "KTN_MID": mid, "KTN_LOWER": mid - width}
    return Smoothed({"_ktn": EMA("_ktn_tp", n)}, done, {"_ktn_tp": (h + l_ + c) / 3, "_ktn_atr": ATR(c, h, l_, m, s)})


def obv(close: str = "close", volume: str = "volume", s: Series = S) -> Smoothed:
    """OBV as a running step."""
    before = s.REF(close)
    signed = IF(F.col(close) > before, F.col(volume), IF(F.col(close) < before, -F.col(volume), 0.0))
    return Smoothed({"_obv": Total(("_signed",))}, {"OBV": F.col("_obv") / 10000}, {"_signed": signed})


def avedev(x: str = "close", n: int = 14, into: str = "AVEDEV") -> Smoothed:
    """AVEDEV as a step, for long windows."""
    return Smoothed({f"_{into}": AbsDev((x,), n=n)}, {into: F.col(f"_{into}")})


def nm_in_steps(close: str = "close", short: int = 40, long: int = 100) -> Smoothed:
    """NMM (with NMMB and NMMT) and NMR as convolutions of the logarithms, with their warm-up of zeros."""
    nmm, nmr = (tuple(100000 / j**0.5 for j in range(1, short + 1)), tuple(1000 * (j**0.5 - (j - 1) ** 0.5) for j in range(1, long + 1)))
    steps: dict[str, Step] = {"_nmm": Weighted(("_ln",), weights=nmm), "_nmr": Weighted(("_ln",), weights=nmr)}
    figure = (F.col("_ln") * sum(nmm) - F.col("_nmm")) / short
    return Smoothed(steps, {"NMM": figure, "NMMB": figure < -3000, "NMMT": figure > 3000, "NMR": F.col("_ln") * sum(nmr) - F.col("_nmr")}, {"_ln": F.coalesce(LN(F.col(close)), F.lit(0.0))})


def trix(close: str = "close", m1: int = 12, m2: int = 20, s: Series = S) -> Smoothed:
    """TRIX and TRMA."""
    before = s.REF("_trix3")
    change = fdiv(F.col("_trix3") - before, before) * 100
    return Smoothed({"_trix1": EMA(close, m1), "_trix2": EMA("_trix1", m1), "_trix3": EMA("_trix2", m1)}, {"TRIX": change, "TRMA": s.MA(change, m2)})


def expma(close: str = "close", n1: int = 12, n2: int = 50) -> Smoothed:
    """EXPMA1 and EXPMA2."""
    return Smoothed({"_expma1": EMA(close, n1), "_expma2": EMA(close, n2)}, {"EXPMA1": F.col("_expma1"), "EXPMA2": F.col("_expma2")})


def xsii(close: str = "close", high: str = "high", low: str = "low", n: int = 102, m: int = 7, s: Series = S) -> Smoothed:
    """TD1 to TD4."""
    typical = (F.col(close) * 2 + F.col(high) + F.col(low)) / 4
    mean, short = s.MA(close, 20), s.MA(typical, 5)
    line = F.col("_xsii")
    done = {"TD1": F.col("_xsii_aa") * n / 100, "TD2": F.col("_xsii_aa") * (200 - n) / 100, "TD3": line * (1 + m / 100), "TD4": line * (1 - m / 100)}
    return Smoothed({"_xsii": DMA((close, "_xsii_cc"))}, done, {"_xsii_cc": fdiv(ABS(typical - mean), mean), "_xsii_aa": short})


def w_jx(open_: str = "open", high: str = "high", low: str = "low", close: str = "close", s: Series = S) -> Smoothed:
    """JXB and JXT."""
    steps = {"_jx_c": SMA(close, 2, 1), "_jx_l": SMA(low, 5, 2), "_jx_o": SMA(open_, 2, 1), "_jx_h": SMA(high, 21, 2)}
    bottom = (F.col("_jx_c") - F.col("_jx_l") <= 0.003) & (F.col("_jx_before") > 0)
    return Smoothed(steps, {"JXB": bottom, "JXT": F.col("_jx_o") > F.col("_jx_h") * 1.05}, {"_jx_before": s.REF(close)})
