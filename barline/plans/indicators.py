"""All indicators of a bar table at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions import technical as T
from barline.functions.series import Series
from barline.operators import smoothed

_NAMES = {
    "WR": ("WR1", "WR2"), "BIAS": ("BIAS1", "BIAS2", "BIAS3"), "BOLL": ("BOLL_UPPER", "BOLL_MID", "BOLL_LOWER"), "PSY": ("PSY", "PSYMA"), "CCI": ("CCI",),
    "ATR": ("ATR",), "BBI": ("BBI",), "VR": ("VR",), "CR": ("CR",), "EMV": ("EMV", "MAEMV"), "DPO": ("DPO", "MADPO"),
    "BRAR": ("AR", "BR"), "DFMA": ("DFMA", "DIFMA"), "MTM": ("MTM", "MTMMA"), "MASS": ("MASS", "MA_MASS"), "ROC": ("ROC", "MAROC"), "OBV": ("OBV",),
    "MFI": ("MFI",), "ASI": ("ASI", "ASIT"), "W_GL": ("GLB", "GLGB", "GLT", "GLGT"), "NMM": ("NMM", "NMMB", "NMMT"), "NMR": ("NMR",),
}
#: The prices that each indicator takes, in order.
_PRICES = {
    "WR": "chl", "BIAS": "c", "BOLL": "c", "PSY": "c", "CCI": "chl", "ATR": "chl", "BBI": "c", "VR": "cv", "CR": "chl", "EMV": "hlv", "DPO": "c",
    "BRAR": "ochl", "DFMA": "c", "MTM": "c", "MASS": "hl", "ROC": "c", "OBV": "cv", "MFI": "chlv", "ASI": "ochl", "W_GL": "c", "NMM": "c", "NMR": "c",
}


def window_columns(s: Series | None = None, prefix: str = "", boll_digits: int | None = 2) -> dict[str, Column]:
    """Every indicator made of windows only, with default parameters, by name of column; but DMI and W_TD, whose windows are nested (all_indicators has them in stages)."""
    s, found = s or Series(), {}
    price = {name[0]: F.col(prefix + name) for name in ("open", "high", "low", "close", "volume")}
    for name, prices in _PRICES.items():
        made = getattr(T, name)(*[price[p] for p in prices], s=s, **({"digits": boll_digits} if name == "BOLL" else {}))
        found |= dict(zip(_NAMES[name], made if isinstance(made, tuple) else (made,), strict=True))
    found |= dict(zip(("TAQ_UP", "TAQ_MID", "TAQ_DOWN"), T.TAQ(price["h"], price["l"], 20, s), strict=True))
    return found


def recursive_indicators(s: Series) -> list[smoothed.Smoothed]:
    return [smoothed.macd(), smoothed.kdj(s=s), smoothed.rsi(s=s), smoothed.ktn(s=s), smoothed.trix(s=s), smoothed.expma(), smoothed.xsii(s=s), smoothed.w_jx(s=s)]


def all_indicators(bars: DataFrame, s: Series | None = None, boll_digits: int | None = 2) -> DataFrame:
    """bars with every indicator: two shuffles and sorts for the first windows and the recursive pass, one for the last windows."""
    s = s or Series()
    recursive = recursive_indicators(s)
    bars = T.with_td(T.with_dmi(bars, s=s), s=s)
    return smoothed.add(bars, *recursive, s=s, more=window_columns(s, boll_digits=boll_digits))
