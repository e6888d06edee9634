import datetime
import math

import pytest
from pyspark.sql import functions as F

from barline.functions import numeric as N
from barline.functions import technical as T
from barline.functions.series import BETWEEN, Series
from barline.operators import smoothed

S = Series()
CLOSE = [10, 11, 10.5, 12, 11.5, 13, 12.5, 14, 13.5, 15]


def frame(spark, closes, code="a"):
    rows = [(code, datetime.date(2024, 1, 1) + datetime.timedelta(i), None if c is None else float(c)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "code string, trade_date date, close double")


def values(df, column):
    return [r[0] for r in df.select("trade_date", column.alias("x")).orderBy("trade_date").select("x").collect()]


def test_fixed_vectors(spark):
    df, c = frame(spark, CLOSE), F.col("close")
    assert values(df, S.DIFF(c))[:2] == [None, 1.0]
    assert values(df, S.HHV(c, 3))[:3] == [None, None, 11.0]
    assert values(df, S.LLV(c, 3))[2] == 10.0
    assert values(df, S.MA(c, 3))[:3] == [None, None, 10.5]
    assert values(df, S.REF(c))[0] is None
    assert values(df, S.BARSLAST(c > 12))[-1] == 0
    assert values(df, S.BARSLAST(c > 100)) == [None] * 10
    assert values(df, S.SUM(c, 0))[-1] == sum(CLOSE)
    assert values(df, S.CONST(c)) == [15.0] * 10
    assert values(df, S.REF(c, -1))[-1] is None
    assert S.RET(df, x=("close", 2), y=("close", 11)).first()[1:] == (13.5, None)


def test_windows_wait_for_values_that_are_not_null(spark):
    df = frame(spark, [None, 1, 2, 3, 4, None, 6])
    assert values(df, S.MA(F.col("close"), 3)) == [None, None, None, 2.0, 3.0, None, None]
    assert values(df, S.SUM(F.col("close"), 0)) == [None, 1.0, 3.0, 6.0, 10.0, None, 16.0]


def test_ties_take_the_oldest(spark):
    df = frame(spark, [5, 5, 1, 1, 5])
    assert values(df, S.HHVBARS(F.col("close"), 3)) == [None, None, 2, 2, 0]
    assert values(df, S.LLVBARS(F.col("close"), 3)) == [None, None, 0, 1, 2]


def test_series_shorter_than_the_window(spark):
    df = frame(spark, [1, 2])
    for made in (S.MA("close", 5), S.STD("close", 5), S.WMA("close", 5), S.SLOPE("close", 5), S.AVEDEV("close", 5)):
        assert values(df, made) == [None, None]
    assert values(frame(spark, []), S.MA("close", 5)) == []


def test_ieee_division(spark):
    pairs = [(1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (None, 0.0), (4.0, 2.0), (1.0, None)]
    found = [r[0] for r in spark.createDataFrame(pairs, "a double, b double").coalesce(1).select(N.fdiv(F.col("a"), F.col("b"))).collect()]
    assert found[0] == math.inf and math.isnan(found[1]) and found[2] == -math.inf and found[3] is None and found[4:] == [2.0, None]


def test_logarithm_at_and_below_zero(spark):
    found = [r[0] for r in spark.createDataFrame([(0.0,), (-1.0,), (1.0,), (None,)], "x double").coalesce(1).select(N.LN(F.col("x"))).collect()]
    assert found[0] == -math.inf and math.isnan(found[1]) and found[2:] == [0.0, None]


def test_between_takes_bounds_in_either_order(spark):
    df = frame(spark, [1, 2, 3])
    assert values(df, BETWEEN(F.col("close"), 1.0, 3.0)) == values(df, BETWEEN(F.col("close"), 3.0, 1.0)) == [False, True, False]


@pytest.fixture(scope="module")
def bars(spark):
    import random

    rng, rows, price = random.Random(42), [], 100.0
    for i in range(130):
        opened, price = price, price * (1 + rng.gauss(0, 0.02))
        high, low = max(opened, price) * (1 + rng.random() / 100), min(opened, price) * (1 - rng.random() / 100)
        rows.append(("a", datetime.date(2024, 1, 1) + datetime.timedelta(i), opened, high, low, price, 1000.0 + rng.random()))
    return spark.createDataFrame(rows, "code string, trade_date date, open double, high double, low double, close double, volume double").cache()


#: 0-based row on which each output is first given, with default parameters.
FIRST = {
    "WR": (9, 5), "BIAS": (5, 11, 23), "BOLL": (19, 19, 19), "PSY": (12, 17), "CCI": (13,), "ATR": (19,), "BBI": (19,), "DMI": (13, 13, 18, 24),
    "VR": (25,), "CR": (19,), "EMV": (26, 34), "DPO": (29, 34), "BRAR": (25, 25), "DFMA": (49, 58), "MTM": (12, 17), "MASS": (40, 45), "ROC": (12, 17),
    "OBV": (0,), "MFI": (13,), "ASI": (26, 35),
}
PRICES = {
    "WR": "chl", "BIAS": "c", "BOLL": "c", "PSY": "c", "CCI": "chl", "ATR": "chl", "BBI": "c", "DMI": "chl", "VR": "cv", "CR": "chl", "EMV": "hlv",
    "DPO": "c", "BRAR": "ochl", "DFMA": "c", "MTM": "c", "MASS": "hl", "ROC": "c", "OBV": "cv", "MFI": "chlv", "ASI": "ochl",
}


def first_rows(df, columns):
    rows = df.orderBy("trade_date").select(*columns).collect()
    return tuple(next(i for i, r in enumerate(rows) if r[k] is not None) for k in range(len(columns)))


def test_first_rows_of_window_indicators(bars):
    column = {name[0]: F.col(name) for name in ("open", "high", "low", "close", "volume")}
    made = {}
    for name, prices in PRICES.items():
        found = getattr(T, name)(*[column[p] for p in prices])
        made[name] = found if isinstance(found, tuple) else (found,)
    df = bars.select("trade_date", *[c.alias(f"{name}_{i}") for name, found in made.items() for i, c in enumerate(found)])
    for name, expected in FIRST.items():
        assert first_rows(df, [f"{name}_{i}" for i in range(len(expected))]) == expected, name


@pytest.mark.parametrize(
    ("make", "columns", "expected"),
    [
        (smoothed.macd, ("DIF", "DEA", "MACD"), (0, 0, 0)),
        (smoothed.kdj, ("K", "D", "J"), (8, 8, 8)),
        (smoothed.rsi, ("RSI",), (1,)),
        (smoothed.ktn, ("KTN_UPPER", "KTN_MID", "KTN_LOWER"), (9, 0, 9)),
        (smoothed.trix, ("TRIX", "TRMA"), (1, 20)),
        (smoothed.xsii, ("TD1", "TD2", "TD3", "TD4"), (4, 4, 0, 0)),
    ],
)
def test_first_rows_of_smoothed_indicators(bars, make, columns, expected):
    assert first_rows(smoothed.add(bars, make()), columns) == expected


def test_windows_share_one_shuffle(bars):
    column = {name[0]: F.col(name) for name in ("open", "high", "low", "close", "volume")}
    df = bars.select(*T.DMI(column["c"], column["h"], column["l"]), *T.BIAS(column["c"]), *T.MASS(column["h"], column["l"]))
    plan = df._jdf.queryExecution().optimizedPlan().toString() and df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1


def test_nmm_warm_up(bars):
    rows = bars.select("trade_date", T.NMM(F.col("close"))[0].alias("x"), T.NMM(F.col("close"), strict=True)[0].alias("y")).orderBy("trade_date").collect()
    assert rows[38]["x"] > 3000 and rows[38]["y"] is None and rows[39]["y"] is None
    assert rows[40]["x"] == pytest.approx(rows[40]["y"])
