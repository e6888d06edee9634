"""The queries of the library by name, and DuckDB SQL for their rows.

Queries on series are given by a function of the bars (or ticks) and by the same in SQL: layers of columns, each made
from those before it. Numbers are rounded on both sides, and what isn't finite is null.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from barline.functions import codes, dates
from barline.functions import numeric as N
from barline.functions import technical as T
from barline.functions.numeric import finite
from barline.functions.series import BETWEEN, Series
from barline.operators import blocks, catalog, predicates, recursive, smoothed
from barline.operators.buckets import BucketedTable
from barline.plans import adjust, breadth, indicators, kline, sync
from barline.plans.incremental import IndicatorStore
from barline.durable import durable, shared_folder
from barline.sources import fixtures, landing
from barline.streaming import live

S = Series()
Query = Callable[[SparkSession, str], DataFrame]

# SQL of the rolling functions

_W = "PARTITION BY code ORDER BY trade_date"


def _last(n: int) -> str:
    return f"({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(x: str, n: int, value: str) -> str:
    return f"CASE WHEN count({x}) OVER {_last(n)} >= {n} THEN {value} END"


def _roll(f: str, x: str, n: int) -> str:
    return _full(x, n, f"{f}({x}) OVER {_last(n)}")


def _ma(x: str, n: int) -> str:
    return _roll("avg", x, n)


def _sum(x: str, n: int) -> str:
    return _roll("sum", x, n)


def _ref(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({_W})"


def _so_far(f: str, x: str) -> str:
    return f"{f}({x}) OVER ({_W} ROWS UNBOUNDED PRECEDING)"


def _cols(f: Callable[[str], str], *names: str) -> dict[str, str]:
    return {name: f(name) for name in names}


@dataclass(frozen=True)
class Ewm:
    """A layer of recursive columns: y = a x + (1 - a) y', or with a column for a; out: (x, a)."""

    columns: dict[str, tuple[str, float | str]]
    seed_zero: bool = False


@dataclass(frozen=True)
class Quiet:
    """A layer of a recursive column: n on a row where the condition fires, then one less on each row, and 0 while nothing is quiet."""

    name: str
    condition: str
    n: int


Layer = dict[str, str] | Ewm | Quiet


def series_sql(outputs: dict[str, str], kinds: dict[str, object], layers: tuple[Layer, ...] = (), source: str = "bars", keys: str = "code, trade_date") -> str:
    parts = [fixtures.SQL.strip(), f"l0 AS MATERIALIZED (SELECT *, row_number() OVER ({_W}) AS rn FROM {source})"]
    for i, layer in enumerate((*layers, outputs)):
        if isinstance(layer, dict):
            parts.append(f"l{i + 1} AS MATERIALIZED (SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in layer.items())} FROM l{i})")
            continue
        if isinstance(layer, Quiet):
            parts.append(
                f"r{i}(code, rn, q) AS (SELECT code, rn, CASE WHEN {layer.condition} THEN {layer.n} ELSE -1 END FROM l{i} WHERE rn = 1 UNION ALL "
                f"SELECT s.code, s.rn, CASE WHEN s.{layer.condition} AND r.q <= 0 THEN {layer.n} ELSE r.q - 1 END FROM r{i} r JOIN l{i} s ON s.code = r.code AND s.rn = r.rn + 1)"
            )
            parts.append(f"l{i + 1} AS MATERIALIZED (SELECT l.*, r.q AS {layer.name} FROM l{i} l JOIN r{i} r ON r.code = l.code AND r.rn = l.rn)")
            continue
        names = layer.columns
        first = ", ".join(f"{x} AS {name}" for name, (x, _) in names.items())
        steps = []
        for name, (x, a) in names.items():
            old, new, a = f"r.{name}", f"s.{x}", (f"s.{a}" if isinstance(a, str) else f"{a!r}::DOUBLE")
            skip = f"{new} IS NULL" if a[0] != "s" else f"{a} IS NULL OR isnan({a})"
            steps.append(f"CASE WHEN {old} IS NULL THEN {new} WHEN {skip} THEN {old} ELSE {a} * {new} + (1 - {a}) * {old} END")
        parts.append(
            f"r{i}(code, rn, {', '.join(names)}) AS (SELECT code, rn, {first} FROM l{i} WHERE rn = 1 UNION ALL "
            f"SELECT s.code, s.rn, {', '.join(steps)} FROM r{i} r JOIN l{i} s ON s.code = r.code AND s.rn = r.rn + 1)"
        )
        taken = ", ".join(f"CASE WHEN l.{x} IS NOT NULL THEN r.{name} END AS {name}" for name, (x, _) in names.items())
        parts.append(f"l{i + 1} AS MATERIALIZED (SELECT l.*, {taken} FROM l{i} l JOIN r{i} r ON r.code = l.code AND r.rn = l.rn)")
    final = []
    for name in outputs:
        kind = kinds.get(name, 6)
        final.append(name if kind == "raw" else f"{name}::INT::DOUBLE AS {name}" if kind in ("int", "bool") else f"CASE WHEN isfinite({name}) THEN round({name}, {kind}) + 0.0 END AS {name}")
    return f"WITH RECURSIVE {', '.join(parts)} SELECT {keys}, {', '.join(final)} FROM l{len(layers) + 1}"


@dataclass(frozen=True)
class SeriesQuery:
    make: Callable[[Prices], dict[str, Column]] | Callable[[DataFrame], DataFrame]
    outputs: dict[str, str]
    layers: tuple[Layer, ...] = ()
    kinds: dict[str, object] = field(default_factory=dict)
    source: str = "bars"
    frame: bool = False  # make takes the DataFrame

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = {"bars": fixtures.bars, "ticks": fixtures.ticks, _LONG: fixtures.long_ticks}[self.source](spark, sf_dir)
        made = self.make(df) if self.frame else df.select("code", "trade_date", *[c.alias(n) for n, c in self.make(Prices()).items()])
        out = []
        for name in self.outputs:
            kind = self.kinds.get(name, 6)
            out.append(F.col(name).cast("double").alias(name) if kind in ("int", "bool") else finite(F.col(name).cast("double"), kind).alias(name))
        return made.select("code", "trade_date", *out)

    @property
    def sql(self) -> str:
        return series_sql(self.outputs, self.kinds, self.layers, self.source)


#: Ticks as one long series for each kind of event, and the blocks that such series are cut into.
_LONG, _BLOCKS = "(SELECT event_type AS code, trade_date, close FROM ticks)", 24


def _bools(*names: str) -> dict[str, object]:
    return dict.fromkeys(names, "bool")


def _ints(*names: str) -> dict[str, object]:
    return dict.fromkeys(names, "int")



class Prices:
    """The columns of a bar."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)

    @property
    def up(self) -> Column:
        """Whether the close rose."""
        return self.close > S.REF(self.close)


_UP_SQL = {"up": f"close > {_ref('close')}"}
_TR = {"tr": f"greatest(high - low, abs({_ref('close')} - high), abs({_ref('close')} - low))"}
_TP = "(high + low + close) / 3"


def _named(indicator: Callable[[], smoothed.Smoothed], **names: str) -> Callable[[DataFrame], DataFrame]:
    """Adds a smoothed indicator; new name = its name."""

    def frame(df: DataFrame) -> DataFrame:
        made = smoothed.add(df, indicator())
        return made.select("code", "trade_date", *[F.col(old).alias(new) for new, old in names.items()])

    return frame


def _jx_layers() -> tuple[Layer, ...]:
    return (Ewm({"jc": ("close", 1 / 2), "jl": ("low", 2 / 5), "jo": ("open", 1 / 2), "jh": ("high", 2 / 21)}), {"before_close": _ref("close")})


_JX = {"JXB": "jc - jl <= 0.003 AND before_close > 0", "JXT": "jo > jh * 1.05"}
_TD_LAYERS: tuple[Layer, ...] = (
    {"mid": "(" + " + ".join(_ma(p, n) for n in (5, 3, 2) for p in ("high", "low", "close", "open")) + " + high + low + close + open) / 16", "fast": _ma("close", 5) + " * 1.01::DOUBLE", "slow": _ma("open", 8) + " * 1.01::DOUBLE", "chg": f"close / {_ref('close')}"},
    {"hi": "CASE WHEN slow > mid THEN slow ELSE mid END", "lo": "CASE WHEN slow < mid THEN slow ELSE mid END"},
    {"upper_": _ma("hi", 5), "lower_": _ma("lo", 5)},
)
_TD = {
    "TDB": "mid - lower_ * 0.97::DOUBLE < 0.038 AND chg > 0.903 AND (chg > 0.952 OR chg < 0.948)",
    "TDT1": "mid > upper_ * 1.03::DOUBLE",
    "TDT2": "fast > upper_ * 1.03::DOUBLE",
}
_GL_LAYERS: tuple[Layer, ...] = ({"b60": f"round((close - {_ma('close', 60)}) / {_ma('close', 60)} * 100, 2)"},)
_GL = {"GLB": "b60 < -20", "GLGB": "b60 < -30", "GLT": "b60 > 30", "GLGT": "b60 > 50"}


def _nm_layers(weights: list[float]) -> tuple[Layer, ...]:
    n = len(weights)
    total = " + ".join(f"{w!r}::DOUBLE * coalesce(lag(before_ln, {j}) OVER ({_W}), 0)" for j, w in enumerate(weights))
    return ({"now_ln": "ln(close)"}, {"before_ln": f"coalesce({_ref('now_ln')}, 0)"}, {"weighted": f"CASE WHEN rn >= {n} THEN {total} ELSE 0 END"})


_NMM_W = [100000 / j**0.5 for j in range(1, 41)]
_NMR_W = [1000 * (j**0.5 - (j - 1) ** 0.5) for j in range(1, 101)]
_NMM_LAYERS = (*_nm_layers(_NMM_W), {"nm": f"(now_ln * {sum(_NMM_W)!r}::DOUBLE - weighted) / 40"})
_NMM = {"NMMB": "nm < -3000", "NMMT": "nm > 3000"}


SERIES: dict[str, SeriesQuery] = {
    # Numbers and shifts
    "scalar_math": SeriesQuery(
        lambda p: {"rd": N.RD(p.close, 1), "ab": N.ABS(p.open - p.close), "ln": N.LN(p.close), "pw": N.POW(p.close, 2), "sq": N.SQRT(p.close), "sn": N.SIN(p.close), "cs": N.COS(p.close), "tn": N.TAN(p.close / 100), "mx": N.MAX(p.close, p.open), "mn": N.MIN(p.close, p.open), "choice": N.IF(p.close > p.open, p.close, -p.open), "ratio": N.fdiv(p.close - p.low, p.high - p.low)},
        {"rd": "round(close, 1)", "ab": "abs(open - close)", "ln": "ln(close)", "pw": "pow(close, 2)", "sq": "sqrt(close)", "sn": "sin(close)", "cs": "cos(close)", "tn": "tan(close / 100)", "mx": "greatest(close, open)", "mn": "least(close, open)", "choice": "CASE WHEN close > open THEN close ELSE -open END", "ratio": "(close - low) / (high - low)"},
    ),
    "ref_diff": SeriesQuery(lambda p: {"ref1": S.REF(p.close), "ref_2": S.REF(p.close, -2), "diff3": S.DIFF(p.close, 3), "last_close": S.CONST(p.close)}, {"ref1": _ref("close"), "ref_2": f"lead(close, 2) OVER ({_W})", "diff3": f"close - {_ref('close', 3)}", "last_close": f"last_value(close) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"}),
    # Windows
    "ma": SeriesQuery(lambda p: {"ma5": S.MA(p.close, 5), "ma20": S.MA(p.close, 20), "ma250": S.MA(p.close, 250)}, {"ma5": _ma("close", 5), "ma20": _ma("close", 20), "ma250": _ma("close", 250)}, kinds={"ma250": 8}),
    "sum_n": SeriesQuery(lambda p: {"s5": S.SUM(p.volume, 5), "s0": S.SUM(p.volume, 0)}, {"s5": _sum("volume", 5), "s0": _so_far("sum", "volume")}),
    "std": SeriesQuery(lambda p: {"sd20": S.STD(p.close, 20)}, {"sd20": _roll("stddev_pop", "close", 20)}),
    "hhv_llv": SeriesQuery(lambda p: {"hhv": S.HHV(p.high, 9), "llv": S.LLV(p.low, 9)}, {"hhv": _roll("max", "high", 9), "llv": _roll("min", "low", 9)}),
    "hhvbars": SeriesQuery(
        lambda p: {"hb": S.HHVBARS(p.close, 9), "lb": S.LLVBARS(p.close, 9)},
        {"hb": _full("close", 9, f"rn - arg_max(rn, {{'a': close, 'b': -rn}}) OVER {_last(9)}"), "lb": _full("close", 9, f"rn - arg_min(rn, {{'a': close, 'b': rn}}) OVER {_last(9)}")},
        kinds=_ints("hb", "lb"),
    ),
    "wma": SeriesQuery(lambda p: {"wma10": S.WMA(p.close, 10)}, {"wma10": _full("close", 10, " + ".join(f"{10 - k} * {_ref('close', k)}" for k in range(10))).replace("THEN ", "THEN (").replace(" END", ") / 55.0 END")}),
    "avedev": SeriesQuery(lambda p: {"ad14": S.AVEDEV(p.close, 14)}, {"ad14": _full("close", 14, "list_sum(list_transform(w14, lambda v: abs(v - m14))) / 14")}, ({"w14": f"list(close) OVER {_last(14)}", "m14": f"avg(close) OVER {_last(14)}"},)),
    "slope": SeriesQuery(lambda p: {"slope": S.SLOPE(p.close, 10), "forecast": S.FORCAST(p.close, 10)}, {"slope": _full("close", 10, f"regr_slope(close, rn) OVER {_last(10)}"), "forecast": _full("close", 10, f"regr_intercept(close, rn) OVER {_last(10)} + regr_slope(close, rn) OVER {_last(10)} * rn")}),
    "last_n": SeriesQuery(lambda p: {"held": S.LAST(p.up, 2, 1)}, {"held": f"{_sum('u', 2)} = 2"}, (_UP_SQL, {"u": _ref("up::INT", 1)}), _bools("held")),
    # Signals
    "count_n": SeriesQuery(lambda p: {"n5": S.COUNT(p.up, 5), "n0": S.COUNT(p.up, 0)}, {"n5": _sum("up::INT", 5), "n0": f"CASE WHEN up IS NOT NULL THEN {_so_far('sum', 'up::INT')} END"}, (_UP_SQL,), _ints("n5", "n0")),
    "every_exist": SeriesQuery(lambda p: {"all3": S.EVERY(p.up, 3), "any3": S.EXIST(p.up, 3)}, {"all3": f"{_sum('up::INT', 3)} = 3", "any3": f"{_sum('up::INT', 3)} > 0"}, (_UP_SQL,), _bools("all3", "any3")),
    "barslast": SeriesQuery(lambda p: {"bl": S.BARSLAST(p.up)}, {"bl": f"rn - {_so_far('max', 'CASE WHEN up THEN rn END')}"}, (_UP_SQL,), _ints("bl")),
    "barslastcount": SeriesQuery(lambda p: {"run": S.BARSLASTCOUNT(p.up)}, {"run": f"CASE WHEN up THEN rn - coalesce({_so_far('max', 'CASE WHEN NOT up THEN rn END')}, 0) ELSE 0 END"}, (_UP_SQL,), _ints("run")),
    "barssincen": SeriesQuery(lambda p: {"since": S.BARSSINCEN(p.up, 5)}, {"since": f"coalesce({_full('up', 5, f'rn - min(CASE WHEN up THEN rn END) OVER {_last(5)}')}, 0)"}, (_UP_SQL,), _ints("since")),
    "cross": SeriesQuery(lambda p: {"golden": S.CROSS(S.MA(p.close, 5), S.MA(p.close, 10))}, {"golden": f"{_ref('a')} <= {_ref('b')} AND a > b"}, ({"a": _ma("close", 5), "b": _ma("close", 10)},), _bools("golden")),
    "longcross": SeriesQuery(lambda p: {"late": S.LONGCROSS(S.MA(p.close, 5), S.MA(p.close, 10), 3)}, {"late": f"{_sum('lower', 3)} = 3 AND a > b"}, ({"a": _ma("close", 5), "b": _ma("close", 10)}, {"lower": _ref("(a < b)::INT")}), _bools("late")),
    "valuewhen": SeriesQuery(lambda p: {"at_rise": S.VALUEWHEN(p.up, p.close)}, {"at_rise": f"last_value(CASE WHEN up THEN close END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING)"}, (_UP_SQL,)),
    "between": SeriesQuery(lambda p: {"inside": BETWEEN(p.close, S.REF(p.high), S.REF(p.low))}, {"inside": "(h1 < close AND close < l1) OR (h1 > close AND close > l1)"}, ({"h1": _ref("high"), "l1": _ref("low")},), _bools("inside")),
    "toprange": SeriesQuery(
        lambda df: recursive.ranges(df, "close", "top", "low_range"),
        {"top": "rn - 1 - coalesce((SELECT max(b.rn) FROM l0 b WHERE b.code = l0.code AND b.rn < l0.rn AND b.close >= l0.close), 0)", "low_range": "rn - 1 - coalesce((SELECT max(b.rn) FROM l0 b WHERE b.code = l0.code AND b.rn < l0.rn AND b.close <= l0.close), 0)"},
        kinds=_ints("top", "low_range"), source="ticks", frame=True,
    ),
    "toprange_window": SeriesQuery(
        lambda df: recursive.ranges(df, "close", "top", "low_range", blocks=_BLOCKS),
        {"top": "rn - 1 - coalesce((SELECT max(b.rn) FROM l0 b WHERE b.code = l0.code AND b.rn < l0.rn AND b.close >= l0.close), 0)", "low_range": "rn - 1 - coalesce((SELECT max(b.rn) FROM l0 b WHERE b.code = l0.code AND b.rn < l0.rn AND b.close <= l0.close), 0)"},
        kinds=_ints("top", "low_range"), source=_LONG, frame=True,
    ),
    # Recursive
    "ema": SeriesQuery(lambda df: recursive.with_recursive(df, {"ema12": recursive.EMA("close", 12), "ema26": recursive.EMA("close", 26)}), {"ema12": "e12", "ema26": "e26"}, (Ewm({"e12": ("close", 2 / 13), "e26": ("close", 2 / 27)}),), source="ticks", frame=True),
    "sma": SeriesQuery(lambda df: recursive.with_recursive(df, {"sma": recursive.SMA("close", 5, 2)}), {"sma": "y"}, (Ewm({"y": ("close", 2 / 5)}),), source="ticks", frame=True),
    "dma": SeriesQuery(lambda df: recursive.with_recursive(df.withColumn("w", F.col("close") / 100), {"fixed": recursive.DMA(("close",), weight=0.3), "varying": recursive.DMA(("close", "w"))}), {"fixed": "y1", "varying": "y2"}, ({"w": "close / 100"}, Ewm({"y1": ("close", 0.3), "y2": ("close", "w")})), source="ticks", frame=True),
    "filter_signal": SeriesQuery(
        lambda df: recursive.with_recursive(df.withColumn("up", S.DIFF("close") > 0), {"fires": recursive.Filter(("up",), n=3)}),
        {"fires": "len(list_filter(f, lambda x: x)) > 0 AND f[len(f)]"},
        ({"up": f"coalesce(close > {_ref('close')}, FALSE)"}, {"ups": f"list([up]) OVER ({_W} ROWS UNBOUNDED PRECEDING)"}, {"f": "list_reduce(ups, lambda acc, x: list_append(acc, x[1] AND len(list_filter(acc[greatest(len(acc) - 2, 1):], lambda z: z)) = 0), []::BOOLEAN[])"}),
        _bools("fires"), "ticks", True,
    ),
    # Long series, cut into blocks
    "ema_blocks": SeriesQuery(
        lambda df: recursive.with_recursive(df, {"ema12": recursive.EMA("close", 12), "sma": recursive.SMA("close", 5, 2), "_gap": recursive.Linear(("ema12", "sma"), factors=(1.0, -1.0)), "smooth": recursive.EMA("_gap", 9)}, blocks=_BLOCKS),
        {"ema12": "e12", "sma": "s5", "smooth": "sm"}, (Ewm({"e12": ("close", 2 / 13), "s5": ("close", 2 / 5)}), {"gap": "e12 - s5"}, Ewm({"sm": ("gap", 2 / 10)})), source=_LONG, frame=True,
    ),
    "dma_blocks": SeriesQuery(lambda df: recursive.with_recursive(df.withColumn("w", F.col("close") / 1000), {"fixed": recursive.DMA(("close",), weight=0.3), "varying": recursive.DMA(("close", "w"))}, blocks=_BLOCKS), {"fixed": "y1", "varying": "y2"}, ({"w": "close / 1000"}, Ewm({"y1": ("close", 0.3), "y2": ("close", "w")})), source=_LONG, frame=True),
    "filter_blocks": SeriesQuery(
        lambda df: recursive.with_recursive(df.withColumn("high_now", F.col("close") > 40), {"fires": recursive.Filter(("high_now",), n=5)}, blocks=_BLOCKS),
        {"fires": "q = 5"},
        ({"up": "close > 40"}, Quiet("q", "up", 5)),
        _bools("fires"), _LONG, True,
    ),
    "windows_blocks": SeriesQuery(
        lambda df: blocks.windowed(df, lambda s: {"ma20": s.MA("close", 20), "sd20": s.STD("close", 20), "hb": s.HHVBARS("close", 9), "gap": s.MA(s.MA("close", 5) - s.MA("close", 10), 5), "ahead": s.REF("close", -2)}, S, before=20, after=2, blocks=_BLOCKS),
        {"ma20": _ma("close", 20), "sd20": _roll("stddev_pop", "close", 20), "hb": _full("close", 9, f"rn - arg_max(rn, {{'a': close, 'b': -rn}}) OVER {_last(9)}"), "gap": _ma("g", 5), "ahead": f"lead(close, 2) OVER ({_W})"},
        ({"g": f"{_ma('close', 5)} - {_ma('close', 10)}"},), _ints("hb"), _LONG, True,
    ),
    "running_blocks": SeriesQuery(
        lambda df: recursive.with_recursive(df.selectExpr("*", "close > 60 as up", "case when close > 60 then close end as peak"), {"total": recursive.Total(("close",)), "latest": recursive.Latest(("peak",)), "since": recursive.Since(("up",))}, blocks=_BLOCKS),
        {"total": _so_far("sum", "close"), "latest": f"last_value(CASE WHEN close > 60 THEN close END IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING)", "since": f"rn - {_so_far('max', 'CASE WHEN close > 60 THEN rn END')}"},
        kinds={"total": 2} | _ints("since"), source=_LONG, frame=True,
    ),
    "avedev_steps": SeriesQuery(
        _named(lambda: smoothed.avedev(n=14), ad14="AVEDEV"), {"ad14": _full("close", 14, "list_sum(list_transform(w14, lambda v: abs(v - m14))) / 14")}, ({"w14": f"list(close) OVER {_last(14)}", "m14": f"avg(close) OVER {_last(14)}"},), frame=True,
    ),
    "nm_steps": SeriesQuery(_named(lambda: smoothed.nm_in_steps(), nmm="NMM", nmr="NMR"), {"nmm": "nm", "nmr": f"now_ln * {sum(_NMR_W)!r}::DOUBLE - heavier"}, (*_NMM_LAYERS, {"before_ln2": f"coalesce({_ref('now_ln')}, 0)"}, {"heavier": "CASE WHEN rn >= 100 THEN " + " + ".join(f"{w!r}::DOUBLE * coalesce(lag(before_ln2, {j}) OVER ({_W}), 0)" for j, w in enumerate(_NMR_W)) + " ELSE 0 END"}), {"nmm": 3, "nmr": 3}, frame=True),
    # Indicators
    "macd": SeriesQuery(_named(lambda: smoothed.macd(), dif="DIF", dea="DEA", macd="MACD"), {"dif": "round(d, 2)", "dea": "round(e, 2)", "macd": "round((d - e) * 2, 2)"}, (Ewm({"s": ("close", 2 / 13), "l": ("close", 2 / 27)}), {"d": "s - l"}, Ewm({"e": ("d", 2 / 10)})), frame=True),
    "kdj": SeriesQuery(_named(lambda: smoothed.kdj(), k="K", d="D", j="J"), {"k": "kk", "d": "dd", "j": "kk * 3 - dd * 2"}, ({"rsv": f"(close - {_roll('min', 'low', 9)}) / ({_roll('max', 'high', 9)} - {_roll('min', 'low', 9)}) * 100"}, Ewm({"kk": ("rsv", 2 / 6)}), Ewm({"dd": ("kk", 2 / 6)})), frame=True),
    "rsi": SeriesQuery(_named(lambda: smoothed.rsi(), rsi="RSI"), {"rsi": "round(r / m * 100, 2)"}, ({"mv": f"close - {_ref('close')}"}, {"rise": "greatest(mv, 0)", "mov": "abs(mv)"}, Ewm({"r": ("rise", 1 / 24), "m": ("mov", 1 / 24)})), frame=True),
    "wr": SeriesQuery(lambda p: dict(zip(("wr10", "wr6"), T.WR(p.close, p.high, p.low), strict=True)), {f"wr{n}": f"round(({_roll('max', 'high', n)} - close) / ({_roll('max', 'high', n)} - {_roll('min', 'low', n)}) * 100, 2)" for n in (10, 6)}),
    "bias": SeriesQuery(lambda p: dict(zip(("b6", "b12", "b24"), T.BIAS(p.close), strict=True)), {f"b{n}": f"round((close - {_ma('close', n)}) / {_ma('close', n)} * 100, 2)" for n in (6, 12, 24)}),
    # The bands are compared before they are rounded to cents: means of 20 prices in cents end in half cents, which no two ways of summing round alike.
    "boll": SeriesQuery(lambda p: dict(zip(("upper", "mid", "lower"), T.BOLL(p.close, digits=None), strict=True)), {"upper": "m + s * 2", "mid": "m", "lower": "m - s * 2"}, ({"m": _ma("close", 20), "s": _roll("stddev_pop", "close", 20)},)),
    "psy": SeriesQuery(lambda p: dict(zip(("psy", "psyma"), T.PSY(p.close), strict=True)), {"psy": "round(p, 2)", "psyma": f"round({_ma('p', 6)}, 2)"}, (_UP_SQL, {"p": f"{_sum('up::INT', 12)} / 12.0::DOUBLE * 100"})),
    "cci": SeriesQuery(lambda p: {"cci": T.CCI(p.close, p.high, p.low)}, {"cci": _full("tp", 14, "(tp - m) / (list_sum(list_transform(w, lambda v: abs(v - m))) / 14 * 0.015)")}, ({"tp": _TP}, {"m": f"avg(tp) OVER {_last(14)}", "w": f"list(tp) OVER {_last(14)}"}), kinds={"cci": 4}),
    "atr": SeriesQuery(lambda p: {"atr": T.ATR(p.close, p.high, p.low)}, {"atr": _ma("tr", 20)}, (_TR,)),
    "bbi": SeriesQuery(lambda p: {"bbi": T.BBI(p.close)}, {"bbi": f"({_ma('close', 3)} + {_ma('close', 6)} + {_ma('close', 12)} + {_ma('close', 20)}) / 4"}),
    "dmi": SeriesQuery(
        lambda df: T.with_dmi(df).withColumnsRenamed({"PDI": "pdi", "MDI": "mdi", "ADX": "adx", "ADXR": "adxr"}),
        {"pdi": "p", "mdi": "m", "adx": "x", "adxr": f"(x + {_ref('x', 6)}) / 2"},
        (_TR | {"hd": f"high - {_ref('high')}", "ld": f"{_ref('low')} - low"}, {"dp": "CASE WHEN hd > 0 AND hd > ld THEN hd ELSE 0 END", "dm": "CASE WHEN ld > 0 AND ld > hd THEN ld ELSE 0 END"}, {"p": f"{_sum('dp', 14)} * 100 / {_sum('tr', 14)}", "m": f"{_sum('dm', 14)} * 100 / {_sum('tr', 14)}"}, {"x0": "abs(m - p) / (p + m) * 100"}, {"x": _ma("x0", 6)}),
        frame=True,
    ),
    "taq": SeriesQuery(lambda p: dict(zip(("up", "mid", "down"), T.TAQ(p.high, p.low, 20), strict=True)), {"up": "u", "mid": "(u + d) / 2", "down": "d"}, ({"u": _roll("max", "high", 20), "d": _roll("min", "low", 20)},)),
    "ktn": SeriesQuery(_named(lambda: smoothed.ktn(), upper="KTN_UPPER", mid="KTN_MID", lower="KTN_LOWER"), {"upper": "e + 2 * a", "mid": "e", "lower": "e - 2 * a"}, (_TR | {"tp": _TP}, {"a": _ma("tr", 10)}, Ewm({"e": ("tp", 2 / 21)})), frame=True),
    "trix": SeriesQuery(_named(lambda: smoothed.trix(), trix="TRIX", trma="TRMA"), {"trix": "t", "trma": _ma("t", 20)}, (Ewm({"e1": ("close", 2 / 13)}), Ewm({"e2": ("e1", 2 / 13)}), Ewm({"e3": ("e2", 2 / 13)}), {"t": f"(e3 - {_ref('e3')}) / {_ref('e3')} * 100"}), frame=True),
    "vr": SeriesQuery(lambda p: {"vr": T.VR(p.close, p.volume)}, {"vr": f"{_sum('a', 26)} / {_sum('b', 26)} * 100"}, ({"a": f"CASE WHEN close > {_ref('close')} THEN volume ELSE 0 END", "b": f"CASE WHEN close <= {_ref('close')} THEN volume ELSE 0 END"},)),
    "cr": SeriesQuery(lambda p: {"cr": T.CR(p.close, p.high, p.low)}, {"cr": f"{_sum('a', 20)} / {_sum('b', 20)} * 100"}, ({"m": f"{_ref('high + low + close')} / 3"}, {"a": "greatest(0, high - m)", "b": "greatest(0, m - low)"}), kinds={"cr": 4}),
    "emv": SeriesQuery(lambda p: dict(zip(("emv", "maemv"), T.EMV(p.high, p.low, p.volume), strict=True)), {"emv": "e", "maemv": _ma("e", 9)}, ({"q": f"{_ma('volume', 14)} / volume", "m": f"100 * (high + low - {_ref('high + low')}) / (high + low)"}, {"x": f"m * q * (high - low) / {_ma('high - low', 14)}"}, {"e": _ma("x", 14)})),
    "dpo": SeriesQuery(lambda p: dict(zip(("dpo", "madpo"), T.DPO(p.close), strict=True)), {"dpo": "d", "madpo": _ma("d", 6)}, ({"m": _ma("close", 20)}, {"d": f"close - {_ref('m', 10)}"})),
    "brar": SeriesQuery(lambda p: dict(zip(("ar", "br"), T.BRAR(p.open, p.close, p.high, p.low), strict=True)), {"ar": f"{_sum('high - open', 26)} / {_sum('open - low', 26)} * 100", "br": f"{_sum('a', 26)} / {_sum('b', 26)} * 100"}, ({"a": f"greatest(0, high - {_ref('close')})", "b": f"greatest(0, {_ref('close')} - low)"},), kinds={"ar": 4, "br": 4}),
    "dfma": SeriesQuery(lambda p: dict(zip(("dif", "difma"), T.DFMA(p.close), strict=True)), {"dif": "d", "difma": _ma("d", 10)}, ({"d": f"{_ma('close', 10)} - {_ma('close', 50)}"},)),
    "mtm": SeriesQuery(lambda p: dict(zip(("mtm", "mtmma"), T.MTM(p.close), strict=True)), {"mtm": "m", "mtmma": _ma("m", 6)}, ({"m": f"close - {_ref('close', 12)}"},)),
    "mass": SeriesQuery(lambda p: dict(zip(("mass", "mamass"), T.MASS(p.high, p.low), strict=True)), {"mass": "s", "mamass": _ma("s", 6)}, ({"a": _ma("high - low", 9)}, {"q": f"a / {_ma('a', 9)}"}, {"s": _sum("q", 25)})),
    "roc": SeriesQuery(lambda p: dict(zip(("roc", "maroc"), T.ROC(p.close), strict=True)), {"roc": "r", "maroc": _ma("r", 6)}, ({"r": f"100 * (close - {_ref('close', 12)}) / {_ref('close', 12)}"},)),
    "expma": SeriesQuery(_named(lambda: smoothed.expma(), e12="EXPMA1", e50="EXPMA2"), {"e12": "a", "e50": "b"}, (Ewm({"a": ("close", 2 / 13), "b": ("close", 2 / 51)}),), frame=True),
    "obv": SeriesQuery(lambda p: {"obv": T.OBV(p.close, p.volume)}, {"obv": f"{_so_far('sum', 'v')} / 10000"}, ({"v": f"CASE WHEN close > {_ref('close')} THEN volume WHEN close < {_ref('close')} THEN -volume ELSE 0 END"},)),
    "mfi": SeriesQuery(lambda p: {"mfi": T.MFI(p.close, p.high, p.low, p.volume)}, {"mfi": f"100 - 100 / (1 + {_sum('a', 14)} / {_sum('b', 14)})"}, ({"tp": _TP}, {"a": f"CASE WHEN tp > {_ref('tp')} THEN tp * volume ELSE 0 END", "b": f"CASE WHEN tp < {_ref('tp')} THEN tp * volume ELSE 0 END"})),
    "asi": SeriesQuery(
        lambda p: dict(zip(("asi", "asit"), T.ASI(p.open, p.close, p.high, p.low), strict=True)),
        {"asi": "s", "asit": _ma("s", 10)},
        ({"lc": _ref("close"), "o1": _ref("open"), "l1": _ref("low")}, {"aa": "abs(high - lc)", "bb": "abs(low - lc)", "cc": "abs(high - l1)", "dd": "abs(lc - o1)"}, {"r": "CASE WHEN aa > bb AND aa > cc THEN aa + bb / 2 + dd / 4 WHEN bb > cc AND bb > aa THEN bb + aa / 2 + dd / 4 ELSE cc + dd / 4 END", "x": "close - lc + (close - open) / 2 + lc - o1"}, {"si": "16 * x / r * greatest(aa, bb)"}, {"s": _sum("si", 26)}),
    ),
    "xsii": SeriesQuery(
        _named(lambda: smoothed.xsii(), td1="TD1", td2="TD2", td3="TD3", td4="TD4"),
        {"td1": "a * 102 / 100", "td2": "a * (200 - 102) / 100", "td3": "1.07::DOUBLE * y", "td4": "0.93::DOUBLE * y"},
        ({"t": "(2 * close + high + low) / 4"}, {"a": _ma("t", 5), "cc": f"abs(t - {_ma('close', 20)}) / {_ma('close', 20)}"}, Ewm({"y": ("close", "cc")})),
        kinds=dict.fromkeys(("td1", "td2", "td3", "td4"), 8), frame=True,
    ),
    "w_jx": SeriesQuery(lambda df: smoothed.add(df, smoothed.w_jx()), _JX, _jx_layers(), _bools(*_JX), frame=True),
    "w_td": SeriesQuery(lambda df: T.with_td(df), _TD, _TD_LAYERS, _bools(*_TD), frame=True),
    "w_gl": SeriesQuery(lambda p: dict(zip(_GL, T.W_GL(p.close), strict=True)), _GL, _GL_LAYERS, _bools(*_GL)),
    "nmm": SeriesQuery(lambda p: dict(zip(("nmm", *_NMM), T.NMM(p.close), strict=True)), {"nmm": "nm"} | _NMM, _NMM_LAYERS, {"nmm": 2} | _bools(*_NMM)),
    "nmr": SeriesQuery(lambda p: {"nmr": T.NMR(p.close)}, {"nmr": f"now_ln * {sum(_NMR_W)!r}::DOUBLE - weighted"}, _nm_layers(_NMR_W), {"nmr": 3}),
}

# Other queries


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _market(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    bars = fixtures.bars(spark, sf_dir)
    return bars, fixtures.stock_list(spark, sf_dir), fixtures.capital_daily(bars), fixtures.stock_dividend(bars)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[finite(F.col(n), digits).alias(n) if kind == "double" else F.col(n) for n, kind in df.dtypes])


def select_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = [("c_acctbal", ">", 1000.0), ("c_mktsegment", "in", ("BUILDING", "MACHINERY")), ("c_name", "like", "Customer%")]
    return _table(spark, sf_dir, "customer").where(predicates.predicate(filters)).select("c_custkey", "c_nationkey", "c_mktsegment")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    stored = rows.where("c_custkey % 3 <> 0")
    return stored, rows.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal") + 1))


def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, batch = _halves(spark, sf_dir)
    return _rounded(catalog.union([stored, catalog.insert_ignore(stored, batch.union(batch), ["c_custkey"])]), 2)


def update_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, batch = _halves(spark, sf_dir)
    return _rounded(catalog.updated(stored, batch.select("c_custkey", "c_acctbal"), ["c_custkey"]), 2)


def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, batch = _halves(spark, sf_dir)
    rows = catalog.updated(stored, batch, ["c_custkey"])
    return _rounded(catalog.deleted(rows, predicates.predicate([("c_acctbal", "<", 5000.0)])), 2)


def agg_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.aggregate(_table(spark, sf_dir, "lineitem"), {"n": "count(1)", "lo": "min(l_quantity)", "hi": "max(l_quantity)", "mean": "avg(l_discount)"}, [("l_quantity", ">", 10.0)])
    return found.select("n", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), F.round(F.col("mean").cast("double"), 6).alias("mean"))


def agg_groupby(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.aggregate(_table(spark, sf_dir, "lineitem"), {"n": "count(l_orderkey)", "total": "sum(l_quantity)"}, [("l_discount", ">=", 0.02)], ["l_returnflag", "l_linestatus"])
    return found.select("l_returnflag", "l_linestatus", "n", F.round(F.col("total").cast("double"), 2).alias("total"))


def max_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.watermarks(fixtures.bars(spark, sf_dir))


def count_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breadth.count_range(fixtures.bars(spark, sf_dir))


def last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.RET(fixtures.ticks(spark, sf_dir), last_close=("close", 1), close_60=("close", 60))


def screen_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = breadth.screen(fixtures.ticks(spark, sf_dir).withColumn("trade_date", F.to_date("trade_date")), {"close": (2.0, 40.0)})
    found = breadth.by_date(rows, "close", "median", "mean", "max", "min")
    return _rounded(found.withColumn("trade_date", F.col("trade_date").cast("string")))


def median_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = fixtures.ticks(spark, sf_dir).select(F.to_date("trade_date").cast("string").alias("trade_date"), F.round("close", 1).alias("close"))
    return _rounded(breadth.median_by_date(ticks, "close"))


def stock_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, stocks, capital, _ = _market(spark, sf_dir)
    return _rounded(adjust.stock_view(bars, stocks, capital), 4)


def index_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, stocks, _, _ = _market(spark, sf_dir)
    return _rounded(adjust.index_view(bars, stocks), 4)


def dividend_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, _, _, dividends = _market(spark, sf_dir)
    return _rounded(adjust.dividend_view(bars, dividends))


def qfq_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(adjust.adjusted_view(*_market(spark, sf_dir)), 4)


def forward_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, _, _, dividends = _market(spark, sf_dir)
    return _rounded(adjust.forward_factors(bars, dividends))


def semi_dividend_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, _, _, dividends = _market(spark, sf_dir)
    return adjust.dividend_days(bars.where("high > low"), dividends).select("code", "trade_date")


def anti_missing_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = fixtures.ticks(spark, sf_dir)
    return sync.missing_codes(ticks, ticks.where("event_type = 'purchase' and code % 4 <> 0"))


def sync_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = fixtures.ticks(spark, sf_dir).select("code", "trade_date", "close")
    stored = ticks.where("close < 20 and code % 5 <> 0")
    return sync.due(ticks, ticks.where("code % 7 <> 0"), stored)


def breadth_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market breadth over adjusted prices: how many series show each signal at each hour."""
    view = adjust.adjusted_view(*_market(spark, sf_dir)).select("code", "trade_date", *[f"adj_{c}" for c in ("open", "high", "low", "close")])
    return breadth.breadth(breadth.with_signals(view, "adj_"), "adj_close")


def kline_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = kline.kline(adjust.adjusted_view(*_market(spark, sf_dir)), digits=6)
    return view.select("code", "trade_date", *[finite(F.col(c), 6).alias(c.lower()) for c in ("pct_chg", "MA5", "MA60", "CCI", "BIAS60", "DIF", "DEA", "MACD", "K", "D", "J", "RSI", "VOL5")], *[F.col(c).cast("double").alias(c) for c in ("JXB", "JXT")])


#: All columns of all indicators, by where the single queries have them.
_ALL = {
    "macd": {"dif": "DIF", "dea": "DEA", "macd": "MACD"}, "kdj": {"k": "K", "d": "D", "j": "J"}, "rsi": {"rsi": "RSI"}, "trix": {"trix": "TRIX", "trma": "TRMA"},
    "expma": {"e12": "EXPMA1", "e50": "EXPMA2"}, "wr": {"wr10": "WR1", "wr6": "WR2"}, "psy": {"psy": "PSY", "psyma": "PSYMA"}, "atr": {"atr": "ATR"},
    "bbi": {"bbi": "BBI"}, "dmi": {"pdi": "PDI", "mdi": "MDI", "adx": "ADX", "adxr": "ADXR"}, "taq": {"up": "TAQ_UP", "mid": "TAQ_MID", "down": "TAQ_DOWN"},
    "dpo": {"dpo": "DPO", "madpo": "MADPO"}, "dfma": {"dif": "DFMA", "difma": "DIFMA"}, "mtm": {"mtm": "MTM", "mtmma": "MTMMA"}, "mass": {"mass": "MASS", "mamass": "MA_MASS"},
    "roc": {"roc": "ROC", "maroc": "MAROC"}, "obv": {"obv": "OBV"}, "mfi": {"mfi": "MFI"}, "asi": {"asi": "ASI", "asit": "ASIT"},
    "bias": {"b6": "BIAS1", "b12": "BIAS2", "b24": "BIAS3"}, "boll": {"upper": "BOLL_UPPER", "mid": "BOLL_MID", "lower": "BOLL_LOWER"}, "cci": {"cci": "CCI"}, "ktn": {"upper": "KTN_UPPER", "mid": "KTN_MID", "lower": "KTN_LOWER"},
    "vr": {"vr": "VR"}, "cr": {"cr": "CR"}, "emv": {"emv": "EMV", "maemv": "MAEMV"}, "brar": {"ar": "AR", "br": "BR"}, "xsii": {"td1": "TD1", "td2": "TD2", "td3": "TD3", "td4": "TD4"},
    "nmm": {"nmm": "NMM", "NMMB": "NMMB", "NMMT": "NMMT"}, "nmr": {"nmr": "NMR"}, "w_jx": {n: n for n in _JX}, "w_td": {n: n for n in _TD}, "w_gl": {n: n for n in _GL},
}


def calc_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every indicator in one plan."""
    made = indicators.all_indicators(fixtures.bars(spark, sf_dir), boll_digits=None)  # compared as boll is

    def compared(column: str, kind: object) -> Column:
        return F.col(column).cast("double") if kind in ("int", "bool") else finite(F.col(column), kind)

    return made.select("code", "trade_date", *[compared(column, SERIES[name].kinds.get(own, 6)).alias(f"{name}_{own}") for name, columns in _ALL.items() for own, column in columns.items()])


def _landed_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of ticks."""
    events = fixtures.landed(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("code"), F.col("ts").cast("timestamp").alias("trade_date"), F.col("value").alias("close"))


def live_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MACD, KDJ and EXPMA of a stream of ticks that is read to its end: those that no tick is awaited before."""
    ticks = live.live_indicators(_landed_ticks(spark, sf_dir), smoothed.macd(), smoothed.kdj_in_steps("close", "close", "close"), smoothed.expma(), late="2 hours")
    made = live.to_the_end(ticks, f"{shared_folder(spark)}/live-{uuid.uuid4().hex}", spark)
    return _rounded(made.withColumn("trade_date", F.col("trade_date").cast("timestamp_ntz")).drop("close"), 4)


def live_from_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPMA of a stream that goes on where stored ticks end."""
    stream, known = _landed_ticks(spark, sf_dir), fixtures.ticks(spark, sf_dir).select("code", F.col("trade_date").cast("timestamp").alias("trade_date"), "close")
    middle = known.agg(F.timestamp_micros(F.floor((F.min(F.unix_micros("trade_date")) + F.max(F.unix_micros("trade_date"))) / 2)).alias("t")).first()["t"]
    stored = recursive.states(known.where(F.col("trade_date") <= F.lit(middle)), smoothed.expma().steps)
    ticks = live.live_indicators(stream, smoothed.expma(), late="2 hours", initial=stored)
    made = live.to_the_end(ticks, f"{shared_folder(spark)}/live-{uuid.uuid4().hex}", spark)
    return _rounded(made.withColumn("trade_date", F.col("trade_date").cast("timestamp_ntz")).drop("close"))


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of a store that was filled up to the middle of the bars, and then brought up to date."""
    bars = durable(fixtures.bars(spark, sf_dir))
    store = IndicatorStore(spark, f"{shared_folder(spark)}/indicators-{uuid.uuid4().hex}", boll_digits=None)
    middle = bars.select(F.timestamp_micros(F.floor((F.min(F.unix_micros(F.col("trade_date").cast("timestamp"))) + F.max(F.unix_micros(F.col("trade_date").cast("timestamp")))) / 2)).cast("timestamp_ntz").alias("t")).first()["t"]
    store.advance(bars.where(F.col("trade_date") <= F.lit(middle)))
    store.advance(bars)
    made = store.read().select("code", "trade_date", "DIF", "DEA", "K", "D", "OBV", "TRIX", "TRMA", "EXPMA2", "CCI")
    return _rounded(made.withColumn("OBV", F.round("OBV", 4)), 4)


def bucketed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucketed table after an insert, an insert of what is partly there, an update and a delete."""
    stored, batch = _halves(spark, sf_dir)
    stored, batch = (df.withColumn("c_acctbal", F.col("c_acctbal").cast("double")) for df in (stored, batch))
    table = BucketedTable(spark, f"{shared_folder(spark)}/buckets-{uuid.uuid4().hex}", stored.schema, ["c_custkey"], 16)
    table.insert(stored)
    table.insert(batch)
    table.update(batch.where("c_custkey % 10 = 0").select("c_custkey", (F.col("c_custkey") * 1.0).alias("c_acctbal")))
    table.delete([("c_acctbal", "<", 1000.0)])
    return _rounded(table.read(), 2)


def _stored_customers(spark: SparkSession) -> tuple[catalog.Catalog, str]:
    """A catalogue of its own with an empty table of customers."""
    schema = T_.StructType([T_.StructField("c_custkey", T_.LongType(), False), T_.StructField("c_mktsegment", T_.StringType()), T_.StructField("c_acctbal", T_.DoubleType())])
    return catalog.Catalog(spark, f"barline_{uuid.uuid4().hex}", {"customers": schema}).create(), "customers"


def catalog_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table after two batches, the second of which repeats keys; and what each insert reported."""
    market, name = _stored_customers(spark)
    stored, batch = _halves(spark, sf_dir)
    first, second = market.insert(name, stored), market.batch_insert_ignore(name, batch.union(batch))
    rows = market.select(name, [("c_custkey", ">", 0)], ["c_mktsegment", "c_acctbal"])
    found = rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return found.select("*", *[F.lit(report[what]).cast("long").alias(f"{what}_{at}") for at, report in (("first", first), ("second", second)) for what in ("inserted", "ignored")])


def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table after it was filled, emptied, and filled with another batch."""
    market, name = _stored_customers(spark)
    stored, batch = _halves(spark, sf_dir)
    market.insert(name, stored)
    market.truncate(name)
    emptied = market.read(name).count()
    market.insert(name, batch)
    market.vacuum()
    return market.read(name).agg(F.count("*").alias("n"), F.max("c_custkey").alias("last")).select(F.lit(emptied).cast("long").alias("emptied"), "n", "last")


def rounded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kline.round_numbers(fixtures.bars(spark, sf_dir).select("code", "trade_date", (F.col("high") / 7).alias("high"), (F.col("low") / 7).alias("low")), 3)


def viewport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kline.viewport(fixtures.ticks(spark, sf_dir).select("code", "trade_date", "close"), 20)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = kline.labels(fixtures.stock_list(spark, sf_dir))
    return made.withColumn("back", kline.code_of_label(F.col("label")))


_CODE = "CASE c_custkey % 6 WHEN 0 THEN ' sh.' || d WHEN 1 THEN d || '.SZ' WHEN 2 THEN d WHEN 3 THEN 'BJ' || d WHEN 4 THEN 'US ' || d ELSE 'x' || d END"
_DIGITS = "concat({start}, right(concat('000', cast(c_custkey as string)), 3))"
_STARTS = ("600", "000", "300", "399", "510", "159", "920", "880", "123")


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = "CASE c_custkey % 9 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STARTS)) + " END"
    return _table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_DIGITS.format(start=start)} AS d").selectExpr("c_custkey", f"{_CODE} AS raw")


def normalize_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and kinds of codes, each read once as a stock's and once as an index's."""
    raw = F.col("raw")
    read = _codes(spark, sf_dir).select("c_custkey", "raw", codes.parse_code(raw).alias("stock"), codes.parse_code(raw, "etf").alias("etf"), codes.parse_code(raw, "index").alias("index"))
    stock, index = codes.forms(F.col("stock")), codes.forms(F.col("index"))
    return read.select(
        "c_custkey", "raw", stock["pure_code"].alias("pure"), stock["suffix"].alias("suffix"), index["prefix_dot"].alias("index_dot"), index["prefix"].alias("index_prefix"),
        *[codes.parsed_is(F.col(kind), kind).alias(name) for kind, name in (("stock", "stock"), ("etf", "etf"), ("index", "index_"))],
    )


_DAY_TEXT = "CASE o_orderkey % 6 WHEN 0 THEN replace(d, '-', '') WHEN 1 THEN replace(d, '-', '/') || ' 9:05' WHEN 2 THEN replace(d, '-', '.') WHEN 3 THEN '2024-02-30' WHEN 4 THEN 'soon' ELSE d || ' 12:34:56' END"


def normalize_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", "substr(cast(o_orderdate as string), 1, 10) AS d").selectExpr("o_orderkey", f"{_DAY_TEXT} AS raw")
    forms = ("pure_num", "hyphen", "slash", "dot", "chinese", "hyphen_datetime", "slash_datetime", "chinese_datetime")
    return rows.select("o_orderkey", dates.normalize_trade_date(F.col("raw"), None).alias("date")).select("o_orderkey", *[f"date.{form}" for form in forms])


def landed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor rows, some prices missing, cleaned to the catalogue's schema."""
    raw = _codes(spark, sf_dir).selectExpr(
        "raw AS code", "'20240105' AS date", "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE cast(c_custkey AS string) END AS close", "cast(c_custkey + 1 AS string) AS open",
        "'' AS high", "CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE '0' END AS low", "cast(null AS string) AS volume", "'12.5' AS amount",
    )
    return landing.daily_bars(raw).withColumn("trade_date", F.col("trade_date").cast("string"))


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor rows with codes in many spellings, a day, and text for numbers."""
    return _codes(spark, sf_dir).selectExpr(
        "raw AS code", "concat('2024', lpad(cast(c_custkey % 12 + 1 AS string), 2, '0'), lpad(cast(c_custkey % 28 + 1 AS string), 2, '0')) AS date", "c_custkey",
        "CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '-' ELSE cast(c_custkey / 4 AS string) END AS number",
    )


def landed_index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _landed(spark, sf_dir).select("code", "date", F.col("number").alias("close"), *[F.col("number").alias(c) for c in ("open", "high", "low", "volume")], F.lit("").alias("amount"))
    return landing.VENDORS["terminal"].clean("index_daily", raw).withColumn("trade_date", F.col("trade_date").cast("string"))


def landed_dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _landed(spark, sf_dir).select("code", "date", (F.col("c_custkey") % 3).alias("Type"), *[F.col("number").alias(c) for c in ("Bonus", "ShareBonus", "Allotment", "AllotPrice")])
    return landing.VENDORS["terminal"].clean("stock_dividend", raw).withColumn("trade_date", F.col("trade_date").cast("string"))


def landed_capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _landed(spark, sf_dir).select("code", "date", F.col("number").alias("Zgb"), F.col("c_custkey").cast("string").alias("Ltgb"))
    return landing.VENDORS["terminal"].clean("capital_daily", raw).withColumn("trade_date", F.col("trade_date").cast("string"))


def landed_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.VENDORS["terminal"].clean("trade_date", _landed(spark, sf_dir)).select(F.col("trade_date").cast("string").alias("trade_date"))


def landed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stocks and indices, with the codes as the two vendors' requests spell them."""
    raw = _landed(spark, sf_dir).select("code", F.concat(F.lit(" n"), "c_custkey", F.lit(" ")).alias("name"))
    lists = [landing.VENDORS["terminal"].clean(kind, raw).withColumn("kind", F.lit(kind)) for kind in ("stock_list", "index_list")]
    made = catalog.union(lists)
    return made.select("kind", "code", "name", landing.VENDORS["terminal"].code(F.col("code")).alias("terminal"), landing.VENDORS["archive"].code(F.col("code")).alias("archive"))


def landed_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of the second vendor's bars."""
    raw = _landed(spark, sf_dir).select("code", "date", *[(F.col("number") if i % 2 else F.col("c_custkey").cast("string")).alias(old) for i, old in enumerate(landing.ARCHIVE_FIELDS)])
    return landing.VENDORS["archive"].clean("stock_daily", raw).withColumn("trade_date", F.col("trade_date").cast("string"))


def code_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All forms of a code, or why it can't be read."""
    raw = F.when(F.col("c_custkey") % 10 != 0, F.col("raw"))
    return _codes(spark, sf_dir).select("c_custkey", codes.normalize_code(raw, None).alias("made")).select("c_custkey", "made.*")


def date_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and timestamps of texts, or why they can't be read."""
    rows = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", "substr(cast(o_orderdate as string), 1, 10) AS d").selectExpr("o_orderkey", f"{_DAY_TEXT} AS raw")
    made = rows.select("o_orderkey", dates.normalize_trade_date(F.col("raw"), None).alias("made"))
    return made.select("o_orderkey", F.col("made.date_class").cast("string").alias("day"), F.col("made.datetime_class").cast("string").alias("moment"), F.col("made.error").alias("error"))


QUERIES: dict[str, Query] = {name: query.run for name, query in SERIES.items()} | {
    "select_filter": select_filter, "insert_ignore": insert_ignore, "update_record": update_record, "delete_where": delete_where,
    "agg_global": agg_global, "agg_groupby": agg_groupby, "max_date": max_date, "count_bars": count_bars, "last_value": last_value,
    "screen_statistics": screen_statistics, "stock_view": stock_view, "index_view": index_view, "dividend_view": dividend_view,
    "qfq_view": qfq_view, "forward_factors": forward_factors, "semi_dividend_dates": semi_dividend_dates,
    "anti_missing_codes": anti_missing_codes, "sync_due": sync_due, "breadth": breadth_query, "kline": kline_query,
    "median_by_date": median_by_date, "live_indicators": live_indicators, "live_from_stored": live_from_stored, "incremental": incremental, "bucketed_changes": bucketed_changes,
    "calc_all": calc_all, "truncate": truncate, "rounded_numbers": rounded_numbers, "viewport": viewport, "labels": labels, "normalize_codes": normalize_codes, "normalize_dates": normalize_dates, "landed_bars": landed_bars,
    "catalog_insert": catalog_insert, "landed_index_bars": landed_index_bars, "landed_dividends": landed_dividends, "landed_capital": landed_capital, "landed_calendar": landed_calendar,
    "landed_lists": landed_lists, "landed_archive": landed_archive, "code_errors": code_errors, "date_classes": date_classes,
}

_FIX = "WITH " + fixtures.SQL.strip()
_HALVES = "WITH c AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer), stored AS (SELECT * FROM c WHERE c_custkey % 3 <> 0), batch AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal + 1 END AS c_acctbal FROM c WHERE c_custkey % 2 = 0)"
_VIEW_CTES = f"""
, j AS (
    SELECT b.*, coalesce(v.dividend, 0) / 10 AS d, coalesce(v.bonus_ratio, 0) / 10 AS br, coalesce(v.rights_ratio, 0) / 10 AS rr, coalesce(v.rights_price, 0) AS rp,
        lag(close) OVER (PARTITION BY b.code ORDER BY b.trade_date) AS p
    FROM bars b LEFT JOIN stock_dividend v ON v.code = b.code AND v.trade_date = b.trade_date
), q AS (
    SELECT *, CASE WHEN p > 0 THEN p ELSE open END AS base FROM j
), ratios AS (
    SELECT code, trade_date, close, p AS pre_close, ((base - d + rr * rp) / greatest(1 + br + rr, 1)) / base AS adjust_ratio FROM q
), shifted AS (
    SELECT *, coalesce(lead(adjust_ratio) OVER ({_W}), 1) AS following FROM ratios
), factors AS (
    SELECT code, trade_date, close, pre_close, adjust_ratio,
        exp(sum(CASE WHEN following > 0 THEN ln(following) ELSE 0 END) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS qfq_factor
    FROM shifted
), adjusted AS (
    SELECT b.code, s.name, b.trade_date, b.open, b.high, b.low, b.close, b.volume, b.amount, c.total_share, c.float_share, f.qfq_factor,
        b.open * f.qfq_factor AS adj_open, b.high * f.qfq_factor AS adj_high, b.low * f.qfq_factor AS adj_low, b.close * f.qfq_factor AS adj_close,
        b.volume / f.qfq_factor AS adj_volume, b.amount / f.qfq_factor AS adj_amount
    FROM bars b JOIN stock_list s ON s.code = b.code JOIN capital_daily c ON c.code = b.code AND c.trade_date = b.trade_date
    JOIN factors f ON f.code = b.code AND f.trade_date = b.trade_date
)"""


def _round_sql(names: str, digits: int) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names.split())


def _on_adjusted(outputs: dict[str, str], kinds: dict[str, object], layers: tuple[Layer, ...], tail: str) -> str:
    """SQL of layers over adjusted prices, under the names of plain ones."""
    sql = series_sql(outputs, kinds, layers, "adj")
    plain = "adj AS (SELECT code, trade_date, " + ", ".join(f"adj_{c} AS {c}" for c in ("open", "high", "low", "close", "volume", "amount")) + " FROM adjusted), "
    sql = sql.replace("l0 AS MATERIALIZED", f"{_VIEW_CTES.strip().removeprefix(',')}, {plain} l0 AS MATERIALIZED", 1)
    return tail.format(sql=sql) if tail else sql


_SIGNAL_LAYERS = (*_jx_layers(), *_TD_LAYERS, *_GL_LAYERS, *_NMM_LAYERS)
_SIGNALS = _JX | _GL | _TD | _NMM
_KLINE_LAYERS: tuple[Layer, ...] = (
    *_jx_layers(),
    {"mv": f"close - {_ref('close')}", "tp": _TP, "rsv": f"(close - {_roll('min', 'low', 9)}) / ({_roll('max', 'high', 9)} - {_roll('min', 'low', 9)}) * 100"},
    {"rise": "greatest(mv, 0)", "mov": "abs(mv)", "m14": f"avg(tp) OVER {_last(14)}", "w14": f"list(tp) OVER {_last(14)}"},
    Ewm({"s12": ("close", 2 / 13), "l26": ("close", 2 / 27), "kk": ("rsv", 2 / 6), "ri": ("rise", 1 / 14), "mo": ("mov", 1 / 14)}),
    {"dd1": "s12 - l26"},
    Ewm({"de": ("dd1", 2 / 10), "dk": ("kk", 2 / 6)}),
)
_KLINE = {
    "pct_chg": f"(close / {_ref('close')} - 1) * 100", "ma5": _ma("close", 5), "ma60": _ma("close", 60),
    "cci": _full("tp", 14, "(tp - m14) / (list_sum(list_transform(w14, lambda v: abs(v - m14))) / 14 * 0.015)"),
    "bias60": f"round((close - {_ma('close', 60)}) / {_ma('close', 60)} * 100, 2)", "dif": "round(dd1, 2)", "dea": "round(de, 2)", "macd": "round((dd1 - de) * 2, 2)", "k": "kk", "d": "dk", "j": "kk * 3 - dk * 2",
    "rsi": "round(ri / mo * 100, 2)", "vol5": _ma("volume / 1000000", 5),
}
_DIGITS_SQL = "(CASE c_custkey % 9 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STARTS)) + " END || right('000' || c_custkey::VARCHAR, 3))"
_RAW_SQL = f"""WITH c0 AS (SELECT c_custkey, {_DIGITS_SQL} AS d FROM customer), c1 AS (SELECT c_custkey, {_CODE} AS raw FROM c0),
c2 AS (SELECT c_custkey, raw, replace(replace(upper(raw), ' ', ''), '.', '') AS t FROM c1),
c3 AS (SELECT *, translate(t, '0123456789', '') AS w, right(rtrim(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 6) AS d FROM c2),
c4 AS (SELECT *, length(w) IN (0, 2) AND length(d) = 6 AS ok FROM c3)"""
_LANDED_SQL = f"""{_RAW_SQL}, landed AS (
    SELECT c_custkey, CASE WHEN ok THEN d END AS code, '2024-' || lpad((c_custkey % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') AS trade_date,
        CASE WHEN c_custkey % 5 > 1 THEN c_custkey / 4 END::DOUBLE AS x, c4.* EXCLUDE (c_custkey) FROM c4)"""


def _market_sql(kind: str) -> str:
    found = " ".join(f"WHEN substr(d, 1, 3) IN ({', '.join(repr(p) for p in prefixes)}) THEN '{market}'" for market, prefixes in codes.PREFIXES[kind].items() if prefixes)
    return f"(CASE WHEN NOT ok THEN NULL WHEN w IN ('SZ', 'SH', 'BJ') THEN w WHEN w <> '' THEN 'UNKNOWN' {found} ELSE 'UNKNOWN' END)"


def _guessed_sql() -> str:
    """The market of a bare stock code."""
    return "(CASE " + " ".join(f"WHEN substr(d, 1, 3) IN ({', '.join(repr(p) for p in prefixes)}) THEN '{market}'" for market, prefixes in codes.PREFIXES["stock"].items()) + " ELSE 'UNKNOWN' END)"


def _kind_sql(kind: str) -> str:
    found = " OR ".join(f"({_market_sql(kind)} = '{market}' AND substr(d, 1, 3) IN ({', '.join(repr(p) for p in prefixes)}))" for market, prefixes in codes.PREFIXES[kind].items() if prefixes)
    return f"coalesce(ok AND ({found}), FALSE)"


ORACLE_SQL: dict[str, str] = {name: query.sql for name, query in SERIES.items()} | {
    "select_filter": "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 1000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name LIKE 'Customer%'",
    "insert_ignore": f"{_HALVES} SELECT c_custkey, c_mktsegment, round(c_acctbal::DOUBLE, 2) + 0.0 AS c_acctbal FROM (SELECT * FROM stored UNION ALL SELECT * FROM batch WHERE c_custkey NOT IN (SELECT c_custkey FROM stored))",
    "update_record": f"{_HALVES} SELECT s.c_custkey, s.c_mktsegment, round((CASE WHEN b.c_custkey IS NOT NULL THEN b.c_acctbal ELSE s.c_acctbal END)::DOUBLE, 2) + 0.0 AS c_acctbal FROM stored s LEFT JOIN batch b ON b.c_custkey = s.c_custkey",
    "delete_where": f"{_HALVES}, u AS (SELECT s.c_custkey, s.c_mktsegment, CASE WHEN b.c_custkey IS NOT NULL THEN b.c_acctbal ELSE s.c_acctbal END AS c_acctbal FROM stored s LEFT JOIN batch b ON b.c_custkey = s.c_custkey) SELECT c_custkey, c_mktsegment, round(c_acctbal::DOUBLE, 2) + 0.0 AS c_acctbal FROM u WHERE NOT coalesce(c_acctbal < 5000, FALSE)",
    "agg_global": "SELECT count(*) AS n, min(l_quantity)::DOUBLE AS lo, max(l_quantity)::DOUBLE AS hi, round(avg(l_discount)::DOUBLE, 6) AS mean FROM lineitem WHERE l_quantity > 10",
    "agg_groupby": "SELECT l_returnflag, l_linestatus, count(l_orderkey) AS n, round(sum(l_quantity)::DOUBLE, 2) AS total FROM lineitem WHERE l_discount >= 0.02 GROUP BY ALL",
    "max_date": f"{_FIX} SELECT code, max(trade_date) AS since FROM bars GROUP BY code",
    "count_bars": f"{_FIX}, n AS (SELECT trade_date, count(*) AS n FROM bars GROUP BY trade_date) SELECT min(n) AS least, max(n) AS most FROM n",
    "last_value": f"{_FIX} SELECT code, max(CASE WHEN k = 1 THEN close END) AS last_close, max(CASE WHEN k = 60 THEN close END) AS close_60 FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS k FROM ticks) GROUP BY code",
    "screen_statistics": f"{_FIX} SELECT trade_date::DATE::VARCHAR AS trade_date, round(median(close), 6) AS median, round(avg(close), 6) AS mean, max(close) AS max, min(close) AS min FROM ticks WHERE close BETWEEN 2 AND 40 GROUP BY trade_date::DATE",
    "median_by_date": "SELECT ts::DATE::VARCHAR AS trade_date, round(median(round(value, 1)), 6) + 0.0 AS median FROM events GROUP BY ts::DATE",
    "stock_view": f"{_FIX}{_VIEW_CTES} SELECT code, name, trade_date, {_round_sql('open high low close volume amount total_share float_share', 4)} FROM adjusted",
    "index_view": f"{_FIX} SELECT code, name, trade_date, {_round_sql('open high low close volume amount', 4)} FROM bars JOIN stock_list USING (code)",
    "dividend_view": f"{_FIX}{_VIEW_CTES} SELECT code, trade_date, {_round_sql('close pre_close adjust_ratio qfq_factor', 6)} FROM factors",
    "qfq_view": f"{_FIX}{_VIEW_CTES} SELECT code, name, trade_date, {_round_sql('open high low close volume amount total_share float_share qfq_factor adj_open adj_high adj_low adj_close adj_volume adj_amount', 4)} FROM adjusted",
    "forward_factors": f"""{_FIX}, j AS (
        SELECT b.code, b.trade_date, v.dividend / 10 AS d, v.bonus_ratio / 10 AS br, v.rights_ratio / 10 AS rr, v.rights_price AS rp, lag(close) OVER (PARTITION BY b.code ORDER BY b.trade_date) AS p
        FROM bars b LEFT JOIN stock_dividend v ON v.code = b.code AND v.trade_date = b.trade_date
    ), r AS (SELECT code, trade_date, CASE WHEN p > 0 AND d IS NOT NULL THEN ((p - d + rr * rp) / greatest(1 + br + rr, 1)) / p ELSE 1 END AS ratio FROM j
    ), s AS (SELECT *, coalesce(lead(ratio) OVER ({_W}), 1) AS following FROM r)
    SELECT code, trade_date, round(product(following) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS forward_factor FROM s""",
    "semi_dividend_dates": f"{_FIX} SELECT code, trade_date FROM stock_dividend v WHERE EXISTS (SELECT 1 FROM bars b WHERE b.code = v.code AND b.trade_date = v.trade_date AND high > low)",
    "anti_missing_codes": f"{_FIX} SELECT DISTINCT code FROM ticks WHERE code NOT IN (SELECT code FROM ticks WHERE event_type = 'purchase' AND code % 4 <> 0)",
    "sync_due": f"{_FIX}, since AS (SELECT code, max(trade_date) FILTER (WHERE close < 20 AND code % 5 <> 0) AS since FROM ticks WHERE code % 7 <> 0 GROUP BY code) SELECT t.code, t.trade_date, t.close FROM ticks t JOIN since s ON s.code = t.code WHERE t.trade_date >= coalesce(s.since, TIMESTAMP '1990-12-19')",
    "breadth": _on_adjusted(
        {"px": "close"} | _SIGNALS, dict.fromkeys(("px", *_SIGNALS), "raw"), _SIGNAL_LAYERS,
        "SELECT trade_date, count(px)::INTEGER AS total, " + ", ".join(f"sum(coalesce({n}, FALSE)::INT)::INTEGER AS {n}" for n in breadth.SIGNALS) + " FROM ({sql}) GROUP BY trade_date",
    ),
    "kline": _on_adjusted(_KLINE | _JX, dict.fromkeys(_KLINE, 6) | _bools(*_JX), _KLINE_LAYERS, "SELECT * REPLACE (strftime(trade_date, '%Y-%m-%d') AS trade_date) FROM ({sql})"),
    "calc_all": "SELECT code, trade_date, " + ", ".join(f"{n}.{own} AS {n}_{own}" for n, columns in _ALL.items() for own in columns) + " FROM " + " JOIN ".join(f"({SERIES[n].sql}) {n}" + (" USING (code, trade_date)" if i else "") for i, n in enumerate(_ALL)),
    "live_indicators": "SELECT * REPLACE (trade_date::TIMESTAMP AS trade_date) FROM (" + series_sql(
        {"DIF": "round(d0, 2)", "DEA": "round(e, 2)", "MACD": "round((d0 - e) * 2, 2)", "K": "kk", "D": "dd", "J": "kk * 3 - dd * 2", "EXPMA1": "a", "EXPMA2": "b"}, dict.fromkeys(("DIF", "DEA", "MACD", "K", "D", "J", "EXPMA1", "EXPMA2"), 4),
        ({"rsv": f"(close - {_roll('min', 'close', 9)}) / ({_roll('max', 'close', 9)} - {_roll('min', 'close', 9)}) * 100"}, Ewm({"s": ("close", 2 / 13), "l": ("close", 2 / 27), "kk": ("rsv", 2 / 6), "a": ("close", 2 / 13), "b": ("close", 2 / 51)}), {"d0": "s - l"}, Ewm({"e": ("d0", 2 / 10), "dd": ("kk", 2 / 6)})), "ticks",
    ) + ") WHERE trade_date <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)",
    "incremental": series_sql(
        {"DIF": "round(d0, 2)", "DEA": "round(e, 2)", "K": "kk", "D": "dd", "OBV": "round(ob / 10000, 4)", "TRIX": "tx", "TRMA": _ma("tx", 20), "EXPMA2": "x50", "CCI": _full("tp", 14, "(tp - m14) / (list_sum(list_transform(w14, lambda v: abs(v - m14))) / 14 * 0.015)")},
        dict.fromkeys(("DIF", "DEA", "K", "D", "OBV", "TRIX", "TRMA", "EXPMA2", "CCI"), 4),
        (
            {"rsv": f"(close - {_roll('min', 'low', 9)}) / ({_roll('max', 'high', 9)} - {_roll('min', 'low', 9)}) * 100", "sv": f"CASE WHEN close > {_ref('close')} THEN volume WHEN close < {_ref('close')} THEN -volume ELSE 0 END", "tp": _TP},
            {"ob": _so_far("sum", "sv"), "m14": f"avg(tp) OVER {_last(14)}", "w14": f"list(tp) OVER {_last(14)}"},
            Ewm({"s": ("close", 2 / 13), "l": ("close", 2 / 27), "kk": ("rsv", 2 / 6), "x50": ("close", 2 / 51), "t1": ("close", 2 / 13)}), {"d0": "s - l"}, Ewm({"e": ("d0", 2 / 10), "dd": ("kk", 2 / 6), "t2": ("t1", 2 / 13)}), Ewm({"t3": ("t2", 2 / 13)}),
            {"tx": f"(t3 - {_ref('t3')}) / {_ref('t3')} * 100"},
        ),
    ),
    "bucketed_changes": f"""{_HALVES}, a AS (SELECT * FROM stored UNION ALL SELECT * FROM batch WHERE c_custkey NOT IN (SELECT c_custkey FROM stored)),
        u AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 10 = 0 THEN c_custkey::DOUBLE ELSE c_acctbal::DOUBLE END AS c_acctbal FROM a)
        SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) + 0.0 AS c_acctbal FROM u WHERE NOT coalesce(c_acctbal < 1000, FALSE)""",
    "live_from_stored": "SELECT * REPLACE (trade_date::TIMESTAMP AS trade_date) FROM (" + series_sql({"EXPMA1": "a", "EXPMA2": "b"}, {}, (Ewm({"a": ("close", 2 / 13), "b": ("close", 2 / 51)}),), "ticks")
    + ") WHERE trade_date <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) AND epoch_us(trade_date) > (SELECT (epoch_us(min(ts)) + epoch_us(max(ts))) // 2 FROM events)",
    "truncate": f"{_HALVES} SELECT 0::BIGINT AS emptied, count(*) AS n, max(c_custkey) AS last FROM batch",
    "catalog_insert": f"""{_HALVES}, fresh AS (SELECT * FROM batch WHERE c_custkey NOT IN (SELECT c_custkey FROM stored)), both_ AS (SELECT * FROM stored UNION ALL SELECT * FROM fresh)
        SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal::DOUBLE), 2) AS balance, (SELECT count(*) FROM stored) AS inserted_first, 0::BIGINT AS ignored_first,
            (SELECT count(*) FROM fresh) AS inserted_second, 2 * (SELECT count(*) FROM batch) - (SELECT count(*) FROM fresh) AS ignored_second FROM both_ WHERE c_custkey > 0 GROUP BY c_mktsegment""",
    "landed_index_bars": f"{_LANDED_SQL} SELECT code, trade_date, x AS open, x AS high, x AS low, x AS close, x AS volume, 0.0::DOUBLE AS amount FROM landed WHERE ok AND x > 0",
    "landed_dividends": f"{_LANDED_SQL} SELECT code, trade_date, (c_custkey % 3)::VARCHAR AS category, x AS dividend, x AS bonus_ratio, x AS rights_ratio, x AS rights_price FROM landed",
    "landed_capital": f"{_LANDED_SQL} SELECT code, trade_date, x AS total_share, c_custkey::DOUBLE AS float_share FROM landed",
    "landed_calendar": f"{_LANDED_SQL} SELECT DISTINCT trade_date FROM landed",
    "rounded_numbers": f"{_FIX} SELECT code, trade_date, round(high / 7, 3) AS high, round(low / 7, 3) AS low FROM bars",
    "viewport": f"{_FIX} SELECT code, trade_date, close FROM ticks QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) <= 20",
    "labels": f"{_FIX} SELECT code, name, code || ' - ' || name AS label, code AS back FROM stock_list",
    "normalize_codes": f"{_RAW_SQL} SELECT c_custkey, raw, CASE WHEN ok THEN d END AS pure, d || '.' || {_market_sql('stock')} AS suffix, {_market_sql('index')} || '.' || d AS index_dot, {_market_sql('index')} || d AS index_prefix, {_kind_sql('stock')} AS stock, {_kind_sql('etf')} AS etf, {_kind_sql('index')} AS index_ FROM c4",
    "normalize_dates": f"""WITH d0 AS (SELECT o_orderkey, left(o_orderdate::VARCHAR, 10) AS d FROM orders), d1 AS (SELECT o_orderkey, {_DAY_TEXT} AS raw FROM d0), d2 AS (
        SELECT o_orderkey, coalesce(try_strptime(raw, '%Y%m%d'), try_strptime(raw, '%Y/%m/%d %H:%M'), try_strptime(raw, '%Y.%m.%d'), try_strptime(raw, '%Y-%m-%d %H:%M:%S')) AS t FROM d1)
    SELECT o_orderkey, strftime(t, '%Y%m%d') AS pure_num, strftime(t, '%Y-%m-%d') AS hyphen, strftime(t, '%Y/%m/%d') AS slash, strftime(t, '%Y.%m.%d') AS dot, strftime(t, '%Y年%m月%d日') AS chinese,
        strftime(t, '%Y-%m-%d %H:%M:%S') AS hyphen_datetime, strftime(t, '%Y/%m/%d %H:%M:%S') AS slash_datetime, strftime(t, '%Y年%m月%d日 %H时%M分%S秒') AS chinese_datetime FROM d2""",
    "landed_lists": f"{_LANDED_SQL} SELECT kind, code, 'n' || c_custkey AS name, code || '.' || {_guessed_sql()} AS terminal, lower({_guessed_sql()}) || '.' || code AS archive FROM landed, (VALUES ('stock_list'), ('index_list')) k(kind) WHERE ok",
    "landed_archive": f"{_LANDED_SQL} SELECT code, trade_date, " + ", ".join(f"{'x' if i % 2 else 'c_custkey::DOUBLE'} AS {new}" for i, new in enumerate(landing.ARCHIVE_FIELDS.values())) + " FROM landed WHERE ok",
    "code_errors": f"""{_RAW_SQL}, e AS (SELECT *, ok AND c_custkey % 10 <> 0 AS good, {_market_sql('stock')} AS m FROM c4)
        SELECT c_custkey, CASE WHEN good THEN d END AS pure_code, CASE WHEN good THEN d || '.' || m END AS suffix, CASE WHEN good THEN m || '.' || d END AS prefix_dot, CASE WHEN good THEN m || d END AS prefix,
            CASE WHEN c_custkey % 10 = 0 THEN 'code is null' WHEN NOT ok THEN 'not a code: ' || upper(trim(raw)) END AS error FROM e""",
    "date_classes": f"""WITH d0 AS (SELECT o_orderkey, left(o_orderdate::VARCHAR, 10) AS d FROM orders), d1 AS (SELECT o_orderkey, {_DAY_TEXT} AS raw FROM d0), d2 AS (
        SELECT o_orderkey, raw, coalesce(try_strptime(raw, '%Y%m%d'), try_strptime(raw, '%Y/%m/%d %H:%M'), try_strptime(raw, '%Y.%m.%d'), try_strptime(raw, '%Y-%m-%d %H:%M:%S')) AS t FROM d1)
        SELECT o_orderkey, strftime(t, '%Y-%m-%d') AS day, strftime(t, '%Y-%m-%d %H:%M:%S') AS moment, CASE WHEN t IS NULL THEN 'not a date: ' || raw END AS error FROM d2""",
    "landed_bars": f"""{_RAW_SQL}, v AS (
        SELECT d AS code, '2024-01-05' AS trade_date, (CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END)::DOUBLE AS c, (c_custkey + 1)::DOUBLE AS o, (CASE WHEN c_custkey % 3 <> 0 THEN 0 END)::DOUBLE AS l FROM c4 WHERE ok)
    SELECT code, trade_date, o AS open, coalesce(c, o) AS high, coalesce(l, c, o) AS low, coalesce(c, o) AS close, 0.0::DOUBLE AS volume, 12.5::DOUBLE AS amount FROM v WHERE coalesce(c, o) > 0""",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
