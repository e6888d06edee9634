import datetime
import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.operators.recursive import DMA, EMA, SMA, Filter, Linear, Range, with_recursive


def frame(spark, series):
    rows = [(code, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i), x) for code, xs in series.items() for i, x in enumerate(xs)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "code string, trade_date timestamp, close double")


def run(df, step):
    found = with_recursive(df, {"y": step}).orderBy("code", "trade_date").collect()
    out = {}
    for row in found:
        out.setdefault(row["code"], []).append(row["y"])
    return out


@pytest.fixture(scope="module")
def series():
    rng = random.Random(3)
    return {f"s{k}": [None if rng.random() < 0.1 * (k == 2) else round(rng.uniform(1, 20), 2) for _ in range(300)] for k in range(5)} | {"one": [3.0]}


def test_ewm_as_pandas(spark, series):
    found = run(frame(spark, series), EMA("close", 12))
    for code, xs in series.items():
        expected = pd.Series(xs, dtype=float).ewm(span=12, adjust=False, ignore_na=False).mean()
        for x, got, want in zip(xs, found[code], expected, strict=True):
            assert got is None if x is None else got == pytest.approx(want, rel=1e-12)


def test_state_passes_between_batches(spark, series):
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    whole = {step: run(frame(spark, series), step) for step in (SMA("close", 5, 2), Range(("close",)))}
    spark.conf.set(conf, 7)
    try:
        for step, expected in whole.items():
            assert run(frame(spark, series), step) == expected
    finally:
        spark.conf.unset(conf)


def test_nan_stays_and_null_is_skipped(spark):
    assert run(frame(spark, {"a": [None, 1.0, None, 2.0]}), EMA("close", 3))["a"][:2] == [None, 1.0]
    found = run(frame(spark, {"a": [1.0, math.nan, 2.0]}), EMA("close", 3))["a"]
    assert found[0] == 1.0 and all(map(math.isnan, found[1:]))


def test_dma_constant_and_missing_weight(spark):
    df = frame(spark, {"a": [1.0, 2.0, 4.0]})
    assert run(df, DMA(("close",), weight=0.5))["a"] == [1.0, 1.5, 2.75]
    weighted = df.selectExpr("*", "case when close <> 2 then 0.5 end as w")
    assert run(weighted, DMA(("close", "w")))["a"] == [1.0, 1.0, 2.5]


def test_filter_is_quiet_for_n_rows(spark):
    df = frame(spark, {"a": [1.0] * 7 + [0.0, 1.0]}).selectExpr("code", "trade_date", "close > 0 as s")
    assert run(df, Filter(("s",), n=2))["a"] == [True, False, False, True, False, False, True, False, False]


def test_ranges_against_a_loop(spark):
    rng = random.Random(5)
    xs = [float(rng.randint(1, 9)) for _ in range(200)]

    def brute(stops):
        out = []
        for i, x in enumerate(xs):
            hit = [j for j in range(i) if stops(xs[j], x)]
            out.append(i - hit[-1] - 1 if hit else i)
        return out

    assert run(frame(spark, {"a": xs}), Range(("close",)))["a"] == brute(lambda v, x: v >= x)
    assert run(frame(spark, {"a": xs}), Range(("close",), lowest=True))["a"] == brute(lambda v, x: v <= x)


def test_steps_build_on_steps_and_empty_input(spark, series):
    steps = {"a": EMA("close", 3), "b": EMA("close", 5), "d": Linear(("a", "b"), factors=(1.0, -1.0)), "e": EMA("d", 4)}
    assert with_recursive(frame(spark, series), steps).columns == ["code", "trade_date", "close", "a", "b", "d", "e"]
    assert with_recursive(frame(spark, {}), steps).count() == 0


def alike(got, want):
    return got is None if want is None else got is not None and got == pytest.approx(want, rel=1e-9, abs=1e-9, nan_ok=True)


def tasks_of(spark, df, key):
    """Rows of a key by partition."""
    return [r["n"] for r in df.where(f"code = '{key}'").selectExpr("spark_partition_id() as p").groupBy("p").agg({"*": "count"}).toDF("p", "n").collect()]


@pytest.mark.parametrize("blocks", [1, 3, 7, 40])
def test_blocks_give_what_streams_give(spark, series, blocks):
    df = frame(spark, {**series, "nan": [1.0, math.nan, 2.0] * 20, "gap": [None] * 90 + [2.0, None, 5.0]}).selectExpr("*", "close > 10 as s", "case when close < 15 then close / 20 end as w")
    steps = {
        "a": EMA("close", 12), "b": SMA("close", 5, 2), "d": Linear(("a", "b"), factors=(1.0, -1.0)), "e": EMA("d", 9), "f": EMA("e", 3),
        "fixed": DMA(("close",), weight=0.3), "varying": DMA(("close", "w")), "fires": Filter(("s",), n=3), "rarely": Filter(("s",), n=70),
        "top": Range(("close",)), "low": Range(("close",), lowest=True), "smooth": Range(("a",)), "on": EMA("top", 3),
    }
    streamed = {(r["code"], r["trade_date"]): r for r in with_recursive(df, steps).collect()}
    found = with_recursive(df, steps, blocks=blocks)
    assert found.columns == [*df.columns, *steps]
    rows = found.collect()
    assert len(rows) == len(streamed)
    for row in rows:
        want = streamed[row["code"], row["trade_date"]]
        for name, step in steps.items():
            if isinstance(want[name], float):
                assert row[name] == pytest.approx(want[name], rel=1e-9, abs=1e-12, nan_ok=True), (name, row)
            else:
                assert row[name] == want[name], (name, row)


def test_a_hot_series_is_many_tasks(spark, monkeypatch):
    from barline.operators import blocks, recursive

    rng = random.Random(2)
    xs = [rng.uniform(1, 20) for _ in range(3000)]
    df = frame(spark, {"hot": xs, **{f"s{k}": xs[:60] for k in range(100)}})
    assert len(tasks_of(spark, with_recursive(df, {"y": EMA("close", 5)}), "hot")) == 1
    monkeypatch.setattr(recursive, "LONG_SERIES", 1000)
    base = blocks.in_blocks(df, ("code",), "trade_date", 12)
    shares = tasks_of(spark, base, "hot")
    assert len(shares) >= 4 and max(shares) <= 1200
    found = with_recursive(df, {"y": EMA("close", 5), "top": Range(("close",))})  # cut since a series is long
    assert found.where("code = 'hot'").count() == 3000
    want = pd.Series(xs).ewm(span=5, adjust=False).mean()
    assert [r["y"] for r in found.where("code = 'hot'").orderBy("trade_date").collect()] == pytest.approx(list(want))


@pytest.mark.parametrize("xs", [[100.0, *range(500)], list(range(500, 0, -1)), [5.0] * 500, [1e9, *([3.0, 1.0, 2.0] * 160)]])
def test_ranges_in_blocks_on_awkward_series(spark, monkeypatch, xs):
    from barline.operators import blocks

    monkeypatch.setattr(blocks, "ASKED_AT_ONCE", 50)
    df = frame(spark, {"a": list(map(float, xs)), "b": [1.0, 2.0]})
    steps = {"top": Range(("close",)), "low": Range(("close",), lowest=True)}
    want = {(r["code"], r["trade_date"]): r[3:] for r in with_recursive(df, steps).collect()}
    assert {(r["code"], r["trade_date"]): r[3:] for r in with_recursive(df, steps, blocks=9).collect()} == want


def test_the_tree_of_extremes_finds_the_last_block():
    from barline.operators.blocks import Extremes

    rng = random.Random(4)
    for n in range(1, 40):
        largest = [float(rng.randint(0, 20)) for _ in range(n)]
        tree = Extremes(largest)
        for before in range(n + 1):
            for x in (0.0, 7.0, 19.0, 20.0, 21.0):
                assert tree.last_at_least(x, before) == max((i for i in range(before) if largest[i] >= x), default=-1)


@pytest.mark.parametrize("blocks", [3, 40])
def test_windows_over_split_series(spark, series, blocks):
    from barline.functions.series import Series
    from barline.functions.technical import CCI, MASS
    from barline.operators.blocks import windowed

    df = frame(spark, {**series, "two": [1.0, 2.0]}).selectExpr("*", "close + 1 as high", "close - 1 as low")

    def make(s):
        c, h, low = F.col("close"), F.col("high"), F.col("low")
        mass, mean = MASS(h, low, s=s)
        return {"ma": s.MA("close", 20), "ahead": s.REF("close", -3), "hb": s.HHVBARS("close", 9), "cci": CCI(c, h, low, s=s), "mass": mass, "mean": mean, "wma": s.WMA("close", 10), "slope": s.SLOPE("close", 10)}

    whole = Series()
    want = {(r["code"], r["trade_date"]): r for r in df.select("*", *[c.alias(n) for n, c in make(whole).items()]).collect()}
    found = windowed(df, make, whole, before=60, after=3, blocks=blocks).collect()
    assert len(found) == len(want)
    for row in found:
        for name in ("ma", "ahead", "hb", "cci", "mass", "mean", "wma", "slope"):
            assert alike(row[name], want[row["code"], row["trade_date"]][name]), (name, row)


def test_running_steps_in_blocks(spark, series):
    from barline.functions.series import Series
    from barline.operators.recursive import Extreme, Latest, Since, Total

    df = frame(spark, {**series, "gap": [None, 2.0, None] * 60}).selectExpr("*", "close > 18 as up", "case when close > 18 then close end as at_rise")
    steps = {"total": Total(("close",)), "on": Total(("close",), through_null=True), "latest": Latest(("at_rise",)), "since": Since(("up",)), "hhv": Extreme(("close",), n=9), "llv": Extreme(("close",), n=9, lowest=True)}
    s = Series()
    columns = {"total": s.SUM("close", 0), "latest": s.VALUEWHEN(df["up"], "close"), "since": s.BARSLAST(df["up"]), "hhv": s.HHV("close", 9), "llv": s.LLV("close", 9)}
    want = {(r["code"], r["trade_date"]): r for r in df.select("code", "trade_date", *[c.alias(n) for n, c in columns.items()]).collect()}
    for blocks in (None, 11):
        rows = with_recursive(df, steps, blocks=blocks).collect()
        assert len(rows) == len(want)
        for row in rows:
            for name in columns:
                assert alike(row[name], want[row["code"], row["trade_date"]][name]), (name, row)


def test_windows_of_a_hot_series_are_many_tasks(spark):
    from barline.functions.series import Series
    from barline.operators.blocks import windowed

    df = frame(spark, {"hot": [float(i % 23) for i in range(4000)], **{f"s{k}": [1.0] * 20 for k in range(50)}})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        # Where a row is worked out is asked after the window, in its own stage.
        at = F.spark_partition_id().alias("p")
        ma = F.col("ma")
        whole = df.select("*", Series().MA("close", 20).alias("ma")).where("code = 'hot'").select(ma, at).where("ma > 0 or ma is null")
        assert len({r["p"] for r in whole.collect()}) == 1
        found = windowed(df, lambda s: {"ma": s.MA("close", 20)}, Series(), 19, blocks=12).where("code = 'hot'").select(ma, at).collect()
        shares = Counter(r["p"] for r in found)
        assert len(found) == 4000 and len(shares) >= 3 and max(shares.values()) < 2500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_absolute_deviations_by_rank(spark, series):
    from barline.functions.series import Series
    from barline.operators.recursive import AbsDev

    df = frame(spark, {**series, "ties": [1.0, 1.0, 2.0] * 40})
    want = {(r["code"], r["trade_date"]): r["y"] for r in df.select("code", "trade_date", Series().AVEDEV("close", 14).alias("y")).collect()}
    for blocks in (None, 9):
        for row in with_recursive(df, {"y": AbsDev(("close",), n=14)}, blocks=blocks).collect():
            assert alike(row["y"], want[row["code"], row["trade_date"]]), row


def test_long_windows_of_deviations_take_linear_log_time():
    import time

    from barline.operators.recursive import AbsDev

    rng = random.Random(1)
    xs = [rng.random() for _ in range(20_000)]
    step, took = AbsDev(("close",), n=2000), []
    for part in (xs[:5000], xs):
        state, began = step.start(), time.process_time()
        out = step.run(state, [part])
        took.append(time.process_time() - began)
    window = xs[-2000:]
    mean = sum(window) / 2000
    assert out[-1] == pytest.approx(sum(abs(x - mean) for x in window) / 2000) and out[1998] is None and out[1999] is not None
    assert took[1] < 8 * took[0] + 1


def test_convolutions_as_windows(spark, series):
    from barline.functions.technical import NMM, NMR
    from barline.operators.recursive import Weighted
    from barline.operators.smoothed import add, nm_in_steps

    df = frame(spark, series)
    nmm, nmr = NMM(F.col("close")), NMR(F.col("close"))
    want = {(r["code"], r["trade_date"]): r for r in df.select("*", nmm[0].alias("NMM"), nmm[1].alias("NMMB"), nmm[2].alias("NMMT"), nmr.alias("NMR")).collect()}
    for row in add(df, nm_in_steps()).collect():
        for name in ("NMM", "NMR"):
            assert row[name] == pytest.approx(want[row["code"], row["trade_date"]][name], rel=1e-7, abs=1e-4), (name, row)
        assert row["NMMB"] == want[row["code"], row["trade_date"]]["NMMB"] or abs(row["NMM"] + 3000) < 1e-3
    rng = random.Random(2)
    xs = [rng.uniform(-1, 1) for _ in range(5000)]
    step = Weighted(("x",), weights=tuple(1 / (j + 1) for j in range(100)))
    whole = step.run(step.start(), [xs])
    state, parts = step.start(), []
    for start in range(0, 5000, 37):
        parts += step.run(state, [xs[start : start + 37]])
    assert parts == pytest.approx(whole, abs=1e-9)
    assert whole[4000] == pytest.approx(sum(x / (j + 1) for j, x in enumerate(reversed(xs[3900:4000]))))
    again = step.after(step.after(step.start(), step.mapped([xs[:200]])), step.mapped([xs[200:]]))
    assert again[1] == state[1] == 5000 and list(again[0]) == pytest.approx(list(state[0]))
