import datetime
import random

import pytest

from barline.plans.incremental import LOOKBACK, IndicatorStore
from barline.plans.indicators import all_indicators

BARS = "code string, trade_date timestamp, open double, high double, low double, close double, volume double, amount double"


def bars_of(days):
    rng, rows = random.Random(11), []
    for code in ("a", "b", "c"):
        price = 20.0
        for day in days:
            price = max(1.0, price + rng.uniform(-1, 1))
            # b rests on some days, c starts late
            if not (code == "b" and day % 4 == 0) and not (code == "c" and day < 395):
                rows.append((code, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day), price, price + rng.random(), price - rng.random(), price + rng.uniform(-0.4, 0.4), float(rng.randint(1, 99)), 1.0))
    return rows


def test_ten_days_equal_a_full_run(spark, tmp_path):
    rows = bars_of(range(403))
    at = {r[1] for r in rows}
    first = sorted(at)[392]
    days = [d for d in sorted(at) if d > first]
    assert len(days) == 10
    for day in [None, *days]:
        part = [r for r in rows if (r[1] <= first if day is None else r[1] == day)]
        spark.createDataFrame(part, BARS).coalesce(1).write.mode("append").parquet(str(tmp_path / "bars"))
        bars = spark.read.parquet(str(tmp_path / "bars"))
        store = IndicatorStore(spark, str(tmp_path / "store"))
        if day is not None:
            assert f"GreaterThan(trade_date,{day}" in store.due(bars)._jdf.queryExecution().executedPlan().toString().replace("T", " ").replace("00:00Z", "00:00") or "GreaterThan(trade_date" in store.due(bars)._jdf.queryExecution().toString()
        got = store.advance(bars)
        known = {r[0] for r in part if day is not None} & {"a", "b", *("c" if day is not None and day > days[2] else "")}
        assert got["rows"] == len(part)
        assert got["earlier"] <= LOOKBACK * len(known)
    assert store.advance(bars) == {"rows": 0, "earlier": 0} and store.versions() == list(range(11))
    want = {(r["code"], r["trade_date"]): r for r in all_indicators(spark.createDataFrame(rows, BARS)).collect()}
    found = store.read()
    rows_found = found.collect()
    assert len(rows_found) == len(want) == len(rows)
    assert {"OBV", "MACD", "ADX", "TDB", "TRMA", "NMR", "TD4"} < set(found.columns) == set(next(iter(want.values())).asDict())
    for row in rows_found:
        expected = want[row["code"], row["trade_date"]]
        for name in found.columns:
            x, y = row[name], expected[name]
            if isinstance(y, float):
                assert x is not None and (x == pytest.approx(y, rel=1e-6, abs=1e-6, nan_ok=True) or abs(x - y) < 0.0101), (name, row["code"], row["trade_date"], x, y)
            else:
                assert x == y, (name, row["code"], row["trade_date"], x, y)


def test_a_failed_version_is_written_anew(spark, tmp_path, monkeypatch):
    from barline.operators import recursive

    bars = spark.createDataFrame(bars_of(range(40)), BARS)
    store = IndicatorStore(spark, str(tmp_path / "store"))
    assert store.versions() == [] and store.advance(bars.limit(0)) == {"rows": 0, "earlier": 0}
    with monkeypatch.context() as m:
        m.setattr(recursive, "states", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.advance(bars)
    assert store.versions() == []
    assert store.advance(bars)["rows"] == bars.count() == store.read().count()
