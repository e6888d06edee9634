import datetime

from barline.operators.catalog import Catalog
from barline.schema import TABLES
from barline.streaming import ingest

DAY = datetime.date(2024, 1, 1)


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", DAY, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), ("b", DAY, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0)], TABLES["stock_daily"])
    rows.write.parquet(str(tmp_path / "landing"))
    with Catalog(spark, "market_stream") as market:
        market.truncate_all(confirm=True)
        for run in range(2):  # the second run starts without the first one's checkpoint
            stream = spark.readStream.schema(TABLES["stock_daily"]).parquet(str(tmp_path / "landing"))
            ingest.into_catalog(stream, market, "stock_daily", str(tmp_path / f"checkpoint{run}")).awaitTermination()
        assert market.read("stock_daily").count() == 2


def test_live_bars(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    ticks = [("a", start + datetime.timedelta(minutes=m), float(x)) for m, x in ((5, 3), (50, 7), (55, 2), (65, 4), (600, 1))]
    spark.createDataFrame(ticks, "code string, trade_date timestamp, close double").write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema("code string, trade_date timestamp, close double").parquet(str(tmp_path / "ticks"))
    query = ingest.live_bars(stream).writeStream.format("memory").queryName("live").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    rows = spark.table("live").orderBy("trade_date").collect()
    assert [r[2:] for r in rows] == [(3.0, 7.0, 2.0, 2.0, 3.0, 12.0), (4.0, 4.0, 4.0, 4.0, 1.0, 4.0)]


BARS = "code string, trade_date timestamp, high double, low double, close double"


def bars_of(n, codes=("a", "b", "c"), start=datetime.datetime(2024, 1, 1)):
    import random

    rng, rows = random.Random(7), []
    for code in codes:
        price = 20.0
        for i in range(n):
            price = max(1.0, price + rng.uniform(-1, 1))
            rows.append((code, start + datetime.timedelta(minutes=i * 10), price + rng.random(), price - rng.random(), price if i % 17 else None))
    return rows


def batch_of(spark, rows):
    from barline.operators.smoothed import add, expma, kdj, macd

    found = add(spark.createDataFrame(rows, BARS), macd(), kdj(), expma())
    return {(r["code"], r["trade_date"]): r[5:] for r in found.collect()}


def live_of(spark, folder, landing, **more):
    from barline.operators.smoothed import expma, kdj_in_steps, macd
    from barline.streaming.live import live_indicators, to_the_end

    stream = spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(str(landing))
    found = to_the_end(live_indicators(stream, macd(), kdj_in_steps(), expma(), late="1 hour", **more), str(folder), spark)
    rows = found.collect()
    assert len(rows) == len({r[:2] for r in rows})  # each once
    return {(r["code"], r["trade_date"]): r[5:] for r in rows}


def assert_same(got, want):
    import pytest

    for key, row in got.items():
        assert list(row) == pytest.approx(list(want[key]), nan_ok=True) if None not in want[key] else [x is None for x in row] == [x is None for x in want[key]], key


def test_live_indicators_equal_the_batch_after_a_restart_and_with_late_bars(spark, tmp_path):
    import random

    rows = bars_of(120)
    # A bar arrives up to 50 minutes late, that is within the hour; some are kept for after a restart.
    arrived = sorted(rows, key=lambda r: (r[1] + datetime.timedelta(minutes=random.Random(str(r[:2])).uniform(0, 50)), r[0]))
    third = len(arrived) // 3
    for i, part in enumerate((arrived[:third], arrived[third : 2 * third])):
        spark.createDataFrame(part, BARS).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
        got = live_of(spark, tmp_path / "live", tmp_path / "landing")
        newest = max(r[1] for r in arrived[: third * (i + 1)])
        assert set(got) == {r[:2] for r in rows if r[1] <= newest - datetime.timedelta(hours=1)}
    far = [("a", rows[0][1] + datetime.timedelta(days=9), 1.0, 1.0, 1.0), ("a", rows[5][1], 9.0, 9.0, 9.0)]  # the second one is too late
    spark.createDataFrame(arrived[2 * third :], BARS).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
    live_of(spark, tmp_path / "live", tmp_path / "landing")
    spark.createDataFrame(far, BARS).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
    got = live_of(spark, tmp_path / "live", tmp_path / "landing")
    assert set(got) == {r[:2] for r in rows}
    assert_same(got, batch_of(spark, rows))


def test_live_indicators_start_from_stored_bars(spark, tmp_path):
    from barline.operators.recursive import states
    from barline.operators.smoothed import expma, kdj_in_steps, macd

    rows, steps = bars_of(90), {name: step for i in (macd(), kdj_in_steps(), expma()) for name, step in i.steps.items()}
    cut = rows[50][1]
    stored = spark.createDataFrame([r for r in rows if r[1] <= cut], BARS)
    # d has no stored bars, and a bar that is stored comes once more.
    more = [r for r in rows if r[1] > cut] + bars_of(40, ("d",), cut) + [rows[50], ("a", cut + datetime.timedelta(days=1), 1.0, 1.0, 1.0)]
    spark.createDataFrame(more, BARS).coalesce(1).write.parquet(str(tmp_path / "landing"))
    got = live_of(spark, tmp_path / "live", tmp_path / "landing", initial=states(stored, steps))
    assert set(got) == {r[:2] for r in more if r[1] > cut and r[1] < cut + datetime.timedelta(hours=23)} | {("d", cut)}
    assert_same(got, batch_of(spark, rows + bars_of(40, ("d",), cut)))


class Store:
    """Keyed state of one series in memory; counts the calls."""

    def __init__(self):
        self.value, self.map, self.timers, self.calls = None, {}, [], 0

    def getMapState(self, name, *schemas):
        return self

    def getValueState(self, name, schema):
        return self

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def getValue(self, key):
        self.calls += 1
        return self.map[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.map[key]


class Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def one_series(store, portion, batches):
    """Rows (time, bars' closes, EMA) of a series whose batches are (rows, watermark)."""
    from pyspark.sql import Row

    from barline.operators.recursive import EMA
    from barline.streaming import live

    bar, found = Row("code", "trade_date", "close", "__at"), []
    processor = live.Indicators({"e": EMA("close", 3)}, ["close"], 1)
    processor.init(store)
    live.PORTION, before = portion, live.PORTION
    try:
        for rows, watermark in batches:
            assert not list(processor.handleInputRows(("a",), iter([bar("a", None, close, at) for at, close in rows]), None))
            due = [t for t in sorted(set(store.timers)) if t <= watermark]
            store.timers = [t for t in store.timers if t > watermark]
            for _ in due:
                for out in processor.handleExpiredTimer(("a",), Watermark(watermark), None):
                    assert out[0] == "a" and len(out[1]) <= portion
                    found += zip(*out[1:], strict=True)
    finally:
        live.PORTION = before
    return found


def test_live_bars_are_stored_in_portions_with_one_timer_a_series():
    rows = [(1000 * i, float(i % 7)) for i in range(1000)]
    store = Store()
    found = one_series(store, 8192, [(rows, -1)])
    assert not found and len(store.timers) == 1 and store.calls < 10  # before: a timer and three calls a bar
    assert len(one_series(Store(), 8192, [(rows, 10_000)])) == 1000


def test_live_bars_of_many_portions_come_in_order_of_time():
    import random

    from barline.operators.recursive import EMA

    rng = random.Random(5)
    # Times in microseconds, some equal (these stay as they came) and some between milliseconds; one row has no time.
    rows = [(rng.randrange(0, 400) * 500, None if i % 13 == 0 else float(i)) for i in range(900)]
    early, late = [r for r in rows if r[0] <= 100_000], [r for r in rows if r[0] > 100_000]
    for portion in (1, 7, 8192):
        store = Store()
        found = one_series(store, portion, [(late[:100], 0), (early + [(None, 1.0)] + late[100:], 100), ([(100_000, 5.0), (90_000, 5.0)], 149), ([], 150), ([], 1000)])
        want = sorted([*early, *late[:100], *late[100:]], key=lambda r: r[0])
        steps = EMA("close", 3)
        assert [(at, close) for at, close, _ in found] == want
        assert [e for *_, e in found] == steps.run(steps.start(), [[close for _, close in want]])
        assert not store.map and store.value[1] is None


def test_live_bars_after_a_stored_state_are_taken_in_at_once():
    import pickle

    from pyspark.sql import Row

    from barline.operators.recursive import EMA

    rows = [(1000 * i, float(i % 11)) for i in range(600)]
    step, store = EMA("close", 3), Store()
    want = step.run(state := step.start(), [[close for _, close in rows[:300]]]) + step.run(after := list(state), [[close for _, close in rows[300:]]])
    from barline.streaming import live

    processor = live.Indicators({"e": step}, ["close"], 1)
    processor.init(store)
    processor.handleInitialState(("a",), Row("until", "state")(rows[299][0], pickle.dumps({"e": state})), None)
    # The stored bars come once more.
    found = one_series(store, 8192, [(rows, 10_000)])
    assert [(at, e) for at, _, e in found] == [(at, e) for (at, _), e in zip(rows[300:], want[300:], strict=True)]
    assert store.calls < 12 and pickle.loads(store.value[3]) == {"e": after}  # before: six calls a bar
