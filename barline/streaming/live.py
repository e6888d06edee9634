"""Recursive indicators of bars as they arrive.

A bar waits until no earlier one is awaited any more, that is until the watermark has passed it; then it and those before it are taken
in by time, as in a batch. Each series keeps its waiting bars, the state of the recursive steps and the time up to which it has got. All
of that is keyed state, so a stream goes on where it stopped; a timer of its earliest waiting bar wakes a series.

A stream can start from stored bars: `initial` has the states after them (recursive.states).
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barline.functions.series import Series
from barline.operators.recursive import Step
from barline.operators.smoothed import Smoothed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The time of a bar in microseconds, for a while.
_AT = "__at"
#: Bars of a series that are stored, or given out, at a time.
PORTION = 8192


class Indicators(StatefulProcessor):
    """Bars of one series in; bars with the steps' columns out, in order of time and each once.

    A row that goes out has the columns of up to PORTION bars as arrays. Each call of the state store and each row of Spark's costs more than
    a bar does, so waiting bars are stored in portions, as they come, and a series has one timer, of its earliest waiting bar: when it
    wakes, all bars that the watermark has passed are taken in. These bars of a series are in memory at once.
    """

    def __init__(self, steps: dict[str, Step], names: list[str], keys: int):
        """names: the columns besides the keys and the time."""
        self.steps, self.names, self.out = steps, names, Row(*(f"_{i}" for i in range(keys + 1 + len(names) + len(steps))))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Portions of waiting bars by number: times and columns.
        self.waiting = handle.getMapState("waiting", "number long", "bars binary")
        # Up to when bars have been given, the time of the earliest that waits, the number of portions, and the state of the steps.
        self.reached = handle.getValueState("reached", "until long, earliest long, portions long, state binary")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: object) -> None:
        self.reached.update((initialState["until"], None, 0, bytes(initialState["state"])))

    def _store(self, number: int, ats: list[int], bars: list[tuple]) -> None:
        self.waiting.updateValue((number,), (pickle.dumps((ats, list(zip(*bars, strict=True)))),))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        until, earliest, portions, state = self.reached.get() or (None, None, 0, None)
        first, ats, bars, places = None, [], [], None
        for row in rows:
            if places is None:  # a row's own look-up by name is slow
                when, *places = (row.__fields__.index(name) for name in (_AT, *self.names))
            at = row[when]
            # A bar that isn't later than those given can't be taken in any more; one without a time never can.
            if at is None or until is not None and at <= until:
                continue
            first = at if first is None or at < first else first
            ats.append(at)
            bars.append(tuple([row[i] for i in places]))
            if len(ats) == PORTION:
                self._store(portions, ats, bars)
                portions, ats, bars = portions + 1, [], []
        if ats:
            self._store(portions, ats, bars)
            portions += 1
        if first is not None:
            if earliest is None or first < earliest:
                earliest = first
                self.handle.registerTimer(-(-first // 1000))
            self.reached.update((until, earliest, portions, state))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        until, earliest, portions, state = self.reached.get() or (None, None, 0, None)
        if earliest is None or earliest > passed:  # the timer of a bar that an earlier one has overtaken
            return
        ats: list[int] = []
        columns: list[list] = [[] for _ in self.names]
        for number in range(portions):
            some, values = pickle.loads(bytes(self.waiting.getValue((number,))[0]))
            self.waiting.removeKey((number,))
            ats += some
            for column, more in zip(columns, values, strict=True):
                column += more
        order = sorted(range(len(ats)), key=ats.__getitem__)
        n = bisect_right(order, passed, key=ats.__getitem__)
        states = {name: step.start() for name, step in self.steps.items()} if state is None else pickle.loads(bytes(state))
        for start in range(0, n, PORTION):
            some = order[start : min(start + PORTION, n)]
            given = {name: [column[i] for i in some] for name, column in zip(self.names, columns, strict=True)}
            made: dict[str, list] = {}
            for name, step in self.steps.items():
                made[name] = step.run(states[name], [made[x] if x in made else given[x] for x in step.inputs])
            yield self.out(*key, [ats[i] for i in some], *given.values(), *made.values())
        later, portions = order[n:], 0
        for start in range(0, len(later), PORTION):
            some = later[start : start + PORTION]
            self._store(portions, [ats[i] for i in some], [tuple(column[i] for column in columns) for i in some])
            portions += 1
        earliest = ats[later[0]] if later else None
        if later:
            self.handle.registerTimer(-(-earliest // 1000))
        self.reached.update((ats[order[n - 1]], earliest, portions, pickle.dumps(states)))

    def close(self) -> None:
        pass


def live_indicators(bars: DataFrame, *indicators: Smoothed, late: str = "2 hours", initial: DataFrame | None = None, s: Series | None = None) -> DataFrame:
    """The bars of a stream with the finished columns of the indicators, each given once no bar at most `late` behind the newest is awaited.

    The indicators are made of steps alone (no columns made ready by windows). Bars that come later still, or not after the time up to
    which their series has got, are left out. Bars of one series and time are taken as they come. initial: states after earlier bars, as
    recursive.states gives them for the same steps.
    """
    s = s or Series()
    if any(i.ready for i in indicators):
        raise ValueError("a stream has no windows of rows: use indicators that are made of steps alone")
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    steps = {name: step for i in indicators for name, step in i.steps.items()}
    kinds = {f.name: f.dataType for f in bars.schema.fields}
    names = [name for name in bars.columns if name not in s.keys and name != s.order]
    arrays = [T.LongType(), *(kinds[name] for name in names), *(step.kind for step in steps.values())]
    schema = T.StructType([T.StructField(f"_{i}", kind) for i, kind in enumerate([*(kinds[k] for k in s.keys), *map(T.ArrayType, arrays)])])
    grouped = bars.withWatermark(s.order, late).withColumn(_AT, F.unix_micros(F.col(s.order).cast("timestamp"))).groupBy(*s.keys)
    begun = None
    if initial is not None:
        begun = initial.select(*s.keys, F.unix_micros(F.col("until").cast("timestamp")).alias("until"), "state").groupBy(*s.keys)
    found = grouped.transformWithState(Indicators(steps, names, len(s.keys)), schema, "append", "eventTime", initialState=begun)
    keys, zipped = schema.names[: len(s.keys)], schema.names[len(s.keys) :]
    rows = found.select(*keys, F.inline(F.arrays_zip(*zipped)))
    at = F.timestamp_micros(zipped[0]).cast(kinds[s.order]).alias(s.order)
    rows = rows.select(*[F.col(c).alias(name) for c, name in zip(keys, s.keys, strict=True)], at, *[F.col(c).alias(name) for c, name in zip(zipped[1:], [*names, *steps], strict=True)])
    return rows.select(*bars.columns, *[c.alias(name) for i in indicators for name, c in i.done.items()])


def to_the_end(stream: DataFrame, folder: str, spark: SparkSession) -> DataFrame:
    """Runs a stream over all that there is now, appending to a Parquet table in a shared folder, and reads the table. Run again, it goes on."""
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
