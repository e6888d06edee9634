"""Recursive series: each row's value needs the one before it, which no window function can give.

with_recursive deals the rows by series, sorts them, and runs every step in one pass over Arrow batches. A step keeps
a few numbers from row to row, so a series needs no more memory than a batch, however long it is. Where a series has more
than LONG_SERIES rows, series are cut into blocks instead (see blocks), and one series is the work of many tasks. Nulls
(absent) and NaN (poisonous) are kept apart.
"""

from __future__ import annotations

import math
import pickle
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.series import Series
from barline.operators import blocks as cut
from barline.operators.blocks import numbers, runs

#: A series of more rows is cut into blocks. Whether there is one is asked only if the plan's size says that there may be one.
LONG_SERIES = 5_000_000
#: Bytes of a row at least, as Spark estimates them.
LEAST_ROW = 16


@dataclass(frozen=True)
class Step:
    """Makes a column from columns of the input or of earlier steps.

    What some rows do to the state, whatever it is before them, is a map: mapped(values) gives it, composed(first, then) joins two,
    and after(state, map) is the state after the rows.
    """

    inputs: tuple[str, ...]
    kind: T.DataType = field(default_factory=T.DoubleType)

    def start(self) -> list:
        """State at the start of a series."""
        return []

    def run(self, state: list, values: list[list]) -> list:
        raise NotImplementedError

    def mapped(self, values: list[list]) -> tuple:
        raise NotImplementedError

    def composed(self, first: tuple, then: tuple) -> tuple:
        raise NotImplementedError

    def after(self, state: list, there: tuple) -> list:
        raise NotImplementedError


@dataclass(frozen=True)
class Ewm(Step):
    """y = a x + (1 - a) y', from the first value that isn't null. Null rows give null and let the old value fade."""

    alpha: float = 1.0

    def start(self) -> list:
        return [None, 1.0]

    def run(self, state: list, values: list[list]) -> list:
        y, weight = state
        alpha, keep, out = self.alpha, 1 - self.alpha, []
        for x in values[0]:
            if y is None:
                y, weight = x, 1.0
                out.append(x)
                continue
            weight *= keep
            if x is None:
                out.append(None)
            else:
                y = keep * y + alpha * x if weight == keep else (weight * y + alpha * x) / (weight + alpha)
                weight = 1.0
                out.append(y)
        state[:] = [y, weight]
        return out

    # A map is (rows before the first value, that value, c, d, weight at the end): y becomes c y + d once it has taken in the first
    # value. Without a value, it is (rows, None, 1, 0, 1), and the weight fades.

    def mapped(self, values: list[list]) -> tuple:
        alpha, keep, xs = self.alpha, 1 - self.alpha, values[0]
        first = next((i for i, x in enumerate(xs) if x is not None), None)
        if first is None:
            return len(xs), None, 1.0, 0.0, 1.0
        c, d, weight = 1.0, 0.0, 1.0
        for x in xs[first + 1 :]:
            weight *= keep
            if x is not None:
                share = weight / (weight + alpha)
                c, d, weight = share * c, share * d + (1 - share) * x, 1.0
        return first, xs[first], c, d, weight

    def composed(self, first: tuple, then: tuple) -> tuple:
        (n, x, c, d, weight), (n2, x2, c2, d2, weight2), keep = first, then, 1 - self.alpha
        if x is None:
            return (n + n2, *then[1:])
        if x2 is None:
            return n, x, c, d, weight * keep**n2
        faded = weight * keep ** (n2 + 1)
        share = faded / (faded + self.alpha)
        return n, x, c2 * share * c, c2 * (share * d + (1 - share) * x2) + d2, weight2

    def after(self, state: list, there: tuple) -> list:
        (y, weight), (n, x, c, d, weight2), keep = state, there, 1 - self.alpha
        if x is None:
            return [y, weight if y is None else weight * keep**n]
        if y is not None:
            faded = weight * keep ** (n + 1)
            share = faded / (faded + self.alpha)
            x = share * y + (1 - share) * x
        return [c * x + d, weight2]


def EMA(x: str, n: int) -> Step:
    return Ewm((x,), alpha=2 / (n + 1))


def SMA(x: str, n: int, m: int = 1) -> Step:
    return Ewm((x,), alpha=m / n)


@dataclass(frozen=True)
class DMA(Step):
    """y = a x + (1 - a) y' with a weight for each row, a column or a number; a null or NaN weight keeps y'. Starts at the first x."""

    weight: float | None = None

    def start(self) -> list:
        return [False, None]

    def run(self, state: list, values: list[list]) -> list:
        begun, y = state
        weights = values[1] if self.weight is None else [self.weight] * len(values[0])
        out = []
        for x, a in zip(values[0], weights, strict=True):
            x = math.nan if x is None else x
            if not begun:
                begun, y = True, x
            elif a is not None and not math.isnan(a):
                y = a * x + (1.0 - a) * y
            out.append(y)
        state[:] = [begun, y]
        return out

    # A map is (first x, its weight or None, c, d): y becomes c y + d once it has taken in the first x.

    def mapped(self, values: list[list]) -> tuple:
        xs = [math.nan if x is None else x for x in values[0]]
        weights = values[1] if self.weight is None else [self.weight] * len(xs)
        weights = [None if a is None or math.isnan(a) else a for a in weights]
        c, d = 1.0, 0.0
        for x, a in zip(xs[1:], weights[1:], strict=True):
            if a is not None:
                c, d = (1.0 - a) * c, (1.0 - a) * d + a * x
        return xs[0], weights[0], c, d

    def composed(self, first: tuple, then: tuple) -> tuple:
        (x, a, c, d), (x2, a2, c2, d2) = first, then
        if a2 is not None:
            c, d = (1.0 - a2) * c, (1.0 - a2) * d + a2 * x2
        return x, a, c2 * c, c2 * d + d2

    def after(self, state: list, there: tuple) -> list:
        (begun, y), (x, a, c, d) = state, there
        if begun:
            x = y if a is None else a * x + (1.0 - a) * y
        return [True, c * x + d]


@dataclass(frozen=True)
class Filter(Step):
    """True where the condition holds and no true came out on the n rows before."""

    kind: T.DataType = field(default_factory=T.BooleanType)
    n: int = 1

    def start(self) -> list:
        return [0]

    def run(self, state: list, values: list[list]) -> list:
        (quiet,), out = state, []
        for x in values[0]:
            fires = bool(x) and quiet == 0
            quiet = self.n if fires else max(0, quiet - 1)
            out.append(fires)
        state[:] = [quiet]
        return out

    # A map is a table: rows still quiet at the end, by rows still quiet at the start (0 to n).

    def mapped(self, values: list[list]) -> tuple:
        rows = len(values[0])
        ends = [0] * (rows + 1)  # by the row from which on nothing is quiet
        for i in range(rows - 1, -1, -1):
            again = i + self.n + 1
            ends[i] = ends[i + 1] if not values[0][i] else ends[again] if again <= rows else again - rows
        return tuple(ends[quiet] if quiet <= rows else quiet - rows for quiet in range(self.n + 1))

    def composed(self, first: tuple, then: tuple) -> tuple:
        return tuple(then[quiet] for quiet in first)

    def after(self, state: list, there: tuple) -> list:
        return [there[state[0]]]


@dataclass(frozen=True)
class Range(Step):
    """Rows directly before that lie below (or, with lowest, above) the current value: a stack of the values that can stop a count."""

    kind: T.DataType = field(default_factory=T.IntegerType)
    lowest: bool = False

    def start(self) -> list:
        return [0, []]

    def run(self, state: list, values: list[list]) -> list:
        at, stack = state
        out = []
        for x in values[0]:
            x = math.nan if x is None else -x if self.lowest else x
            if math.isnan(x):  # compares as false with everything
                out.append(at)
            else:
                while stack and stack[-1][0] < x:
                    stack.pop()
                out.append(at - stack[-1][1] - 1 if stack else at)
                stack.append((x, at))
            at += 1
        state[:] = [at, stack]
        return out


@dataclass(frozen=True)
class Linear(Step):
    """The sum of the inputs times their factors; null if an input is."""

    factors: tuple[float, ...] = ()

    def run(self, state: list, values: list[list]) -> list:
        return [None if any(x is None for x in row) else sum(f * x for f, x in zip(self.factors, row, strict=True)) for row in zip(*values, strict=True)]


@dataclass(frozen=True)
class Total(Step):
    """The sum of all values so far; null where the value is (unless null is told to count as nothing)."""

    through_null: bool = False

    def start(self) -> list:
        return [None]

    def run(self, state: list, values: list[list]) -> list:
        (total,), out = state, []
        for x in values[0]:
            if x is not None:
                total = x if total is None else total + x
            out.append(total if x is not None or self.through_null else None)
        state[:] = [total]
        return out

    # A map is the sum of the rows' values, None without any.

    def mapped(self, values: list[list]) -> tuple:
        there = [x for x in values[0] if x is not None]
        return (sum(there[1:], there[0]) if there else None,)

    def composed(self, first: tuple, then: tuple) -> tuple:
        return (*self.after(list(first), then),)

    def after(self, state: list, there: tuple) -> list:
        return [there[0] if state[0] is None else state[0] if there[0] is None else state[0] + there[0]]


@dataclass(frozen=True)
class Latest(Step):
    """The last value so far that isn't null."""

    def start(self) -> list:
        return [None]

    def run(self, state: list, values: list[list]) -> list:
        (last,), out = state, []
        for x in values[0]:
            last = last if x is None else x
            out.append(last)
        state[:] = [last]
        return out

    # A map is the last value of the rows, None without any.

    def mapped(self, values: list[list]) -> tuple:
        return (next((x for x in reversed(values[0]) if x is not None), None),)

    def composed(self, first: tuple, then: tuple) -> tuple:
        return first if then[0] is None else then

    def after(self, state: list, there: tuple) -> list:
        return list(self.composed((state[0],), there))


@dataclass(frozen=True)
class Since(Step):
    """Rows since the condition last held; null if it never did."""

    kind: T.DataType = field(default_factory=T.IntegerType)

    def start(self) -> list:
        return [None]

    def run(self, state: list, values: list[list]) -> list:
        (n,), out = state, []
        for x in values[0]:
            n = 0 if x else None if n is None else n + 1
            out.append(n)
        state[:] = [n]
        return out

    # A map is (rows, rows since it last held among them or None).

    def mapped(self, values: list[list]) -> tuple:
        rows = len(values[0])
        return rows, next((k for k, x in enumerate(reversed(values[0])) if x), None)

    def composed(self, first: tuple, then: tuple) -> tuple:
        return first[0] + then[0], self.after([first[1]], then)[0]

    def after(self, state: list, there: tuple) -> list:
        rows, n = there
        return [n if n is not None else None if state[0] is None else state[0] + rows]


@dataclass(frozen=True)
class Extreme(Step):
    """The highest (or lowest) of the last n values; null until there are n rows, all with a value. The state is those values."""

    n: int = 1
    lowest: bool = False

    def start(self) -> list:
        return [()]

    def run(self, state: list, values: list[list]) -> list:
        kept, out, best = list(state[0]), [], min if self.lowest else max
        for x in values[0]:
            kept.append(x)
            del kept[: -self.n]
            full = len(kept) == self.n and all(v is not None for v in kept)
            # As Spark orders them: NaN is above all numbers.
            numbers = [v for v in kept if v == v] if full else []
            out.append(None if not full else math.nan if not numbers or (len(numbers) < self.n and not self.lowest) else best(numbers))
        state[:] = [tuple(kept)]
        return out

    # A map is the last n values.

    def mapped(self, values: list[list]) -> tuple:
        return tuple(values[0][-self.n :])

    def composed(self, first: tuple, then: tuple) -> tuple:
        return (first + then)[-self.n :]

    def after(self, state: list, there: tuple) -> list:
        return [(tuple(state[0]) + there)[-self.n :]]


class Ranked:
    """A multiset of known values: how many are at most x, and their sum, in logarithmic time (two Fenwick trees over ranks)."""

    def __init__(self, values: list[float]):
        self.values = sorted(set(values))
        self.counts, self.sums = [0] * (len(self.values) + 1), [0.0] * (len(self.values) + 1)

    def add(self, value: float, times: int) -> None:
        """times: 1 to put a value in, -1 to take it out."""
        at, n = bisect_right(self.values, value), len(self.values)
        while at <= n:
            self.counts[at] += times
            self.sums[at] += times * value
            at += at & -at

    def through(self, x: float) -> tuple[int, float]:
        at, count, total = bisect_right(self.values, x), 0, 0.0
        while at:
            count, total = count + self.counts[at], total + self.sums[at]
            at -= at & -at
        return count, total


@dataclass(frozen=True)
class AbsDev(Step):
    """Mean absolute deviation of the last n values from their mean; null until there are n rows, all with a value. The state is those values.

    A row takes time in proportion to log n (and the length of a batch), whatever n is: a Fenwick tree has the window's values by rank.
    """

    n: int = 1

    def start(self) -> list:
        return [()]

    def run(self, state: list, values: list[list]) -> list:
        kept, xs = deque(state[0]), values[0]
        numbers = [x for x in (*kept, *xs) if x is not None and math.isfinite(x)]
        ranked = Ranked(numbers)
        bad = sum(x is None for x in kept)
        odd = sum(x is not None and not math.isfinite(x) for x in kept)
        for x in kept:
            if x is not None and math.isfinite(x):
                ranked.add(x, 1)
        out = []
        for x in xs:
            for value, times in ((x, 1), *(((kept.popleft(), -1),) if len(kept) == self.n else ())):
                if value is None:
                    bad += times
                elif not math.isfinite(value):
                    odd += times
                else:
                    ranked.add(value, times)
            kept.append(x)
            if len(kept) < self.n or bad:
                out.append(None)
            elif odd:
                out.append(math.nan)
            else:
                total = ranked.through(math.inf)[1]
                mean = total / self.n
                count, below = ranked.through(mean)
                out.append(max(0.0, (mean * count - below) + (total - below) - mean * (self.n - count)) / self.n)
        state[:] = [tuple(kept)]
        return out

    # A map is the last n values.

    def mapped(self, values: list[list]) -> tuple:
        return tuple(values[0][-self.n :])

    def composed(self, first: tuple, then: tuple) -> tuple:
        return (first + then)[-self.n :]

    def after(self, state: list, there: tuple) -> list:
        return [(tuple(state[0]) + there)[-self.n :]]


@dataclass(frozen=True)
class Weighted(Step):
    """The weighted sum of the n rows before, newest first; a missing value counts as 0, and so does the sum where there are fewer than n rows so far.

    A convolution by overlap-save: blocks of rows after the n kept ones, by Fourier transforms where that is quicker. The state is the
    last n values and the number of rows.
    """

    weights: tuple[float, ...] = ()

    def start(self) -> list:
        return [(), 0]

    def run(self, state: list, values: list[list]) -> list:
        n, (kept, rows) = len(self.weights), state
        xs = np.array([0.0 if x is None else x for x in values[0]], np.float64)
        # The row itself takes no part, so its first row has n values before it at most.
        before = np.concatenate([np.zeros(n - len(kept)), kept, xs])
        sums = self._convolved(before[:-1]) if len(xs) else np.zeros(0)
        sums[: max(0, n - 1 - rows)] = 0.0
        state[:] = [tuple(before[-n:][-min(n, rows + len(xs)) :].tolist()) if rows + len(xs) else (), rows + len(xs)]
        return sums.tolist()

    def _convolved(self, x: np.ndarray) -> np.ndarray:
        """Sums over the n values that end at each place that has as many."""
        n = len(self.weights)
        if n * len(x) < 1 << 16 or not np.isfinite(x).all():
            return np.convolve(x, self.weights, "valid")
        size = 1 << (4 * n).bit_length()
        spectrum, step, out = np.fft.rfft(self.weights, size), size - n + 1, []
        for start in range(0, len(x) - n + 1, step):
            part = x[start : start + size]
            out.append(np.fft.irfft(np.fft.rfft(part, size) * spectrum, size)[n - 1 : len(part)])
        return np.concatenate(out)

    # A map is the last n values and the number of rows.

    def mapped(self, values: list[list]) -> tuple:
        return tuple(0.0 if x is None else float(x) for x in values[0][-len(self.weights) :]), len(values[0])

    def composed(self, first: tuple, then: tuple) -> tuple:
        return tuple((first[0] + then[0])[-len(self.weights) :]), first[1] + then[1]

    def after(self, state: list, there: tuple) -> list:
        return list(self.composed(tuple(state), there))


@dataclass(frozen=True)
class Place(Step):
    """Where the first input lies between the second and the third, in hundredths, by IEEE division; null if an input is."""

    def run(self, state: list, values: list[list]) -> list:
        out = []
        for x, low, high in zip(*values, strict=True):
            if x is None or low is None or high is None:
                out.append(None)
            elif high != low:
                out.append((x - low) / (high - low) * 100)
            else:
                out.append(math.copysign(math.inf, x - low) if x - low else math.nan)
        return out


def _is_long(df: DataFrame, keys: tuple[str, ...]) -> bool:
    """Whether a series has more than LONG_SERIES rows; counted only if Spark's estimate of df's size leaves room for that."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size > LONG_SERIES * LEAST_ROW and not df.groupBy(*keys).count().where(F.col("count") > LONG_SERIES).isEmpty()


def with_recursive(df: DataFrame, steps: dict[str, Step], series: Series | None = None, blocks: int | None = None) -> DataFrame:
    """df with a column for each step, made in order; a later step may take an earlier one's.

    Rows of one series with equal order are taken as they come. Series go to tasks whole, in one shuffle and one sort, unless there is a
    very long one, or blocks is given: then they are cut into as many blocks (or as many as there are shuffle partitions), and the result
    is the same but for rounding. Whole rows pass through Python, as Arrow columns that it doesn't touch: joining results back by key and
    order would shuffle the rows once more, and keys and order need not be unique.
    """
    series = series or Series()
    if blocks is None and not _is_long(df, series.keys):
        return _streamed(df, steps, series)
    searched = {name: step for name, step in steps.items() if isinstance(step, Range)}
    if not searched:
        return _scanned(df, steps, series, blocks)
    # What stands on a range comes after it, what a range stands on before it.
    later: set[str] = set()
    for name, step in steps.items():
        if name not in searched and later.union(searched).intersection(step.inputs):
            later.add(name)
    sooner = {name: step for name, step in steps.items() if name not in searched and name not in later}
    made = _scanned(df, sooner, series, blocks) if sooner else df
    made = cut.ranges(made, {name: (step.inputs[0], step.lowest) for name, step in searched.items()}, series.keys, series.order, blocks)
    made = with_recursive(made, {name: steps[name] for name in steps if name in later}, series, blocks) if later else made
    return made.select(*df.columns, *steps)


def _made(df: DataFrame, steps: dict[str, Step]) -> tuple[T.StructType, dict[str, pa.DataType]]:
    """Schema of df with the steps' columns, and the Arrow types of these."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, step.kind) for name, step in steps.items())])
    return schema, {name: {"double": pa.float64(), "boolean": pa.bool_(), "integer": pa.int32()}[step.kind.typeName()] for name, step in steps.items()}


def _scanned(df: DataFrame, steps: dict[str, Step], series: Series, blocks: int | None) -> DataFrame:
    return cut.scan(df, steps, *_made(df, steps), series.keys, series.order, blocks)


def _streamed(df: DataFrame, steps: dict[str, Step], series: Series) -> DataFrame:
    schema, types = _made(df, steps)
    place = {name: i for i, name in enumerate(df.columns)}
    given = {x for step in steps.values() for x in step.inputs if x in place}
    keys = [place[key] for key in series.keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, states = object(), {}
        for batch in batches:
            ids = list(zip(*(batch.column(i).to_pylist() for i in keys), strict=True))
            columns = {name: numbers(batch.column(place[name])) for name in given}
            made: dict[str, list] = {name: [] for name in steps}
            for start, stop in runs(ids):
                if ids[start] != now:
                    now, states = ids[start], {name: step.start() for name, step in steps.items()}
                for name, step in steps.items():
                    values = [made[x][start:stop] if x in made else columns[x][start:stop] for x in step.inputs]
                    made[name] += step.run(states[name], values)
            arrays = [*batch.columns, *(pa.array(made[name], types[name], from_pandas=False) for name in steps)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.repartition(*series.keys).sortWithinPartitions(*series.keys, series.order).mapInArrow(run, schema)


def states(df: DataFrame, steps: dict[str, Step], series: Series | None = None, since: DataFrame | None = None) -> DataFrame:
    """A row for each series: its keys, `until` (the order of its last row) and `state`, the steps' state after that row.

    since: such rows of what came before df. A series is passed on as it is where df has none of it.
    """
    series = series or Series()
    fields = {f.name: f for f in df.schema.fields}
    schema = T.StructType([*(fields[key] for key in series.keys), T.StructField("until", fields[series.order].dataType), T.StructField("state", T.BinaryType())])
    return _continued(df, steps, series, since, schema, rows=False)


def with_recursive_since(df: DataFrame, steps: dict[str, Step], since: DataFrame, series: Series | None = None) -> DataFrame:
    """with_recursive for rows that come after those of which `since` has the states."""
    return _continued(df, steps, series or Series(), since, _made(df, steps)[0], rows=True)


def _continued(df: DataFrame, steps: dict[str, Step], series: Series, since: DataFrame | None, schema: T.StructType, rows: bool) -> DataFrame:
    """One pass over the series, each after its earlier state: the rows, or the states at the end."""
    types, names = _made(df, steps)[1], df.columns
    place = {name: i + 2 for i, name in enumerate(names)}
    given = {x for step in steps.values() for x in step.inputs if x in names}
    keys = [place[key] for key in series.keys]
    # An earlier state is a row that comes before all rows of its series.
    both = df.select(F.lit(1).alias("__rank"), F.lit(None).cast("binary").alias("__state"), *[F.col(name) for name in names])
    if since is not None:
        earlier = [F.col("until").alias(name) if name == series.order else F.col(name) if name in series.keys else F.lit(None).cast(df.schema[name].dataType).alias(name) for name in names]
        both = since.select(F.lit(0).alias("__rank"), F.col("state").alias("__state"), *earlier).unionByName(both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, last = None, {}, None

        def ended(key: tuple, until: object) -> pa.RecordBatch:
            values = [*key, until, pickle.dumps(held)]
            arrays = [pa.array([value], kind) for value, kind in zip(values, [*(batch.schema.field(i).type for i in keys), batch.schema.field(place[series.order]).type, pa.binary()], strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            ids = list(zip(*(batch.column(i).to_pylist() for i in keys), batch.column(0).to_pylist(), strict=True))
            order = batch.column(place[series.order])
            columns = {name: numbers(batch.column(place[name])) for name in given}
            made: dict[str, list] = {name: [] for name in steps}
            kept = np.array([rank == 1 for *_, rank in ids], bool)
            for start, stop in runs(ids):
                *key, rank = ids[start]
                if tuple(key) != now:
                    if now is not None and not rows:
                        yield ended(now, last)
                    now, held = tuple(key), {name: step.start() for name, step in steps.items()}
                last = order[stop - 1]
                if rank == 0:
                    held = pickle.loads(batch.column(1)[start].as_py())
                    continue
                out: dict[str, list] = {}
                for name, step in steps.items():
                    out[name] = step.run(held[name], [out[x] if x in out else columns[x][start:stop] for x in step.inputs])
                    made[name] += out[name]
            if rows:
                arrays = [column.filter(pa.array(kept)) for column in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(made[name], types[name], from_pandas=False) for name in steps)], names=schema.names)
        if now is not None and not rows:
            yield ended(now, last)

    return both.repartition(*series.keys).sortWithinPartitions(*series.keys, "__rank", series.order).mapInArrow(run, schema)


def ranges(df: DataFrame, x: str, top: str = "TOPRANGE", low: str = "LOWRANGE", series: Series | None = None, blocks: int | None = None) -> DataFrame:
    """df with the numbers of rows directly before that lie below and above the current value of x; linear in a series."""
    return with_recursive(df, {top: Range((x,)), low: Range((x,), lowest=True)}, series, blocks)
