"""Ordered work along series that are too long for one task.

Rows are dealt by ranges of (keys, order), so a long series is many blocks, each a partition, and a short one lies within a block.

scan() runs recursive steps. What a step does to its state along some rows is a map of states (an affine map for EMA, SMA and DMA, a table
of states for FILTER), and maps are composed. A first pass gives the map of the last series of each block; from these follow the states
in which blocks are entered, one for each partition; a last pass fills the rows in. Steps that build on steps take one more pass for
each storey.

windowed() works out windows of rows: a block gets the rows before and after it that its frames reach into, and is then a series of its
own.

nearest() finds, for each row, the row before it that isn't below (or above) it. Most are found within the block. The others are the
block's records; for each of these a tree of the blocks' extremes gives the one block where the search ends, and only that block's own
records from its end are asked.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.durable import durable
from barline.functions.series import Series

#: Columns that blocks add for a while.
BLOCK, PLACE = "__block", "__place"
#: Records that ask one copy of a block.
ASKED_AT_ONCE = 100_000


def in_blocks(df: DataFrame, keys: tuple[str, ...], order: str, blocks: int | None = None) -> DataFrame:
    """df, dealt and sorted by (keys, order), with each row's block and its place there. Rows of equal keys and order share a block."""
    dealt = df.repartitionByRange(blocks, *keys, order) if blocks else df.repartitionByRange(*keys, order)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return durable(dealt.sortWithinPartitions(*keys, order).withColumns({BLOCK: F.spark_partition_id(), PLACE: place}))


def numbers(column: pa.Array) -> list:
    """Python values, with floats for decimals."""
    return (column.cast(pa.float64()) if pa.types.is_decimal(column.type) else column).to_pylist()


def runs(ids: list) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal ids."""
    start = 0
    while start < len(ids):
        stop = start
        while stop < len(ids) and ids[stop] == ids[start]:
            stop += 1
        yield start, stop
        start = stop


def storeys(steps: dict[str, Any]) -> dict[str, int]:
    """Of each step, how many steps with a state it stands on, itself included."""
    found: dict[str, int] = {}
    for name, step in steps.items():
        found[name] = max((found.get(x, 0) for x in step.inputs), default=0) + bool(step.start())
    return found


def scan(df: DataFrame, steps: dict[str, Any], schema: T.StructType, types: dict[str, pa.DataType], keys: tuple[str, ...], order: str, blocks: int | None = None) -> DataFrame:
    """df with a column for each step (see recursive.Step), as schema has it, whatever number of rows a series has."""
    base = in_blocks(df, keys, order, blocks)
    context = df.sparkSession.sparkContext
    place = {name: i for i, name in enumerate(base.columns)}
    at_keys, height = [place[key] for key in keys], storeys(steps)
    given = {x for step in steps.values() for x in step.inputs if x not in steps}

    def walk(batches: Iterator[pa.RecordBatch], entered: dict, wanted: list[str], see: Callable) -> Iterator[tuple[pa.RecordBatch, dict]]:
        """Each batch with the columns of the wanted steps; see(block, key, values) is called for each run of rows."""
        now, states = None, {}
        for batch in batches:
            ids = list(zip(batch.column(place[BLOCK]).to_pylist(), *(batch.column(i).to_pylist() for i in at_keys), strict=True))
            columns = {name: numbers(batch.column(place[name])) for name in given}
            made: dict[str, list] = {name: [] for name in wanted}
            for start, stop in runs(ids):
                block, *key = here = ids[start]
                if here != now:
                    carried = entered.get(block, {}) if now is None or now[0] != block else {}
                    now, states = here, {name: list(carried.get(name, steps[name].start())) for name in wanted}
                values = {}
                for name in wanted:
                    made[name] += steps[name].run(states[name], [made[x][start:stop] if x in made else columns[x][start:stop] for x in steps[name].inputs])
                    values[name] = made[name][start:stop]
                see(block, key, values | {name: column[start:stop] for name, column in columns.items()})
            yield batch, made

    def entries(entered: dict, level: int) -> dict:
        """States of the steps of a storey on entering each block, besides those of lower ones."""
        wanted = [name for name in steps if height[name] < level]
        mapped = [name for name in steps if height[name] == level and steps[name].start()]
        shared = context.broadcast(entered)

        def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, list] = {}  # block: first and last key, and the maps of the last key's rows

            def see(block: int, key: list, values: dict) -> None:
                one = found.setdefault(block, [key, key, {}])
                if one[1] != key:
                    one[1], one[2] = key, {}
                for name in mapped:
                    here = steps[name].mapped([values[x] for x in steps[name].inputs])
                    one[2][name] = steps[name].composed(one[2][name], here) if name in one[2] else here

            for _ in walk(batches, shared.value, wanted, see):
                pass
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([pickle.dumps(x) for x in found.values()], pa.binary())], names=["block", "found"])

        # A row a partition, with a few numbers for each step.
        rows = sorted((row["block"], pickle.loads(row["found"])) for row in base.mapInArrow(summaries, "block int, found binary").collect())
        before, states = None, {}
        for block, (first, last, maps) in rows:
            goes_on = before == first
            if goes_on:
                entered.setdefault(block, {}).update(states)
            starts = states if goes_on and first == last else {name: steps[name].start() for name in mapped}
            before, states = last, {name: steps[name].after(list(starts[name]), maps[name]) for name in mapped}
        return entered

    entered: dict[int, dict] = {}
    for level in range(1, max(height.values(), default=0) + 1):
        entered = entries(entered, level)
    shared = context.broadcast(entered)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, made in walk(batches, shared.value, list(steps), lambda *_: None):
            arrays = [batch.column(i) for i in range(batch.num_columns) if i not in (place[BLOCK], place[PLACE])]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(made[name], types[name], from_pandas=False) for name in steps)], names=schema.names)

    return base.mapInArrow(fill, schema)


class Extremes:
    """The largest values of the blocks of one series, in order, as a tree."""

    def __init__(self, largest: list[float]):
        self.levels = [np.array(largest, np.float64)]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.fmax.reduceat(below, np.arange(0, len(below), 2)))

    def last_at_least(self, x: float, before: int) -> int:
        """The last block before one whose largest value is x or more; -1 if there is none."""
        level, at = 0, before
        while level < len(self.levels):
            if at % 2 and self.levels[level][at - 1] >= x:
                at -= 1
                while level:
                    level -= 1
                    at *= 2
                    if at + 1 < len(self.levels[level]) and self.levels[level][at + 1] >= x:
                        at += 1
                return at
            level, at = level + 1, at // 2
        return -1


def nearest(base: DataFrame, x: str, into: str, keys: tuple[str, ...], lowest: bool = False) -> DataFrame:
    """base (of in_blocks) with the number of rows directly before each that lie below
    it (or, with lowest, above it), as a column `into`. A null or NaN compares as false with everything."""
    spark, place = base.sparkSession, {name: i for i, name in enumerate(base.columns)}
    at_keys = [place[key] for key in keys]

    def values(batch: pa.RecordBatch) -> np.ndarray:
        column = batch.column(place[x])
        found = (column.cast(pa.float64()) if pa.types.is_decimal(column.type) else column).to_numpy(zero_copy_only=False).astype(np.float64)
        return -found if lowest else found

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block: first and last key, rows of the last key, and their largest value."""
        found: dict[int, list] = {}
        for batch in batches:
            ids = list(zip(batch.column(place[BLOCK]).to_pylist(), *(batch.column(i).to_pylist() for i in at_keys), strict=True))
            x_now = values(batch)
            for start, stop in runs(ids):
                block, *key = ids[start]
                one = found.setdefault(block, [key, key, 0, np.nan])
                if one[1] != key:
                    one[1:] = [key, 0, np.nan]
                one[2] += stop - start
                one[3] = float(np.fmax.reduce(x_now[start:stop], initial=one[3]))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([pickle.dumps(x) for x in found.values()], pa.binary())], names=["block", "found"])

    # A row a partition. For each block: rows of its first series in earlier blocks, and the position among that series' blocks.
    rows = sorted((row["block"], pickle.loads(row["found"])) for row in base.mapInArrow(summaries, "block int, found binary").collect())
    chains: list[tuple[list[int], list[int], list[float]]] = []  # blocks of a series, rows before each, largest values
    entered: dict[int, tuple[int, int]] = {}
    before = None
    for block, (first, last, n, largest) in rows:
        if before == first:
            chain = chains[-1]
            entered[block] = (len(chains) - 1, len(chain[0]))
        if before != last or first != last:
            chains.append(([], [0], []))
        chain = chains[-1]
        chain[0].append(block)
        chain[1].append(chain[1][-1] + n)
        chain[2].append(largest)
        before = last
    shared = spark.sparkContext.broadcast(([(blocks, ends, Extremes(largest)) for blocks, ends, largest in chains], entered))
    schema = T.StructType([*base.schema.fields, T.StructField(into, T.IntegerType()), T.StructField("__asked", T.IntegerType()), T.StructField("__x", T.DoubleType()), T.StructField("__rows", T.LongType())])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose search ends in their own block, or nowhere, get their number. Others get the block to ask, and the rows from that
        block's end up to them."""
        chains, entered = shared.value
        now, at, stack, entry = None, 0, [], None
        for batch in batches:
            ids = list(zip(batch.column(place[BLOCK]).to_pylist(), *(batch.column(i).to_pylist() for i in at_keys), strict=True))
            x_now, found, asked, between = values(batch).tolist(), [], [], []
            for i, v in enumerate(x_now):
                if ids[i] != now:
                    entry = entered.get(ids[i][0]) if now is None or now[0] != ids[i][0] else None
                    now, at, stack = ids[i], 0, []
                chain = chains[entry[0]] if entry else None
                earlier = chain[1][entry[1]] if entry else 0
                number, ask, rows_between = None, None, None
                if v != v:
                    number = earlier + at
                else:
                    while stack and stack[-1][0] < v:
                        stack.pop()
                    if stack:
                        number = at - stack[-1][1] - 1
                    else:
                        where = chain[2].last_at_least(v, entry[1]) if entry else -1
                        if where < 0:
                            number = earlier + at
                        else:
                            ask, rows_between = chain[0][where], earlier + at - chain[1][where + 1]
                    stack.append((v, at))
                at += 1
                found.append(number)
                asked.append(ask)
                between.append(rows_between)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32()), pa.array(asked, pa.int32()), pa.array(x_now, pa.float64()), pa.array(between, pa.int64())], names=schema.names)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the last series of a block, the rows that no later one reaches: (block, rows after it, value)."""
        now, at, stack = None, 0, []

        def out() -> pa.RecordBatch:
            columns = [pa.array([now[0]] * len(stack), pa.int32()), pa.array([at - place - 1 for _, place in stack], pa.int64()), pa.array([v for v, _ in stack], pa.float64())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "after", "x"])

        for batch in batches:
            ids = list(zip(batch.column(place[BLOCK]).to_pylist(), *(batch.column(i).to_pylist() for i in at_keys), strict=True))
            for here, v in zip(ids, values(batch).tolist(), strict=True):
                if here != now:
                    if now is not None and now[0] != here[0]:
                        yield out()
                    now, at, stack = here, 0, []
                if v == v:
                    while stack and stack[-1][0] <= v:
                        stack.pop()
                    stack.append((v, at))
                at += 1
        if now is not None:
            yield out()

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (block, copy, asks, after, x, from_block, place) come sorted by the first three and after: a block's records from its end, then those that ask."""
        now, after, highest = None, [], []
        for batch in batches:
            columns = [column.to_pylist() for column in batch.columns]
            found: list[tuple] = []
            for block, copy, asks, rows_after, v, from_block, row in zip(*columns, strict=True):
                if (block, copy) != now:
                    now, after, highest = (block, copy), [], []
                if not asks:  # from the end on, each record is higher than those after it
                    after.append(rows_after)
                    highest.append(v)
                else:
                    found.append((from_block, row, after[int(np.searchsorted(highest, v))] + rows_after))
            names = [BLOCK, PLACE, "__found"]
            parts = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(parts[0], pa.int32()), pa.array(parts[1], pa.int64()), pa.array(parts[2], pa.int32())], names=names)

    made = base.mapInArrow(within, schema)
    if not entered:
        return made.drop("__asked", "__x", "__rows")
    made = durable(made)
    asking = made.where("__asked is not null").select(F.col("__asked").alias("block"), F.col("__rows").alias("after"), F.col("__x").alias("x"), F.col(BLOCK).alias("from_block"), F.col(PLACE).alias("place"))
    counts = durable(asking.groupBy("block").agg(F.ceil(F.count("*") / ASKED_AT_ONCE).alias("copies")))  # a row a partition at most
    copied = F.broadcast(counts)
    asking = asking.join(copied, "block").select("block", F.pmod(F.xxhash64("from_block", "place"), "copies").alias("copy"), F.lit(1).alias("asks"), "after", "x", "from_block", "place")
    told = base.mapInArrow(records, "block int, after long, x double").join(copied, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("asks"), "after", "x", F.lit(None).cast("int").alias("from_block"), F.lit(None).cast("long").alias("place"))
    met = told.unionByName(asking).repartition("block", "copy").sortWithinPartitions("block", "copy", "asks", "after")
    told = met.mapInArrow(answers, f"{BLOCK} int, {PLACE} long, __found int")
    return made.join(told, [BLOCK, PLACE], "left").withColumn(into, F.coalesce(into, "__found")).select(*base.columns, into)


def _last_of_blocks(base: DataFrame, keys: tuple[str, ...]) -> list[tuple[int, list, list, int, int]]:
    """(block, first key, last key, rows of the first key, rows of the last key) of each block: a row a partition."""
    at = [base.columns.index(name) for name in (BLOCK, *keys)]

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            ids = list(zip(*(batch.column(i).to_pylist() for i in at), strict=True))
            for start, stop in runs(ids):
                block, *key = ids[start]
                one = found.setdefault(block, [key, key, 0, 0])
                if one[1] != key:
                    one[1], one[3] = key, 0
                one[2] += (stop - start) * (key == one[0])
                one[3] += stop - start
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([pickle.dumps(x) for x in found.values()], pa.binary())], names=["block", "found"])

    return sorted((row["block"], *pickle.loads(row["found"])) for row in base.mapInArrow(summaries, "block int, found binary").collect())


def _reaches(blocks: list[tuple[int, list, list, int, int]], before: int, after: int) -> list[tuple[int, int, int, bool]]:
    """(block, block that needs rows of it, how many, whether its last or its first ones)."""
    out = []
    for i, (block, first, last, *_) in enumerate(blocks):
        missing, j = before, i - 1
        while missing > 0 and j >= 0 and blocks[j][2] == first:
            there = blocks[j][4]
            out.append((blocks[j][0], block, min(missing, there), True))
            missing, j = missing - there, j - 1 if blocks[j][1] == first else -1
        missing, j = after, i + 1
        while missing > 0 and j < len(blocks) and blocks[j][1] == last:
            there = blocks[j][3]
            out.append((blocks[j][0], block, min(missing, there), False))
            missing, j = missing - there, j + 1 if blocks[j][2] == last else len(blocks)
    return out


def windowed(df: DataFrame, make: Callable[[Series], dict[str, Column]], series: Series, before: int, after: int = 0, blocks: int | None = None) -> DataFrame:
    """df with columns of windows whose frames, nested ones together, reach at most so many rows back and ahead.

    make(series) gives the columns; the series that it gets is cut at blocks. Functions of a row's absolute position, and of all rows so
    far, aren't for this; those are steps of scan().
    """
    base = in_blocks(df, series.keys, series.order, blocks)
    found = _last_of_blocks(base, series.keys)
    wanted = _reaches(found, before, after)
    rows = base.withColumn("__own", F.lit(True))
    if wanted:
        # A row for each two neighbouring blocks, more only where blocks are shorter than a frame.
        lengths = dict(zip((b[0] for b in found), base.groupBy(BLOCK).count().orderBy(BLOCK).toPandas()["count"].tolist(), strict=True))
        bounds = [(source, target, lengths[source] - n, lengths[source]) if at_end else (source, target, 0, n) for source, target, n, at_end in wanted]
        table = df.sparkSession.createDataFrame(bounds, f"{BLOCK} int, __to int, __low long, __high long")
        halo = base.join(F.broadcast(table), BLOCK).where(f"{PLACE} >= __low and {PLACE} < __high")
        halo = halo.withColumn(BLOCK, F.col("__to")).withColumn("__own", F.lit(False))
        rows = rows.unionByName(halo.select(*rows.columns))
    columns = make(Series(keys=(BLOCK, *series.keys), order=series.order))
    return rows.select("*", *[column.alias(name) for name, column in columns.items()]).where("__own").select(*df.columns, *columns)


def ranges(df: DataFrame, columns: dict[str, tuple[str, bool]], keys: tuple[str, ...], order: str, blocks: int | None = None) -> DataFrame:
    """df with, by new name, the numbers of rows directly before that lie below (or above) a column's value: (column, above)."""
    base = made = in_blocks(df, keys, order, blocks)
    for name, (x, lowest) in columns.items():
        found = nearest(base, x, name, keys, lowest).select(BLOCK, PLACE, name)
        made = made.join(found, [BLOCK, PLACE])
    return made.select(*df.columns, *columns)
