"""Market breadth and screens: many series summed by date."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.durable import durable
from barline.functions.series import Series
from barline.functions.technical import NMM, W_GL, with_td
from barline.operators import smoothed

SIGNALS = ("JXB", "JXT", "GLB", "GLGB", "GLT", "GLGT", "TDB", "TDT1", "TDT2", "NMMB", "NMMT")


def with_signals(bars: DataFrame, prefix: str = "", s: Series | None = None) -> DataFrame:
    """bars with the signal columns, from price columns whose names start with prefix."""
    s = s or Series()
    names = [prefix + c for c in ("open", "high", "low", "close")]
    close = F.col(names[3])
    _, nmmb, nmmt = NMM(close, s=s)
    windows = dict(zip(("GLB", "GLGB", "GLT", "GLGT"), W_GL(close, s), strict=True)) | {"NMMB": nmmb, "NMMT": nmmt}
    return smoothed.add(with_td(bars, *names, s=s), smoothed.w_jx(*names, s=s), s=s, more=windows)


def breadth(signals: DataFrame, close: str = "close", names: Iterable[str] = SIGNALS) -> DataFrame:
    """For each trade_date: total, the series with a price, and how many series show each signal.

    Signals are reduced to counts before the shuffle by date.
    """

    def count(condition: Column) -> Column:
        return F.sum(F.coalesce(condition.cast("int"), F.lit(0))).cast("int")

    priced = F.col(close).isNotNull() & ~F.isnan(F.col(close))
    return signals.groupBy("trade_date").agg(count(priced).alias("total"), *[count(F.col(n)).alias(n) for n in names])


def screen(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """The rows whose columns lie within all ranges, ends included."""
    for name, (low, high) in ranges.items():
        if low is not None:
            df = df.where(F.col(name) >= low)
        if high is not None:
            df = df.where(F.col(name) <= high)
    return df


STATISTICS = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min}


def by_date(df: DataFrame, metric: str, *statistics: str) -> DataFrame:
    """The statistics (by default the mean) of each date, in one aggregation."""
    return df.groupBy("trade_date").agg(*[STATISTICS[name](metric).alias(name) for name in statistics or ("mean",)])


#: Buckets that a round of the median cuts a range of values into, and targets that go to the rows by broadcast; more are joined by a shuffle.
BUCKETS, FEW = 1024, 100_000


def median_by_date(df: DataFrame, metric: str, by: str = "trade_date") -> DataFrame:
    """The exact median of each date's values, however many a date has: (by, median). Null, NaN and infinite values take no part.

    A selection in rounds: the range that holds the middle value (or one of the two) is cut into BUCKETS, whose rows are counted, and the
    bucket that holds it is the next range, from its least value to its greatest. Only counts are shuffled, so no task holds a date.
    """
    x = F.col(metric).cast("double")
    values = df.select(by, x.alias("x")).where(F.abs("x") < float("inf"))
    sizes = values.groupBy(by).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    middle = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    targets = durable(sizes.select(by, F.explode(middle).alias("rank"), F.lit(0).cast("long").alias("below"), "low", "high"))
    while not (open_ := targets.where("low < high")).isEmpty():
        met = values.join(F.broadcast(open_) if open_.count() <= FEW else open_, by).where("x >= low and x <= high")
        at = F.floor((F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BUCKETS)
        counted = met.groupBy(by, "rank", "below", F.least(at, F.lit(BUCKETS - 1)).alias("bucket")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        through = F.col("below") + F.sum("n").over(W.partitionBy(by, "rank").orderBy("bucket"))
        cut = counted.withColumn("through", through).where("through > rank and through - n <= rank")
        targets = durable(targets.where("low >= high").unionByName(cut.select(by, "rank", (F.col("through") - F.col("n")).alias("below"), "low", "high")))
    return targets.groupBy(by).agg(F.avg("low").alias("median"))


def count_range(df: DataFrame) -> DataFrame:
    """The least and the most rows of a date."""
    return df.groupBy("trade_date").count().agg(F.min("count").alias("least"), F.max("count").alias("most"))
