"""Rolling functions over the ordered rows of each series.

A Series names the columns that identify and order a series. Its methods take and return Columns; all of them share one
window specification, so however many are nested or put side by side, Spark shuffles by the keys and sorts once.
A rolling function is null until its window holds as many non-null values as it is long.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.functions.numeric import as_column


@dataclass(frozen=True)
class Series:
    keys: tuple[str, ...] = ("code",)
    order: str = "trade_date"

    @property
    def rows(self) -> WindowSpec:
        return W.partitionBy(*self.keys).orderBy(self.order)

    def last(self, n: int) -> WindowSpec:
        """The current row and those before it, n in all."""
        return self.rows.rowsBetween(1 - n, 0)

    @property
    def so_far(self) -> WindowSpec:
        return self.rows.rowsBetween(W.unboundedPreceding, 0)

    @property
    def whole(self) -> WindowSpec:
        return self.rows.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)

    @property
    def position(self) -> Column:
        """1, 2, 3 ... along the series."""
        return F.row_number().over(self.rows)

    def full(self, x: Column, n: int, value: Column) -> Column:
        """value where the last n rows hold n non-null x."""
        return F.when(F.count(x).over(self.last(n)) >= n, value)

    def rolling(self, function: Callable[[Column], Column], x: Column | str, n: int) -> Column:
        x = as_column(x)
        return self.full(x, n, function(x).over(self.last(n)))

    # Shifts and constants

    def REF(self, x: Column | str, n: int = 1) -> Column:
        """The value n rows before; a negative n looks ahead."""
        return F.lag(as_column(x), n).over(self.rows)

    def DIFF(self, x: Column | str, n: int = 1) -> Column:
        return as_column(x) - self.REF(x, n)

    def CONST(self, x: Column | str) -> Column:
        """The series' last value, on every row."""
        return F.last(as_column(x)).over(self.whole)

    def RET(self, df: DataFrame, **wanted: tuple[str, int]) -> DataFrame:
        """A row for each series, with the n-th value of a column from the series' end by name: (column, n); null if the series is shorter.

        Only the last rows of each series are shuffled.
        """
        newest = F.row_number().over(W.partitionBy(*self.keys).orderBy(F.desc(self.order)))
        last = df.withColumn("_newest", newest).where(F.col("_newest") <= max(n for _, n in wanted.values()))
        return last.groupBy(*self.keys).agg(*[F.max(F.when(F.col("_newest") == n, F.col(x))).alias(name) for name, (x, n) in wanted.items()])

    # Windows of n rows

    def SUM(self, x: Column | str, n: int) -> Column:
        """Over n rows; with n = 0 over all rows so far, null where x is null."""
        x = as_column(x)
        if n > 0:
            return self.rolling(F.sum, x, n)
        return F.when(x.isNotNull(), F.sum(x).over(self.so_far))

    def MA(self, x: Column | str, n: int) -> Column:
        return self.rolling(F.avg, x, n)

    def STD(self, x: Column | str, n: int) -> Column:
        """Population standard deviation."""
        return self.rolling(F.stddev_pop, x, n)

    def HHV(self, x: Column | str, n: int) -> Column:
        return self.rolling(F.max, x, n)

    def LLV(self, x: Column | str, n: int) -> Column:
        return self.rolling(F.min, x, n)

    def HHVBARS(self, x: Column | str, n: int) -> Column:
        """Rows since the highest of the last n, the oldest one on ties."""
        x, at = as_column(x), self.position
        return self.full(x, n, at - F.max_by(at, F.struct(x, -at)).over(self.last(n)))

    def LLVBARS(self, x: Column | str, n: int) -> Column:
        x, at = as_column(x), self.position
        return self.full(x, n, at - F.min_by(at, F.struct(x, at)).over(self.last(n)))

    def WMA(self, x: Column | str, n: int) -> Column:
        """Mean with weights 1 to n, the newest weighing most."""
        x, at, window = as_column(x), self.position, self.last(n)
        weighted = F.sum(at * x).over(window) - (at - n) * F.sum(x).over(window)
        return self.full(x, n, weighted / (n * (n + 1) / 2))

    def AVEDEV(self, x: Column | str, n: int) -> Column:
        """Mean absolute deviation from the window's mean."""
        x, window = as_column(x), self.last(n)
        values, mean = F.collect_list(x).over(window), F.avg(x).over(window)
        total = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.abs(v - mean))
        return self.full(x, n, total / n)

    def SLOPE(self, x: Column | str, n: int) -> Column:
        """Slope of the least-squares line through the last n values."""
        x = as_column(x)
        return self.full(x, n, F.regr_slope(x, self.position).over(self.last(n)))

    def FORCAST(self, x: Column | str, n: int) -> Column:
        """Value of that line at the current row."""
        x, at, window = as_column(x), self.position, self.last(n)
        return self.full(x, n, F.regr_intercept(x, at).over(window) + F.regr_slope(x, at).over(window) * at)

    def LAST(self, condition: Column, a: int, b: int) -> Column:
        """Whether the condition held on all of the a rows that end b rows ago."""
        return self.rolling(F.sum, self.REF(condition.cast("int"), b), a) == a

    # Signals

    def COUNT(self, condition: Column, n: int) -> Column:
        """How often the condition held in n rows; with n = 0, so far."""
        return self.SUM(condition.cast("int"), n)

    def EVERY(self, condition: Column, n: int) -> Column:
        return self.COUNT(condition, n) == n

    def EXIST(self, condition: Column, n: int) -> Column:
        return self.COUNT(condition, n) > 0

    def BARSLAST(self, condition: Column) -> Column:
        """Rows since the condition last held; null if it never did."""
        at = self.position
        return at - F.last(F.when(condition, at), ignorenulls=True).over(self.so_far)

    def BARSLASTCOUNT(self, condition: Column) -> Column:
        """Length of the run of rows, up to this one, on which the condition holds."""
        at = self.position
        broken = F.max(F.when(~condition, at)).over(self.so_far)
        return F.when(condition, at - F.coalesce(broken, F.lit(0))).otherwise(0)

    def BARSSINCEN(self, condition: Column, n: int) -> Column:
        """Rows since the condition first held in the last n; 0 if it didn't or there are fewer rows."""
        at = self.position
        first = F.min(F.when(condition, at)).over(self.last(n))
        return F.coalesce(self.full(condition, n, at - first), F.lit(0))

    def CROSS(self, a: Column | float, b: Column | float) -> Column:
        """Whether a rose above b on this row."""
        a, b = as_column(a), as_column(b)
        return (self.REF(a) <= self.REF(b)) & (a > b)

    def LONGCROSS(self, a: Column | float, b: Column | float, n: int) -> Column:
        """Whether a is above b after n rows below it."""
        a, b = as_column(a), as_column(b)
        return (self.rolling(F.sum, self.REF((a < b).cast("int")), n) == n) & (a > b)

    def VALUEWHEN(self, condition: Column, x: Column | str) -> Column:
        """x on the last row on which the condition held (and x wasn't null)."""
        return F.last(F.when(condition, as_column(x)), ignorenulls=True).over(self.so_far)


def BETWEEN(x: Column, a: Column | float, b: Column | float) -> Column:
    """Whether x lies strictly between a and b, whichever is larger."""
    a, b = as_column(a), as_column(b)
    return ((a < x) & (x < b)) | ((a > x) & (x > b))
