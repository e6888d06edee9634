"""All indicators, kept up to date: a day's bars are worked out from that day's bars, without the history.

A store is a folder of versions. A version has the rows that it added, and for each series what the next version needs: the state of the
recursive steps after its last bar, and its last LOOKBACK bars with the columns around the steps, which is as far as any window reaches back. A version
counts once its state is written; what a failed run leaves is passed over and written anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.durable import durable
from barline.functions import technical as T
from barline.functions.series import Series
from barline.operators import recursive, smoothed
from barline.plans.indicators import recursive_indicators, window_columns

#: No window of all_indicators, nested ones together, reaches back farther.
LOOKBACK = 300


class IndicatorStore:
    """Indicators of a bar table under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, s: Series | None = None, boll_digits: int | None = 2):
        self.spark, self.folder, self.s, self.boll_digits = spark, folder.rstrip("/"), s or Series(), boll_digits

    def versions(self) -> list[int]:
        """Numbers of the complete versions, oldest first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        numbers = [int(status.getPath().getName()) for status in files.listStatus(path) if status.getPath().getName().isdigit()]
        return sorted(n for n in numbers if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(n)}/state/_SUCCESS")))

    def _path(self, version: int) -> str:
        return f"{self.folder}/{version:010d}"

    def read(self) -> DataFrame:
        """The rows of all versions."""
        return self.spark.read.parquet(*[f"{self._path(n)}/rows" for n in self.versions()])

    def due(self, bars: DataFrame) -> DataFrame:
        """The bars after the last one of any series in the store; all, if it is empty. Earlier ones aren't read again."""
        versions = self.versions()
        if not versions:
            return bars
        until = self.spark.read.parquet(f"{self._path(versions[-1])}/state").agg(F.max("until")).first()[0]
        return bars.where(F.col(self.s.order) > F.lit(until))

    def advance(self, bars: DataFrame) -> dict[str, int]:
        """Adds a version for the bars that are due: how many these are, and how many earlier ones were read for their windows. Without any, none is added."""
        s, keys, versions = self.s, list(self.s.keys), self.versions()
        fresh = durable(self.due(bars))
        n = fresh.count()
        if not n:
            return {"rows": 0, "earlier": 0}
        indicators = [*recursive_indicators(s), smoothed.obv(s=s)]
        steps = {name: step for i in indicators for name, step in i.steps.items()}
        ready = {name: c for i in indicators for name, c in i.ready.items()}
        state = tail = None
        if versions:
            state = self.spark.read.parquet(f"{self._path(versions[-1])}/state")
            tail = self.spark.read.parquet(f"{self._path(versions[-1])}/tail").join(fresh.select(*keys).distinct(), keys, "left_semi")
        marked = fresh.withColumn("_fresh", F.lit(True))
        both = marked if tail is None else marked.unionByName(tail.select(*fresh.columns, F.lit(False).alias("_fresh")))
        prepared = durable(both.select("*", *[c.alias(name) for name, c in ready.items()]).where("_fresh").drop("_fresh"))
        stepped = recursive.with_recursive(prepared, steps, s) if state is None else recursive.with_recursive_since(prepared, steps, state, s)
        stepped = durable(stepped.withColumn("_fresh", F.lit(True)))
        made = stepped if tail is None else stepped.unionByName(tail.withColumn("_fresh", F.lit(False)))
        # What comes before the windows of the last stage isn't among the columns of a bar.
        staged = T.with_td(T.with_dmi(made, s=s), s=s)
        done = {name: c for i in indicators for name, c in i.done.items()}
        more = {name: c for name, c in window_columns(s, boll_digits=self.boll_digits).items() if name not in done}
        found = staged.select("*", *[c.alias(name) for name, c in (more | done).items()]).where("_fresh").drop("_fresh", *ready, *steps)

        path = self._path(versions[-1] + 1 if versions else 0)
        found.write.mode("overwrite").parquet(f"{path}/rows")
        newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(s.order)))
        last = made.drop("_fresh").withColumn("_newest", newest).where(F.col("_newest") <= LOOKBACK).drop("_newest")
        if versions:  # series without a bar today
            idle = self.spark.read.parquet(f"{self._path(versions[-1])}/tail").join(fresh.select(*keys).distinct(), keys, "left_anti")
            last = last.unionByName(idle)
        last.write.mode("overwrite").parquet(f"{path}/tail")
        recursive.states(prepared, steps, s, state).write.mode("overwrite").parquet(f"{path}/state")
        return {"rows": n, "earlier": 0 if tail is None else tail.count()}
