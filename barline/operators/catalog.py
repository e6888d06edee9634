"""Stored tables: scan, aggregate, insert-ignore, update, delete, truncate.

Parquet tables can't be changed in place, so changes write a new generation of a table's files beside the current one
and then switch the table over to it; readers of the old files aren't disturbed and a failed write changes nothing. Catalog.vacuum removes generations that are
no longer in use.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.operators.predicates import Filter, predicate
from barline.schema import TABLES, InsertMode, TableError, keys_of

# Plain functions from DataFrames to the DataFrame that a change leaves.


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of incoming to append: one for each key that existing lacks."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def updated(existing: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """existing with every other column that changes has taken from it where the keys match; nulls overwrite."""
    fields = [c for c in changes.columns if c not in keys]
    source = changes.dropDuplicates(keys).select(*keys, F.struct(*fields).alias("_new"))
    joined = existing.join(source, keys, "left")
    return joined.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in existing.columns])


def deleted(existing: DataFrame, where: Column) -> DataFrame:
    """existing without the rows on which the condition is true."""
    return existing.where(~F.coalesce(where, F.lit(False)))


def aggregate(df: DataFrame, expressions: dict[str, str], filters: Iterable[Filter] | None = None, by: Iterable[str] = ()) -> DataFrame:
    """SQL aggregates by alias, over the rows that pass the filters, for each group or over all."""
    return df.where(predicate(filters)).groupBy(*by).agg(*[F.expr(e).alias(a) for a, e in expressions.items()])


def union(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows of all frames, by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def _observed(rows: Observation) -> int | None:
    """How many rows went by; None if the plan was cut short, as one is that turns out to be empty while it runs."""
    try:
        return rows.get["n"]
    except Py4JJavaError:
        return None


class Catalog:
    """The tables and views of a database in the session's catalogue."""

    def __init__(self, spark: SparkSession, database: str = "market", schemas: dict[str, T.StructType] | None = None):
        self.spark, self.database, self.schemas = spark, database, schemas or TABLES
        self.views: dict[str, Callable[[Catalog], DataFrame]] = {}

    def __enter__(self) -> Catalog:
        return self.create()

    def __exit__(self, *_: object) -> None:
        self.close()

    def create(self) -> Catalog:
        """Creates what is missing; existing tables are left as they are."""
        self.spark.sql(f"create database if not exists {self.database}")
        for name, schema in self.schemas.items():
            if not self.spark.catalog.tableExists(self.target(name)):
                self._point(name, self._write(name, self.spark.createDataFrame([], schema)))
        return self

    def close(self) -> None:
        """Forgets the registered views."""
        for name in self.views:
            self.spark.catalog.dropTempView(name)
        self.views.clear()

    def view(self, name: str, make: Callable[[Catalog], DataFrame]) -> None:
        """Registers a query under a name, also as a temporary view for SQL."""
        self.views[name] = make
        make(self).createOrReplaceTempView(name)

    def target(self, name: str) -> str:
        if name not in self.schemas:
            raise TableError(f"no table or view {name}")
        return f"{self.database}.{name}"

    def read(self, name: str) -> DataFrame:
        if name in self.views:
            return self.views[name](self)
        return self.spark.table(self.target(name))

    def select(self, name: str, filters: Iterable[Filter] | None = None, columns: Iterable[str] | None = None) -> DataFrame:
        """The schema's columns, or those asked for, of the rows that pass every filter."""
        df = self.read(name)
        return df.where(predicate(filters)).select(*(columns or df.columns))

    def aggregate(self, name: str, expressions: dict[str, str], filters: Iterable[Filter] | None = None, by: Iterable[str] = ()) -> DataFrame:
        return aggregate(self.read(name), expressions, filters, by)

    def insert(self, name: str, rows: DataFrame, mode: str = InsertMode.IGNORE) -> dict[str, int]:
        """Adds rows, matched by column name and cast to the schema. ignore: rows whose key is there, or came earlier in
        the batch, are passed over; replace: the rows become the table; append: all are added."""
        schema = self.schemas[name]
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        # Rows are counted as they are written: the table isn't counted, and the batch is worked out once (twice if none of it is new).
        given, written = Observation(), Observation()
        counted = rows.observe(given, F.count(F.lit(1)).alias("n"))
        fresh = insert_ignore(self.read(name), counted, keys_of(schema)) if mode == InsertMode.IGNORE else counted
        fresh = fresh.observe(written, F.count(F.lit(1)).alias("n"))
        if mode == InsertMode.REPLACE:
            self._point(name, self._write(name, fresh))
        else:
            fresh.write.mode("append").format("parquet").insertInto(self.target(name))
            self.spark.catalog.refreshTable(self.target(name))
        inserted, n = _observed(written) or 0, _observed(given)
        return {"inserted": inserted, "ignored": (rows.count() if n is None else n) - inserted}

    batch_insert_ignore = insert

    def update(self, name: str, changes: DataFrame, keys: list[str] | None = None) -> int:
        """Sets the columns of changes where the keys match; returns how many rows matched."""
        keys = keys or keys_of(self.schemas[name])
        matched = self.read(name).join(changes.select(*keys).distinct(), keys, "left_semi").count()
        self._point(name, self._write(name, updated(self.read(name), changes, keys)))
        return matched

    def delete(self, name: str, filters: Iterable[Filter]) -> int:
        """Deletes the rows on which all filters are true; returns how many."""
        condition = predicate(filters)
        gone = self.read(name).where(condition).count()
        self._point(name, self._write(name, deleted(self.read(name), condition)))
        return gone

    def truncate(self, name: str) -> None:
        self._point(name, self._write(name, self.spark.createDataFrame([], self.schemas[name])))

    def truncate_all(self, confirm: bool = False) -> dict[str, int]:
        if not confirm:
            raise ValueError("emptying every table has to be confirmed")
        for name in self.schemas:
            self.truncate(name)
        return {"tables_cleared": len(self.schemas)}

    def sql(self, query: str, args: dict[str, Any] | None = None, like: str | None = None) -> DataFrame | None:
        """The result of a query, with the columns and types of the table like, if given; None for other statements."""
        df = self.spark.sql(query, args=args or {})
        if not df.columns:
            return None
        if like:
            return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schemas[like]])
        return df

    def vacuum(self) -> int:
        """Removes the generations of tables that are no longer in use, for when nobody reads them; returns how many."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder())
        files, gone = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), 0
        used = {self.spark.sql(f"describe formatted {self.target(name)}").where("col_name = 'Location'").first()[1].rstrip("/").rsplit("/", 1)[1] for name in self.schemas}
        for status in files.listStatus(folder):
            generation = status.getPath().getName()
            if generation not in used and generation.rsplit("-", 1)[0] in self.schemas:
                gone += files.delete(status.getPath(), True)
        return gone

    def _folder(self) -> str:
        return self.spark.sql(f"describe database {self.database}").where("info_name = 'Location'").first()[1]

    def _write(self, name: str, df: DataFrame) -> str:
        path = f"{self._folder()}/{name}-{uuid.uuid4().hex}"
        nullable = T.StructType([T.StructField(f.name, f.dataType) for f in self.schemas[name]])
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in nullable]).write.parquet(path)
        return path

    def _point(self, name: str, path: str) -> None:
        """Makes a folder the table's data."""
        target = self.target(name)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schemas[name])
        if self.spark.catalog.tableExists(target):
            self.spark.sql(f"alter table {target} set location '{path}'")
        else:
            self.spark.sql(f"create table {target} ({columns}) using parquet location '{path}'")
        self.spark.catalog.refreshTable(target)
