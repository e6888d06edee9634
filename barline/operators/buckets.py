"""Keyed tables that change by bucket.

Rows lie in buckets by a hash of their keys. A change writes new files for the buckets that it touches, as a new generation, and then a
new manifest that says which generations of each bucket count; so a failed change changes nothing, and readers of an older manifest
aren't disturbed until vacuum. An insert adds a generation to a bucket; an update or a delete puts one in the place of the bucket's others.

A Bloom filter for each generation of a bucket tells which buckets needn't be read: a key that none of them may hold is new. Filters are
tables of 64-bit words and are joined, so neither they nor keys pass through the driver. What does is the manifest: a row for each
generation of a bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.durable import durable
from barline.operators.catalog import deleted, updated
from barline.operators.predicates import Filter, predicate
from barline.schema import keys_of

BUCKETS = 64
#: Bits of a filter, and bits that a key sets: with a tenth as many keys as bits, one absent key in about 10,000 passes for present.
BLOOM_BITS, BLOOM_HASHES = 1 << 17, 4
#: A bucket with more generations is written as one by compact().
MOST_GENERATIONS = 8
_BUCKET, _GENERATION = "__bucket", "__generation"


class BucketedTable:
    """A table under a folder that all executors share. The folder's first table fixes the number of buckets."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: list[str] | None = None, buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder.rstrip("/"), schema, keys or keys_of(schema), buckets
        self.kinds = T.StructType([T.StructField(f.name, f.dataType) for f in schema])

    # The manifest

    def _fs(self, path: str) -> tuple:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list[str]:
        found, files = self._fs(path)
        return sorted(status.getPath().getName() for status in files.listStatus(found)) if files.exists(found) else []

    def version(self) -> int:
        """The number of the newest manifest; 0 for a table that nothing was written to."""
        return max((int(name) for name in self._list(f"{self.folder}/manifest") if name.isdigit()), default=0)

    def live(self) -> list[tuple[int, str]]:
        """(bucket, generation) of the files that count."""
        version = self.version()
        return [tuple(row) for row in self.spark.read.parquet(f"{self.folder}/manifest/{version:010d}").collect()] if version else []

    def _commit(self, live: list[tuple[int, str]], before: int) -> None:
        """Makes these the files that count, unless another change came between."""
        drafted, target = f"{self.folder}/manifest/draft-{uuid.uuid4().hex}", f"{self.folder}/manifest/{before + 1:010d}"
        self.spark.createDataFrame(live, "bucket int, generation string").coalesce(1).write.parquet(drafted)
        path, files = self._fs(target)
        if self.version() != before or files.exists(path) or not files.rename(self._fs(drafted)[0], path):
            raise RuntimeError("the table was changed by another writer; try again")

    # Rows and filters

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, live: Iterable[tuple[int, str]]) -> DataFrame:
        paths = [f"{self.folder}/rows/{generation}/{_BUCKET}={bucket}" for bucket, generation in live]
        return self.spark.read.schema(self.kinds).parquet(*paths) if paths else self.spark.createDataFrame([], self.kinds)

    def read(self) -> DataFrame:
        return self._rows(self.live())

    def _probes(self, rows: DataFrame) -> DataFrame:
        """rows with `word` and `bit` of the bits that each key sets: BLOOM_HASHES rows for one."""
        places = [F.pmod(F.xxhash64(*self.keys, F.lit(i + 1)), F.lit(BLOOM_BITS)) for i in range(BLOOM_HASHES)]
        structs = [F.struct(F.floor(at / 64).cast("int").alias("word"), F.pmod(at, F.lit(64)).cast("int").alias("place")) for at in places]
        return rows.select("*", F.explode(F.array(*structs)).alias("at")).select(*rows.columns, "at.word", F.expr("shiftleft(1L, at.place)").alias("bit"))

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Writes rows (with their bucket) and their filters as a generation: its name, and the buckets that it has files of."""
        generation = uuid.uuid4().hex
        rows = durable(rows)
        filters = self._probes(rows.select(*self.keys, _BUCKET)).groupBy(_BUCKET, "word").agg(F.bit_or("bit").alias("bits"))
        filters.withColumn(_GENERATION, F.lit(generation)).write.parquet(f"{self.folder}/filters/{generation}")
        rows.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.folder}/rows/{generation}")
        return generation, sorted(int(name.split("=")[1]) for name in self._list(f"{self.folder}/rows/{generation}") if name.startswith(_BUCKET))

    def _there(self, keys: DataFrame, live: list[tuple[int, str]]) -> DataFrame:
        """Of rows of keys and their bucket, those that the table may hold."""
        if not live:
            return keys.limit(0)
        counted = F.broadcast(self.spark.createDataFrame(live, f"{_BUCKET} int, {_GENERATION} string"))  # a row a generation of a bucket
        filters = self.spark.read.parquet(*[f"{self.folder}/filters/{generation}" for generation in sorted({g for _, g in live})])
        filters = filters.join(counted, [_BUCKET, _GENERATION]).groupBy(_BUCKET, "word").agg(F.bit_or("bits").alias("bits"))
        hits = self._probes(keys).join(filters, [_BUCKET, "word"]).where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        return hits.groupBy(*self.keys, _BUCKET).agg(F.count("*").alias("hits")).where(F.col("hits") == BLOOM_HASHES).drop("hits")

    def _touched(self, keys: DataFrame) -> list[int]:
        return [row[0] for row in keys.select(_BUCKET).distinct().collect()]  # BUCKETS at most

    def _cast(self, rows: DataFrame) -> DataFrame:
        names = [f for f in self.schema if f.name in rows.columns]
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in names]).withColumn(_BUCKET, self.bucket())

    # Changes

    def insert(self, rows: DataFrame) -> dict[str, int]:
        """Adds the rows whose key isn't there, the first of each key. Counts rows inserted and ignored, and buckets read and written."""
        before, live = self.version(), self.live()
        given = durable(self._cast(rows))
        fresh = given.dropDuplicates(self.keys)
        doubtful = durable(self._there(given.select(*self.keys, _BUCKET).distinct(), live))
        read = self._touched(doubtful)
        if read:
            known = self._rows([x for x in live if x[0] in set(read)]).select(*self.keys)
            fresh = fresh.join(doubtful.join(known, self.keys, "left_semi").select(*self.keys), self.keys, "left_anti")
        generation, written = self._write(fresh)
        if written:
            self._commit(live + [(bucket, generation) for bucket in written], before)
        n = self._rows([(bucket, generation) for bucket in written]).count()
        return {"inserted": n, "ignored": given.count() - n, "buckets_read": len(read), "buckets_written": len(written)}

    def _replace(self, rows: DataFrame, buckets: list[int], live: list[tuple[int, str]], before: int) -> None:
        """Puts rows in the place of all rows of some buckets."""
        generation, written = self._write(rows)
        self._commit([x for x in live if x[0] not in set(buckets)] + [(bucket, generation) for bucket in written], before)

    def update(self, changes: DataFrame) -> dict[str, int]:
        """Sets the columns of changes where the keys match. Counts rows matched, and buckets read and written."""
        before, live = self.version(), self.live()
        changes = durable(self._cast(changes).dropDuplicates(self.keys))
        read = self._touched(self._there(changes.select(*self.keys, _BUCKET), live))
        stored = self._rows([x for x in live if x[0] in set(read)]).withColumn(_BUCKET, self.bucket())
        matched = {row[_BUCKET]: row["count"] for row in stored.join(changes.select(*self.keys), self.keys, "left_semi").groupBy(_BUCKET).count().collect()}
        if matched:
            inside = stored.where(F.col(_BUCKET).isin(*matched))
            self._replace(updated(inside, changes.drop(_BUCKET), self.keys), list(matched), live, before)
        return {"matched": sum(matched.values()), "buckets_read": len(read), "buckets_written": len(matched)}

    def delete(self, filters: Iterable[Filter]) -> dict[str, int]:
        """Deletes the rows on which all filters are true. Filters that give every key one value lead to one bucket; else all are read."""
        before, live, filters = self.version(), self.live(), list(filters)
        named = {name: value for name, sign, value in filters if sign in ("=", "==")}
        condition, cut = predicate(filters), live
        if set(self.keys) <= set(named):
            one = self._cast(self.spark.range(1).select(*[F.lit(named[key]).alias(key) for key in self.keys]))
            cut = [x for x in live if x[0] in set(self._touched(self._there(one, live)))]
        stored = self._rows(cut).withColumn(_BUCKET, self.bucket())
        gone = {row[_BUCKET]: row["count"] for row in stored.where(condition).groupBy(_BUCKET).count().collect()}
        if gone:
            self._replace(deleted(stored.where(F.col(_BUCKET).isin(*gone)), condition), list(gone), live, before)
        return {"deleted": sum(gone.values()), "buckets_read": len({bucket for bucket, _ in cut}), "buckets_written": len(gone)}

    def compact(self) -> int:
        """Writes buckets of many generations as one each; returns how many."""
        before, live = self.version(), self.live()
        generations: dict[int, int] = {}
        for bucket, _ in live:
            generations[bucket] = generations.get(bucket, 0) + 1
        many = [bucket for bucket, n in generations.items() if n > MOST_GENERATIONS]
        if many:
            self._replace(self._rows([x for x in live if x[0] in set(many)]).withColumn(_BUCKET, self.bucket()), many, live, before)
        return len(many)

    def vacuum(self) -> int:
        """Removes the files that no longer count, for when nobody reads them; returns how many folders."""
        live, gone = set(self.live()), 0
        used = {generation for _, generation in live}
        for generation in self._list(f"{self.folder}/rows"):
            folders = [f"{self.folder}/rows/{generation}", f"{self.folder}/filters/{generation}"]
            if generation in used:
                names = [name for name in self._list(folders[0]) if name.startswith(_BUCKET)]
                folders = [f"{folders[0]}/{name}" for name in names if (int(name.split("=")[1]), generation) not in live]
            for folder in folders:
                path, files = self._fs(folder)
                gone += files.delete(path, True)
        return gone
