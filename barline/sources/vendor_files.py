"""Landed vendor files as a data source, for batches and streams.

Files land as <folder>/<kind>/<day>/<name>.csv, where the day is yyyymmdd and the name is the code as the vendor spells it (or any other, for
files of many codes, which then have a field for it). `spark.read.format("vendor_files")` gives their rows as text, with the fields of
the vendor's kind of file; `landed` cleans them too. Filters on `day` and `code` (equal, in, and ranges of days) are pushed: files that can't
have a matching row aren't opened. A file is a partition, or several small ones are.

A stream's offset is a day and a name: files are taken in that order, so a file is taken once, and one that lands behind the offset isn't
taken, as with any source that is read forward. A stream goes on from its checkpoint.

Files are opened by pyarrow's file systems (local, HDFS, S3, GCS by their URIs), in the executors.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StringType, StructField, StructType

from barline.sources.landing import ARCHIVE_FIELDS, DIVIDEND_FIELDS, VENDORS

#: Fields of a file by vendor and kind, besides code and day.
_BARS = ("open", "high", "low", "close", "volume", "amount")
FIELDS: dict[tuple[str, str], tuple[str, ...]] = {
    ("terminal", "trade_date"): ("date",),
    ("terminal", "stock_list"): ("name",),
    ("terminal", "index_list"): ("name",),
    ("terminal", "stock_daily"): ("date", *_BARS),
    ("terminal", "index_daily"): ("date", *_BARS),
    ("terminal", "stock_dividend"): ("date", *DIVIDEND_FIELDS),
    ("terminal", "capital_daily"): ("date", "Zgb", "Ltgb"),
    ("archive", "stock_daily"): ("date", *ARCHIVE_FIELDS),
    ("archive", "stock_list"): ("name",),
}
#: Bytes of files that are read by one task.
TASK_BYTES = 8 << 20


@dataclass
class Files(InputPartition):
    """(day, name, path) of the files of a partition."""

    files: list[tuple[str, str, str]]


def _listed(folder: str) -> list[tuple[str, str, str, int]]:
    """(day, name, path, bytes) of the landed files, in order. Two levels are listed: days, and the files of each."""
    from pyarrow import fs

    if "://" in folder:
        files, root = fs.FileSystem.from_uri(folder)
    else:
        files, root = fs.LocalFileSystem(), folder
    out = []
    for day in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if day.type == fs.FileType.Directory:
            for one in files.get_file_info(fs.FileSelector(day.path)):
                if one.is_file and one.base_name.endswith(".csv"):
                    out.append((day.base_name, one.base_name.removesuffix(".csv"), one.path, one.size))
    return sorted(out)


def _partitions(files: list[tuple[str, str, str, int]]) -> list[Files]:
    out, size = [], TASK_BYTES
    for *file, n in files:
        if size + n > TASK_BYTES:
            out.append(Files([]))
            size = 0
        out[-1].files.append(tuple(file))
        size += n
    return out


def _rows(folder: str, names: list[str], many: bool, partition: Files) -> Iterator[tuple]:
    from pyarrow import fs

    files = fs.FileSystem.from_uri(folder)[0] if "://" in folder else fs.LocalFileSystem()
    for day, name, path in partition.files:
        with files.open_input_stream(path) as raw:
            for row in csv.DictReader(io.TextIOWrapper(raw, "utf-8", newline="")):
                known = {"code": row.get("code") if many else name, "day": day}
                yield tuple(known[x] if x in known else row.get(x) for x in names)


def _may_match(filters: Sequence[Filter], day: str, name: str, many: bool) -> bool:
    """Whether a file can have a row that passes; many: files hold codes other than their names."""
    for one in filters:
        x = {"day": day, "code": name}[one.attribute[0]]
        if one.attribute[0] == "code" and many:
            continue
        if isinstance(one, In):
            passes = x in one.value
        else:
            passes = {EqualTo: x == one.value, GreaterThan: x > one.value, GreaterThanOrEqual: x >= one.value, LessThan: x < one.value, LessThanOrEqual: x <= one.value}[type(one)]
        if not passes:
            return False
    return True


class _Files(DataSourceReader):
    def __init__(self, folder: str, names: list[str], many: bool):
        self.folder, self.names, self.many, self.filters = folder, names, many, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            if isinstance(one, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and one.attribute in (("day",), ("code",)):
                self.filters.append(one)
                if one.attribute == ("day",) or not self.many:
                    continue  # a file's day and name are those of all its rows
            yield one

    def partitions(self) -> list[InputPartition]:
        return _partitions([x for x in _listed(self.folder) if _may_match(self.filters, x[0], x[1], self.many)]) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.folder, self.names, self.many, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str, names: list[str], many: bool):
        self.folder, self.names, self.many = folder, names, many

    def initialOffset(self) -> dict:
        return {"day": "", "name": ""}

    def latestOffset(self) -> dict:
        files = _listed(self.folder)
        return {"day": files[-1][0], "name": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = (start["day"], start["name"]), (end["day"], end["name"])
        return _partitions([x for x in _listed(self.folder) if low < x[:2] <= high])

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.folder, self.names, self.many, partition)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class VendorFiles(DataSource):
    """Options: path (the landing folder), vendor, kind; many (true: files hold codes other than their names)."""

    @classmethod
    def name(cls) -> str:
        return "vendor_files"

    def _given(self) -> tuple[str, tuple[str, ...]]:
        vendor, kind = self.options.get("vendor", "terminal"), self.options.get("kind", "stock_daily")
        if (vendor, kind) not in FIELDS:
            raise ValueError(f"the vendor {vendor} has no {kind}")
        return f"{self.options['path'].rstrip('/')}/{kind}", FIELDS[vendor, kind]

    def _many(self) -> bool:
        return self.options.get("many", "false").lower() == "true"

    def schema(self) -> StructType:
        return StructType([StructField(name, StringType()) for name in ("code", "day", *self._given()[1])])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Files(self._given()[0], schema.names, self._many())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self._given()[0], schema.names, self._many())


def _source(spark: SparkSession, folder: str, vendor: str, kind: str, many: bool, stream: bool) -> DataFrame:
    spark.dataSource.register(VendorFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = (spark.readStream if stream else spark.read).format("vendor_files").option("vendor", vendor).option("kind", kind).option("many", str(many).lower())
    return reader.load(folder)


def landed(spark: SparkSession, folder: str, vendor: str, kind: str, days: tuple[str, str] | None = None, codes: Sequence[str] = (), many: bool = False, stream: bool = False) -> DataFrame:
    """The landed files of a vendor's kind in the catalogue's form: of days from one to another (yyyymmdd, ends included), and of codes as the vendor spells them."""
    raw = _source(spark, folder, vendor, kind, many, stream)
    if days:
        raw = raw.where((F.col("day") >= days[0]) & (F.col("day") <= days[1]))
    if codes:
        raw = raw.where(F.col("code").isin(*codes))
    return VENDORS[vendor].clean(kind, raw)
