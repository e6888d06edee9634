"""The Spark session that the library expects."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Settings of a run; from_sources takes arguments before environment variables before a file before these."""

    warehouse: str = "spark-warehouse"
    shuffle_partitions: int = 200
    time_zone: str = "UTC"
    adaptive: bool = True

    @classmethod
    def from_sources(cls, path: str | None = None, prefix: str = "BARLINE_", **given: object) -> Settings:
        """A file has lines of name: value. Values are cast to the type of the default; unknown names are errors."""
        found: dict[str, object] = {}
        if path and Path(path).exists():
            for line in Path(path).read_text().splitlines():
                line = line.split("#")[0].strip()
                if line:
                    name, _, value = line.partition(":")
                    found[name.strip()] = value.strip().strip("'\"")
        known = {f.name: f for f in fields(cls)}
        found |= {name: os.environ[prefix + name.upper()] for name in known if prefix + name.upper() in os.environ}
        found |= {name: value for name, value in given.items() if value is not None}
        if unknown := found.keys() - known.keys():
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")

        def cast(name: str, value: object) -> object:
            kind = type(known[name].default)
            return str(value).lower() in ("1", "true", "yes", "on") if kind is bool else kind(value)

        return cls(**{name: cast(name, value) for name, value in found.items()})


def session(name: str = "barline", settings: Settings | None = None, master: str | None = None) -> SparkSession:
    """The running session, or a new one."""
    settings = settings or Settings()
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.shuffle.partitions", settings.shuffle_partitions)
        .config("spark.sql.session.timeZone", settings.time_zone)
        .config("spark.sql.adaptive.enabled", settings.adaptive)
        .config("spark.sql.warehouse.dir", settings.warehouse)
        .getOrCreate()
    )
