"""Incremental ingestion: only what lies at or after each code's latest stored date is taken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.operators.catalog import Catalog
from barline.schema import FIRST_DAY, InsertMode, keys_of


def watermarks(stored: DataFrame) -> DataFrame:
    """The latest trade_date of each code."""
    return stored.groupBy("code").agg(F.max("trade_date").alias("since"))


def missing_codes(entities: DataFrame, stored: DataFrame) -> DataFrame:
    """Codes of entities that have no stored row."""
    return entities.select("code").distinct().join(stored.select("code"), "code", "left_anti")


def progress(entities: DataFrame, stored: DataFrame, first_day: str = FIRST_DAY) -> DataFrame:
    """code and since, the date to fetch from, of every entity: its latest stored date, or the first day of trading."""
    known = entities.select("code").distinct().join(watermarks(stored), "code", "left")
    return known.select("code", F.coalesce("since", F.lit(first_day).cast("date")).alias("since"))


def due(landed: DataFrame, entities: DataFrame, stored: DataFrame) -> DataFrame:
    """The landed rows of known codes, from each code's date on, that date included."""
    return landed.join(progress(entities, stored), "code").where("trade_date >= since").drop("since")


def sync(catalog: Catalog, table: str, landed: DataFrame, entities: str | None = "stock_list", mode: str = InsertMode.IGNORE) -> dict[str, int]:
    """Brings a table up to date from landed rows; replace takes all of them instead."""
    if mode == InsertMode.REPLACE or "code" not in keys_of(catalog.schemas[table]) or entities is None:
        return catalog.insert(table, landed, mode)
    return catalog.insert(table, due(landed, catalog.read(entities), catalog.read(table)), mode)


#: Tables in the order in which a full run fills them, with the table of their entities.
ORDER = (("trade_date", None), ("stock_list", None), ("stock_daily", "stock_list"), ("capital_daily", "stock_list"), ("stock_dividend", "stock_list"), ("index_list", None), ("index_daily", "index_list"))


def sync_all(catalog: Catalog, landed: dict[str, DataFrame], mode: str = InsertMode.IGNORE) -> dict[str, dict[str, int]]:
    return {table: sync(catalog, table, landed[table], entities, mode) for table, entities in ORDER if table in landed}
