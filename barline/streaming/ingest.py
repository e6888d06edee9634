"""Continuous ingestion into the catalogue, and live bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barline.operators.catalog import Catalog


def into_catalog(rows: DataFrame, catalog: Catalog, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream to a table, passing over keys that are there: a batch that is run again changes nothing."""
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: catalog.insert(table, batch) and None)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def live_bars(ticks: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of a stream of ticks (code, trade_date, close), each given once no tick of it is still awaited."""
    bar = ticks.withWatermark("trade_date", late).groupBy("code", F.window("trade_date", length).alias("w"))
    found = bar.agg(
        F.min_by("close", "trade_date").alias("open"),
        F.max("close").alias("high"),
        F.min("close").alias("low"),
        F.max_by("close", "trade_date").alias("close"),
        F.count("*").cast("double").alias("volume"),
        F.sum("close").alias("amount"),
    )
    return found.select("code", F.col("w.start").alias("trade_date"), "open", "high", "low", "close", "volume", "amount")
