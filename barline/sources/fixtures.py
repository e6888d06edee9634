"""Market tables derived from the event stream, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def landed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files: those of its folder, or its one file."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(folder).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One short series for each user."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("user_id").alias("code"), F.col("ts").alias("trade_date"), F.col("value").alias("close"), "event_type")


def long_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ticks as one long series for each kind of event."""
    return ticks(spark, sf_dir).select(F.col("event_type").alias("code"), "trade_date", "close")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars, one series for each kind of event. Partial aggregates keep the hot kinds from being gathered."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.date_trunc("hour", "ts").alias("trade_date")
    return events.groupBy(F.col("event_type").alias("code"), hour).agg(
        F.min_by("value", "ts").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"),
        F.count("*").cast("double").alias("volume"),
        F.sum("value").alias("amount"),
    )


def stock_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_type").alias("code"), F.upper("event_type").alias("name")).distinct()


def capital_daily(bars_: DataFrame) -> DataFrame:
    return bars_.select("code", "trade_date", (F.col("volume") * 1000.0).alias("total_share"), (F.col("volume") * 600.0).alias("float_share"))


def stock_dividend(bars_: DataFrame) -> DataFrame:
    """A distribution on a few hours of a few days of each month."""
    paid = bars_.where(F.hour("trade_date").between(9, 12) & F.dayofmonth("trade_date").isin(5, 12, 19, 26))
    values = {"dividend": 5.0, "bonus_ratio": 1.0, "rights_ratio": 1.0, "rights_price": 6.0}
    return paid.select("code", "trade_date", F.lit("1").alias("category"), *[F.lit(v).alias(k) for k, v in values.items()])


#: The same tables as DuckDB SQL.
SQL = """
ticks AS (SELECT user_id AS code, ts AS trade_date, value AS close, event_type FROM events),
bars AS (
    SELECT event_type AS code, date_trunc('hour', ts) AS trade_date, min_by(value, ts) AS open, max(value) AS high, min(value) AS low,
        max_by(value, ts) AS close, count(*)::DOUBLE AS volume, sum(value) AS amount
    FROM events GROUP BY event_type, date_trunc('hour', ts)
),
stock_list AS (SELECT DISTINCT event_type AS code, upper(event_type) AS name FROM events),
capital_daily AS (SELECT code, trade_date, volume * 1000.0e0 AS total_share, volume * 600.0e0 AS float_share FROM bars),
stock_dividend AS (
    SELECT code, trade_date, '1' AS category, 5.0e0 AS dividend, 1.0e0 AS bonus_ratio, 1.0e0 AS rights_ratio, 6.0e0 AS rights_price
    FROM bars WHERE extract(hour FROM trade_date) BETWEEN 9 AND 12 AND extract(day FROM trade_date) IN (5, 12, 19, 26)
)
"""
