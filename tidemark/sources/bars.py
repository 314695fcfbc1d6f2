"""The bar table: Parquet partitioned by timeframe and year, merged by key, swapped whole."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators.asof import TIMEFRAMES
from tidemark.operators.quality import DataError, require_valid
from tidemark.session import materialize
from tidemark.sources import snapshots

KEY = ["symbol", "ts"]
VALUES = ["open", "high", "low", "close", "volume"]


def read_bars(spark: SparkSession, path: str, symbol: str | None = None, timeframe: str | None = None,
              start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Bars in [start, end]. The year predicate that follows from the range prunes partitions;
    the exact range and the symbol are pushed to the scan."""
    d = snapshots.read(spark, path, schemas.BARS, where=(lambda part: part.startswith(f"timeframe={timeframe}/")) if timeframe else None)
    if timeframe:
        d = d.filter(F.col("timeframe") == timeframe)
    if start is not None:
        d = d.filter((F.col("year") >= start.year) & (F.col("ts") >= F.lit(start)))
    if end is not None:
        d = d.filter((F.col("year") <= end.year) & (F.col("ts") <= F.lit(end)))
    return d.filter(F.col("symbol") == symbol) if symbol else d


def upsert_bars(spark: SparkSession, path: str, incoming: DataFrame, timeframe: str,
                allow_nonpositive: bool = False) -> int:
    """Merge bars into the table and return how many are new. Only the years touched are rewritten,
    and the change appears at once: a job that dies on the way leaves the old table as it was.

    Prices at or below zero are refused unless allowed: futures and differences can print there."""
    if timeframe not in TIMEFRAMES:
        raise DataError(f"unknown timeframe {timeframe!r}")
    new = materialize(incoming.select("symbol", "ts", *VALUES).withColumn("timeframe", F.lit(timeframe)).withColumn("year", F.year("ts")))
    require_valid(new, allow_nonpositive=allow_nonpositive)
    years = [r[0] for r in new.select("year").distinct().collect()]  # calendar years: a handful
    if not years:
        return 0
    touched = lambda: read_bars(spark, path, timeframe=timeframe).filter(F.col("year").isin(*years))
    old = touched()
    before = old.count()
    rows = (snapshots.merge(old, new, KEY).repartition("timeframe", "year", F.pmod(F.xxhash64("symbol"), F.lit(64)))
            .sortWithinPartitions("timeframe", "year", "symbol", "ts"))
    snapshots.replace(spark, path, rows, ["timeframe", "year"])
    return touched().count() - before


def last_timestamps(spark: SparkSession, path: str, timeframe: str) -> DataFrame:
    """symbol, last_ts: where each symbol's history ends, over all symbols of the table at once."""
    return read_bars(spark, path, timeframe=timeframe).groupBy("symbol").agg(F.max("ts").alias("last_ts"))


def last_timestamp(spark: SparkSession, path: str, symbol: str, timeframe: str) -> datetime | None:
    """Where the stored history of one symbol ends. The years are asked first, so that bars of one
    year only are read."""
    d = read_bars(spark, path, symbol, timeframe)
    top = d.agg(F.max("year")).first()[0]
    return None if top is None else d.filter(F.col("year") == top).agg(F.max("ts")).first()[0]
