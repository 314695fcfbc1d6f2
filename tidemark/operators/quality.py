"""Checks on bar tables: they count, classify and report, and never repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import chunks
from tidemark.operators.asof import TIMEFRAMES

BAR_COLUMNS = ["ts", "open", "high", "low", "close", "volume"]
OHLC = ["open", "high", "low", "close"]


class DataError(ValueError):
    """The data is wrong."""


def _count(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))


def validate_counts(df: DataFrame, keys=("symbol",), ingest: str | None = None) -> DataFrame:
    """One row per key with a counter per defect. `ingest` names the arrival sequence; with
    it rows that arrive with an earlier time than their predecessor count as unsorted."""
    keys = list(keys)
    missing = [c for c in BAR_COLUMNS if c not in df.columns]
    if missing:
        raise DataError(f"missing columns {missing}")
    nulls, low_price = F.lit(False), F.lit(False)
    for c in OHLC:
        nulls = nulls | F.col(c).isNull()
        low_price = low_price | (F.col(c) <= 0)
    outside = ((F.col("open") > F.col("high")) | (F.col("open") < F.col("low"))
               | (F.col("close") > F.col("high")) | (F.col("close") < F.col("low")))
    out = (df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), _count(nulls).alias("null_ohlc"),
        _count(low_price).alias("nonpositive"), _count(F.col("high") < F.col("low")).alias("high_below_low"),
        _count(outside).alias("outside_range")))
    slots = df.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("_n"))
    dupes = slots.groupBy(*keys).agg(F.sum(F.col("_n") - 1).alias("duplicate_ts"))
    out = out.join(dupes, keys)
    if ingest:
        c = chunks.ordered_chunks(df.select(*keys, ingest, "ts"), keys, [ingest])
        c = chunks.running_lag(c, keys, [ingest], "ts", "_prev")
        out = out.join(c.groupBy(*keys).agg(_count(F.col("ts") < F.col("_prev")).alias("unsorted")), keys)
    return out


def require_valid(df: DataFrame, keys=("symbol",), allow_nonpositive: bool = False) -> None:
    """Raise on the first keys whose bars would corrupt what is computed from them."""
    bad = F.col("null_ohlc") + F.col("high_below_low") + F.col("outside_range") + F.col("duplicate_ts")
    if not allow_nonpositive:
        bad = bad + F.col("nonpositive")
    found = validate_counts(df, keys).filter(bad > 0).limit(5).collect()
    if found:
        raise DataError("; ".join(str(r.asDict()) for r in found))


def with_gap(df: DataFrame, timeframe: str, keys=("symbol",)) -> DataFrame:
    """Rows that follow a hole: last bar before it, first bar after it, bars missing."""
    step = TIMEFRAMES[timeframe] * 60
    before = F.lag("ts").over(Window.partitionBy(*keys).orderBy("ts"))
    d = df.select(*keys, before.alias("gap_start"), F.col("ts").alias("gap_end"))
    secs = F.unix_timestamp("gap_end") - F.unix_timestamp("gap_start")
    return d.withColumn("missing_bars", (F.floor(secs / step) - 1).cast("long"))


def find_gaps(df: DataFrame, timeframe: str, min_missing: int = 1, keys=("symbol",)) -> DataFrame:
    return with_gap(df, timeframe, keys).filter(F.col("missing_bars") >= min_missing)


def gap_kind() -> Column:
    """Friday to Sunday or Monday is a weekend; up to two hours from 20:00 on is the rollover."""
    weekend = (F.weekday("gap_start") == 4) & F.weekday("gap_end").isin(6, 0)
    secs = F.unix_timestamp("gap_end") - F.unix_timestamp("gap_start")
    rollover = (secs <= 7200) & (F.hour("gap_start") >= 20)
    return F.when(weekend, "weekend").when(rollover, "rollover").otherwise("GAP")


def coverage(df: DataFrame, keys=("symbol",)) -> DataFrame:
    span = F.floor((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 86400)
    return df.groupBy(*keys).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                                 F.count(F.lit(1)).alias("rows"), span.cast("long").alias("span_days"))


def store_report(df: DataFrame, timeframe: str, keys=("symbol",)) -> DataFrame:
    """Coverage, gap counts and the share of calendar bars present."""
    keys = list(keys)
    step = TIMEFRAMES[timeframe] * 60
    gaps = (find_gaps(df, timeframe, 1, keys).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("gaps"), _count(gap_kind() == "GAP").alias("unexplained")))
    expected = F.floor((F.unix_timestamp("last_ts") - F.unix_timestamp("first_ts")) / step) + 1
    return (coverage(df, keys).join(gaps, keys, "left").fillna(0, ["gaps", "unexplained"])
            .withColumn("density", F.col("rows") / expected))


def worst_gaps(df: DataFrame, timeframe: str, n: int = 10, keys=("symbol",)) -> DataFrame:
    """The n widest unexplained gaps of every key."""
    g = find_gaps(df, timeframe, 1, keys).withColumn("kind", gap_kind()).filter(F.col("kind") == "GAP")
    w = Window.partitionBy(*keys).orderBy(F.desc("missing_bars"), "gap_start")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def session_profile(df: DataFrame, keys=("symbol",)) -> DataFrame:
    """Earliest Sunday hour, latest Friday hour and the busiest hour, from hour-level counts."""
    keys = list(keys)
    cell = df.groupBy(*keys, F.weekday("ts").alias("wd"), F.hour("ts").alias("hr")).agg(F.count(F.lit(1)).alias("n"))
    hours = cell.groupBy(*keys, "hr").agg(F.sum("n").alias("n"))
    busiest = hours.groupBy(*keys).agg(F.max_by("hr", F.struct("n", -F.col("hr"))).alias("busiest_hour"))
    edges = cell.groupBy(*keys).agg(
        F.sum("n").alias("bars"),
        F.min(F.when(F.col("wd") == 6, F.col("hr"))).alias("first_sunday_hour"),
        F.max(F.when(F.col("wd") == 4, F.col("hr"))).alias("last_friday_hour"),
        F.sum(F.when(F.col("wd") >= 5, F.col("n")).otherwise(0)).alias("weekend_bars"))
    return edges.join(busiest, keys)


def merge_sunday_stubs(df: DataFrame, keys=("symbol",)) -> DataFrame:
    """Fold a Sunday bar into the bar of the next day; a Sunday with no Monday stays."""
    w = Window.partitionBy(*keys).orderBy("ts")
    next_day = F.datediff(F.to_date(F.lead("ts").over(w)), F.to_date("ts")) == 1
    d = df.withColumn("_stub", F.coalesce((F.weekday("ts") == 6) & next_day, F.lit(False)))
    p = F.lag(F.struct("_stub", *BAR_COLUMNS)).over(w)
    d = d.withColumn("_p", p).filter(~F.col("_stub"))
    fold = F.coalesce(F.col("_p._stub"), F.lit(False))
    return (d.withColumn("open", F.when(fold, F.col("_p.open")).otherwise(F.col("open")))
            .withColumn("high", F.when(fold, F.greatest("high", F.col("_p.high"))).otherwise(F.col("high")))
            .withColumn("low", F.when(fold, F.least("low", F.col("_p.low"))).otherwise(F.col("low")))
            .withColumn("volume", F.when(fold, F.col("volume") + F.col("_p.volume")).otherwise(F.col("volume")))
            .drop("_p", "_stub"))


def lookahead_audit(op, df: DataFrame, cut, keys: list[str], value: str) -> DataFrame:
    """Recompute `op` on data up to `cut`; rows at or before it must not change."""
    full = op(df).filter(F.col("ts") <= F.lit(cut)).select(*keys, F.col(value).alias("_full"))
    part = op(df.filter(F.col("ts") <= F.lit(cut))).select(*keys, F.col(value).alias("_part"))
    same = F.col("_full").eqNullSafe(F.col("_part")) | (
        F.abs(F.col("_full") - F.col("_part")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(F.col("_full"))))
    return full.join(part, keys, "full_outer").agg(
        F.count(F.lit(1)).alias("rows_compared"), _count(~F.coalesce(same, F.lit(False))).alias("mismatches"))
