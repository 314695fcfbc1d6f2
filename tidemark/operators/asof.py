"""Backward as-of joins: each left row meets the latest right row known at its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import chunks

#: The eight bar sizes, in minutes.
TIMEFRAMES = {"M1": 1, "M5": 5, "M15": 15, "M30": 30, "H1": 60, "H4": 240, "D1": 1440, "W1": 10080}


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str,
              calendar_bounded: bool = False) -> DataFrame:
    """Left rows plus the right columns of the newest right row with right_on <= left_on.

    Right columns travel as one struct, so a matched row whose values are null is kept as
    the match. Both sides are sorted together once. With calendar_bounded the caller states
    that a key holds at most one row per time slot and side; otherwise the rows are chunked."""
    carried = [c for c in right.columns if c not in by]
    kept = [c for c in left.columns if c not in by]
    l = left.select(*by, F.struct(*kept).alias("_l"), F.col(left_on).alias("_t"), F.lit(1).alias("_side"))
    r = right.filter(F.col(right_on).isNotNull()).select(
        *by, F.struct(*carried).alias("_r"), F.col(right_on).alias("_t"), F.lit(0).alias("_side"))
    both = l.unionByName(r, allowMissingColumns=True)
    order = ["_t", "_side"]
    if calendar_bounded:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("_m", F.last("_r", True).over(w))
    else:
        both = chunks.running_last(chunks.ordered_chunks(both, by, order), by, order, "_r", "_m")
    return (both.filter(F.col("_side") == 1)
            .select(*by, *[F.col("_l").getField(c).alias(c) for c in kept],
                    *[F.col("_m").getField(c).alias(c) for c in carried if c not in kept]))


def align_higher_timeframe(execution: DataFrame, htf: DataFrame, timeframe: str, columns: list[str] | None = None,
                           prefix: str | None = None, keys=("symbol",)) -> DataFrame:
    """Attach higher-frame columns, visible only once that bar has closed."""
    minutes = TIMEFRAMES[timeframe]
    columns = columns or [c for c in htf.columns if c != "ts" and c not in keys]
    missing = [c for c in columns if c not in htf.columns]
    if missing:
        raise KeyError(f"higher-timeframe frame is missing {missing}")
    p = (prefix or timeframe).lower() + "_"
    closed = htf.select(*keys, (F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTES")).alias("_available_at"),
                        *[F.col(c).alias(p + c) for c in columns])
    return asof_join(execution, closed, list(keys), "ts", "_available_at",
                     calendar_bounded=True).drop("_available_at")
