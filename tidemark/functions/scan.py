"""Recursive smoothing as windows.

y[t] = (1-a) y[t-1] + a x[t] is split into blocks of rows. Inside a block the zero-state answer
is (1-a)^k * sum(a x[j] (1-a)^-j), a plain running sum. A block is long enough that the state
entering it has decayed by 1e-40 when it ends, so the state entering the next block is that
running sum's last value, to double precision. The first block starts from the first value.
No row is joined to another: one shuffle by key, then sorts inside it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECADES = 40


def ewm(df: DataFrame, value: Column | str, alpha: float, min_periods: int, out: str,
        keys=("symbol",), order=("ts",)) -> DataFrame:
    """Exponentially weighted mean in its recursive form, seeded by the first non-null value.

    Nulls may only precede the first value."""
    x = F.col(value) if isinstance(value, str) else value
    keys, decay = list(keys), 1.0 - alpha
    if decay <= 0:
        return df.withColumn(out, x)
    rate = -math.log(decay)
    length = max(1, math.ceil(DECADES * math.log(10) / rate))

    by_key = Window.partitionBy(*keys).orderBy(*order)
    so_far = by_key.rowsBetween(Window.unboundedPreceding, 0)
    rows = (df.withColumn("_x", x).withColumn("_pos", F.count("_x").over(so_far) - 1)
            .withColumn("_seed", F.first("_x", True).over(so_far))
            .withColumn("_blk", F.floor(F.col("_pos") / length))
            .withColumn("_k", F.pmod(F.col("_pos"), F.lit(length)) + 1))
    in_block = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_s", F.sum(F.lit(alpha) * F.col("_x") * F.exp(F.col("_k") * rate)).over(in_block))
    end = F.when((F.col("_k") == length) & (F.col("_pos") >= 0), F.col("_s") * math.exp(-length * rate))
    rows = rows.withColumn("_in", F.last(end, True).over(by_key.rowsBetween(Window.unboundedPreceding, -1)))
    state = F.when(F.col("_blk") <= 0, F.col("_seed")).otherwise(F.col("_in"))
    y = F.exp(-F.col("_k") * rate) * (state + F.col("_s"))
    return (rows.withColumn(out, F.when(F.col("_pos") + 1 >= min_periods, y))
            .drop("_x", "_pos", "_seed", "_blk", "_k", "_s", "_in"))


def ema(df, value, span: int, out: str, keys=("symbol",), order=("ts",)) -> DataFrame:
    return ewm(df, value, 2.0 / (span + 1), span, out, keys, order)
