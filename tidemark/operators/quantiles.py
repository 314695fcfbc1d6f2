"""Exact quantiles of groups of any size.

The built-in exact percentile holds a group's distinct values in one task. Here values are
counted first, then the wanted rank is located in two rounds of buckets (by magnitude, then
linearly inside the bucket), and only the values of the last bucket are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_OCTAVE = 64
SUB_BUCKETS = 65536


def _magnitude(v: Column) -> Column:
    """A monotone bucket number with a fixed range whatever the values are."""
    a = F.abs(v)
    g = F.floor(F.log2(F.when(a > 0, a)) * PER_OCTAVE) + 1100 * PER_OCTAVE
    return F.when(v == 0, 0).otherwise(F.signum(v).cast("long") * g).cast("long")


def exact_quantile(df: DataFrame, keys: list[str], value: Column | str, q: float | Column, out: str,
                   times: str | None = None) -> DataFrame:
    """Linearly interpolated quantile per key, one row per key that has a value. `times` names a
    column that says how often each row counts."""
    v = F.col(value) if isinstance(value, str) else value
    if not keys:
        return exact_quantile(df.withColumn("_all", F.lit(0)), ["_all"], v, q, out, times).drop("_all")
    n = F.sum(times) if times else F.count(F.lit(1))
    counts = (df.filter(v.isNotNull()).groupBy(*keys, v.cast("double").alias("_v"))
              .agg(n.alias("_c")).withColumn("_g", _magnitude(F.col("_v"))))
    lo, hi = F.floor((F.col("_n") - 1) * q), F.ceil((F.col("_n") - 1) * q)

    def holds(rank):
        return (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_c"))

    def before(group, order):
        w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_c").over(w), F.lit(0))

    first = (counts.groupBy(*keys, "_g")
             .agg(F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
             .withColumn("_before", before(keys, "_g"))
             .withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
             .filter(holds(lo) | holds(hi))
             .select(*keys, "_g", "_lo", "_hi", F.col("_before").alias("_base"), "_n"))
    span = F.col("_hi") - F.col("_lo")
    inside = counts.join(first, [*keys, "_g"]).withColumn(
        "_s", F.when(span > 0, F.floor((F.col("_v") - F.col("_lo")) / span * SUB_BUCKETS)).otherwise(0))
    second = (inside.groupBy(*keys, "_g", "_s", "_base", "_n").agg(F.sum("_c").alias("_c"))
              .withColumn("_before", F.col("_base") + before([*keys, "_g"], "_s"))
              .filter(holds(lo) | holds(hi))
              .select(*keys, "_g", "_s", F.col("_before").alias("_base2")))
    last = (inside.join(second, [*keys, "_g", "_s"])
            .withColumn("_before", F.col("_base2") + before([*keys, "_g", "_s"], "_v")))
    at = (F.col("_n") - 1) * q - lo
    return (last.groupBy(*keys, "_n")
            .agg(F.max(F.when(holds(lo), F.col("_v"))).alias("_a"), F.max(F.when(holds(hi), F.col("_v"))).alias("_b"))
            .select(*keys, (F.col("_a") + at * (F.col("_b") - F.col("_a"))).alias(out)))


def exact_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column | str, float]]) -> DataFrame:
    """Quantiles of several columns, `wanted` being out -> (value, q), in shared exchanges: the
    number of a quantile is one more key, and its q travels with it. One row per key that has any of the values (without keys always one row); a quantile
    without values is null. A value that is null where a row does not count serves as a filter."""
    each = [F.struct(F.lit(i).alias("of"), F.lit(float(q)).alias("q"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("v"))
            for i, (v, q) in enumerate(wanted.values())]
    rows = (df.select(*keys, F.explode(F.array(*each)).alias("_e"))
            .select(*keys, F.col("_e.of").alias("_of"), F.col("_e.q").alias("_q"), F.col("_e.v").alias("_x")))
    found = exact_quantile(rows, [*keys, "_of", "_q"], "_x", F.col("_q"), "_at")
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_of") == i, F.col("_at"))).alias(out) for i, out in enumerate(wanted)])


def exact_median(df: DataFrame, keys: list[str], value: Column | str, out: str) -> DataFrame:
    return exact_quantile(df, keys, value, 0.5, out)
