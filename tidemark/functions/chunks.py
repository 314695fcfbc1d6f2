"""Running computations over keys of any size.

A window partitioned by a key alone puts that key's whole history into one task. Here a key's
rows are cut into chunks that follow the order, so a key that holds a third of the table is
spread over many tasks. Each running function is computed inside (keys, chunk), and what flows
from earlier chunks comes from a summary with one row per (keys, chunk).

Rows ordered by time are cut at clock boundaries, at the widest of a few widths whose fullest
cell is counted to fit a task. If no width fits (a burst, or another kind of order), the rows are
range-partitioned by (keys, order) instead, which balances any distribution; the partition number
is then the chunk id, and the table is checkpointed so that the id stays fixed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize

CHUNK = "_chunk"


#: A chunk summary is broadcast up to this many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 200_000


#: Rows of one key and cell that a task may hold; and the cell widths tried, in seconds.
CELL_ROWS = 4_000_000
CELL_SECONDS = (86_400, 3_600, 60, 1)
BEFORE_TIME = -(1 << 50)


def _cell(ts: str, seconds: int) -> Column:
    """Number of the clock cell; rows without a time come before all others, as they sort."""
    return F.coalesce(F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)), F.lit(BEFORE_TIME)).cast("long")


def _fitting_width(df: DataFrame, keys: Sequence[str], ts: str) -> int | None:
    for seconds in CELL_SECONDS:
        fullest = (df.groupBy(*keys, _cell(ts, seconds).alias(CHUNK)).agg(F.count(F.lit(1)).alias("_n"))
                   .agg(F.max("_n")).first()[0])
        if (fullest or 0) <= CELL_ROWS:
            return seconds
    return None


def cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> tuple[DataFrame, bool]:
    """df with a chunk id, and whether the id is a function of the row (a clock cell). If it is
    not, it holds within one job only: store what is computed from it before reading it twice."""
    if parts is None and isinstance(df.schema[order[0]].dataType, T.TimestampType):
        seconds = _fitting_width(df, keys, order[0])
        if seconds:
            return df.withColumn(CHUNK, _cell(order[0], seconds)), True
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys, *order).withColumn(CHUNK, F.spark_partition_id().cast("long")), False


def ordered_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   parts: int | None = None) -> DataFrame:
    d, fixed = cut(df, keys, order, parts)
    return d if fixed else materialize(d)


def attach(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join a chunk summary where no shuffle by (keys, chunk) is due anyway: the summary is stored
    and counted, and spares the rows a shuffle while it is small."""
    summary = materialize(summary)
    small = summary.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(summary) if small else summary, [*keys, CHUNK], "left")


def _local(keys, order):
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


#: Chunks are summed in runs of 2^12, those in runs of as many again: a prefix tree of three levels.
RUN_BITS, LEVELS = 12, 2


def _combine(kind: str, before: Column, after: Column) -> Column:
    if kind == "sum":
        return F.when(before.isNull(), after).when(after.isNull(), before).otherwise(before + after)
    return F.greatest(before, after) if kind == "max" else F.coalesce(after, before)


def _exclusive(rows: DataFrame, keys, at: str, value: str, kind: str, out: str, levels: int = LEVELS) -> DataFrame:
    """rows (keys, at, value; one per key and `at`) with `out`: the sum, maximum or last known value
    of the key's earlier rows, null if there are none. Runs of rows are combined first and their own
    prefix is found in the same way, so that no window spans all rows, also where there are no keys:
    the topmost one has a row per 2^24 chunks."""
    one = {"sum": F.sum, "max": F.max, "last": lambda v: F.last(v, True)}[kind]
    if not levels:
        w = (Window.partitionBy(*keys).orderBy(at) if keys else Window.orderBy(at)).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(out, one(F.col(value)).over(w))
    run = f"{at}_"
    rows = rows.withColumn(run, F.shiftright(at, RUN_BITS))
    total = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(at))) if kind == "last" else one(F.col(value))
    runs = rows.groupBy(*keys, run).agg(total.alias("_run"))
    runs = _exclusive(runs, keys, run, "_run", kind, f"{out}_", levels - 1).drop("_run")
    w = Window.partitionBy(*keys, run).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("_own", one(F.col(value)).over(w)).join(runs, [*keys, run])
            .withColumn(out, _combine(kind, F.col(f"{out}_"), F.col("_own"))).drop("_own", f"{out}_", run))


def exclusive(summary: DataFrame, keys, value: str, kind: str, out: str) -> DataFrame:
    """A stored chunk summary with the sum, maximum or last known value of the earlier chunks."""
    return _exclusive(summary, keys, CHUNK, value, kind, out)


def _with_carry(chunked, summary, keys):
    return chunked.join(summary, [*keys, CHUNK], "left")


def _carried(summary: DataFrame, keys, value: str, kind: str) -> DataFrame:
    """Stored summary (keys, chunk, value) -> keys, chunk, _carry."""
    return _exclusive(materialize(summary), keys, CHUNK, value, kind, "_carry").drop(value)


def running_lag(chunked: DataFrame, keys, order, value: str, out: str) -> DataFrame:
    """Previous row's value of the same key."""
    ends = chunked.groupBy(*keys, CHUNK).agg(
        F.max_by(F.struct(value), F.struct(*order)).alias("_end"))
    carry = _carried(ends, keys, "_end", "last").withColumn("_carry", F.col("_carry").getField(value))
    w = _local(keys, order)
    return (_with_carry(chunked, carry, keys)
            .withColumn(out, F.when(F.row_number().over(w) == 1, F.col("_carry")).otherwise(F.lag(value).over(w)))
            .drop("_carry"))


def running_last(chunked: DataFrame, keys, order, value: Column | str, out: str) -> DataFrame:
    """Latest non-null value up to and including the row (forward fill)."""
    v = F.col(value) if isinstance(value, str) else value
    ends = (chunked.groupBy(*keys, CHUNK)
            .agg(F.max_by(v, F.when(v.isNotNull(), F.struct(*order))).alias("_end")))
    w = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return (_with_carry(chunked, _carried(ends, keys, "_end", "last"), keys)
            .withColumn(out, F.coalesce(F.last(v, True).over(w), F.col("_carry")))
            .drop("_carry"))


def running_sum(chunked: DataFrame, keys, order, value: Column | str, out: str) -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    sums = chunked.groupBy(*keys, CHUNK).agg(F.sum(v).alias("_sum"))
    w = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return (_with_carry(chunked, _carried(sums, keys, "_sum", "sum"), keys)
            .withColumn(out, F.sum(v).over(w) + F.coalesce(F.col("_carry"), F.lit(0)))
            .drop("_carry"))


def running_max(chunked: DataFrame, keys, order, value: Column | str, out: str) -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    tops = chunked.groupBy(*keys, CHUNK).agg(F.max(v).alias("_max"))
    w = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return (_with_carry(chunked, _carried(tops, keys, "_max", "max"), keys)
            .withColumn(out, F.greatest(F.max(v).over(w), F.col("_carry"))).drop("_carry"))


def running_row_number(chunked: DataFrame, keys, order, out: str, total: str | None = None) -> DataFrame:
    """1-based position within the key, and optionally the key's row count."""
    counts = materialize(chunked.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n")))
    carry = _exclusive(counts, keys, CHUNK, "_n", "sum", "_carry").drop("_n")
    d = (_with_carry(chunked, carry, keys)
         .withColumn(out, F.row_number().over(_local(keys, order)) + F.coalesce(F.col("_carry"), F.lit(0)))
         .drop("_carry"))
    if not total:
        return d
    all_rows = counts.groupBy(*keys).agg(F.sum("_n").alias(total))
    return d.join(all_rows, list(keys)) if keys else d.withColumn(total, all_rows.scalar())


def array_split_id(position: Column, total: Column, k: int) -> Column:
    """0-based block of a 1-based position when n rows are cut into k blocks, larger blocks first."""
    base, extra = F.floor(total / k), total % k
    head = extra * (base + 1)
    z = position - 1
    return F.when(z < head, F.floor(z / (base + 1))).otherwise(
        extra + F.floor((z - head) / F.greatest(base, F.lit(1)))).cast("int")
