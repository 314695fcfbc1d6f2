"""Windowed aggregates of a stream, and their open windows.

A stream in append mode emits a window once the watermark has passed its end; what is open when the
stream ends stays in the state. A `Windowed` aggregate is made of parts whose state is their own
value, so the open windows are read from the state store and finished like the closed ones: closed
and open ones together are the aggregate of the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A part: how it is aggregated, of what, and for first and last in which order.
Part = tuple


def _aggregate(kind: str, value: Column, order: Column | None = None) -> Column:
    if kind in ("first", "last"):
        return (F.min_by if kind == "first" else F.max_by)(value, order)
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[kind](value)


class Windowed:
    """`rows` by `window` (of the event time `ts`) and `keys`; `finish` turns keys, the window `w` and
    the parts into result columns. What runs as a stream to be closed later is `grouped`: a projection
    would be merged into the aggregate and change the order of its state."""

    def __init__(self, rows: DataFrame, window: Column, keys: list[str], lateness: str, parts: dict[str, Part],
                 finish: Callable[[DataFrame], DataFrame]):
        self.keys, self.parts, self.finish = keys, parts, finish
        self.grouped = rows.withWatermark("ts", lateness).groupBy(window.alias("w"), *keys).agg(
            *[_aggregate(*p).alias(name) for name, p in parts.items()])
        self.frame = finish(self.grouped)

    def closing(self, spark: SparkSession, checkpoint: str) -> DataFrame:
        """The windows that were open when the stream ended, up to their last row."""
        state = spark.read.format("statestore").load(checkpoint)
        session = "sessionStartTime" in state.schema["key"].dataType.names
        value = state.schema["value"].dataType.fields
        kept, at = [], (1 + len(self.keys)) if session else 0
        for kind, *_ in self.parts.values():
            kept.append(at)
            at += 2 if kind in ("first", "last") else 1  # with its order
        if at != len(value) or any(f.dataType == T.DecimalType() for f in value):
            raise ValueError("the state holds other parts than the aggregate")
        plain = T.StructType([T.StructField(f"_{i}", f.dataType) for i, f in enumerate(value)])
        of = lambda i: F.col(f"_v._{i}")
        window = of(0) if session else F.col("key.window")
        cols = [window.alias("w"), *[F.col(f"key.{k}").alias(k) for k in self.keys], *[of(i).alias(name) for name, i in zip(self.parts, kept)]]
        return self.finish(state.withColumn("_v", F.col("value").cast(plain)).select(*cols))
