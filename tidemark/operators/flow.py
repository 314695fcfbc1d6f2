"""Order-flow research on prints and delta bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import chunks
from tidemark.functions import indicators as I
from tidemark.operators import bars as B
from tidemark.operators import quantiles
from tidemark.session import materialize

KEYS = ["symbol"]


def with_crossing(prints: DataFrame, max_seconds: float = 1.0, keys=KEYS) -> DataFrame:
    """Per print, the price change from its predecessor where the two sit on opposite sides, close
    in time; else null.

    Prints signed with their predecessor at hand are only read; others are put in order first."""
    if "prev_ts" not in prints.columns:
        order = B.PRINT_ORDER
        c = chunks.ordered_chunks(prints.withColumn("_row", F.struct("ts", "price", "side")), list(keys), order)
        c = chunks.running_lag(c, list(keys), order, "_row", "_prev")
        prints = c.select(*prints.columns, *[F.col(f"_prev.{x}").alias(f"prev_{x}") for x in ("ts", "price", "side")])
    secs = (F.unix_micros("ts") - F.unix_micros("prev_ts")) / 1e6
    move = F.abs(F.col("price") - F.col("prev_price"))
    flip = (F.abs(F.col("side") - F.col("prev_side")) == 2) & (secs <= max_seconds) & (move > 0)
    return prints.select(*keys, F.when(flip, move).alias("crossing"))


def measured_spread(prints: DataFrame, max_seconds: float = 1.0, min_crossings: int = 1000, keys=KEYS) -> DataFrame:
    """Median crossing per key; null unless more than min_crossings were seen.

    Prints are reduced once to how often each crossing occurs; counts and median read that."""
    keys = list(keys)
    seen = materialize(with_crossing(prints, max_seconds, keys).groupBy(*keys, "crossing").agg(F.count(F.lit(1)).alias("n")))
    g = seen.groupBy(*keys).agg(F.sum("n").alias("prints"),
                                F.sum(F.when(F.col("crossing").isNotNull(), F.col("n")).otherwise(0)).alias("crossings"))
    med = quantiles.exact_quantile(seen, keys, "crossing", 0.5, "_med", times="n")
    return (g.join(med, keys, "left")
            .select(*keys, "prints", "crossings", F.when(F.col("crossings") > min_crossings, F.col("_med")).alias("spread")))


def weighted_spread(per_key: DataFrame, commission_points: float) -> DataFrame:
    """Print-weighted spread over contracts, plus commission both ways: the round trip."""
    w = F.when(F.col("spread").isNotNull(), F.col("prints"))
    s = F.try_divide(F.sum(F.col("spread") * F.col("prints")), F.sum(w))
    return per_key.agg(s.alias("spread")).withColumn("round_trip", F.col("spread") + 2 * commission_points)


def bar_observations(bars: DataFrame, name: str, signal, burn_in: int = 50, keys=KEYS) -> DataFrame:
    """Signal at a bar's close against the next bar's move in ATR; nothing crosses a contract."""
    w = I.by(keys)
    d = I.with_atr(bars, 14, "atr", keys)
    sig = F.when(F.row_number().over(w) <= burn_in, 0.0).otherwise(F.coalesce(signal.cast("double"), F.lit(0.0)))
    fwd = F.try_divide(F.lead("close").over(w) - F.col("close"), F.col("atr"))
    return (d.select(F.lit(name).alias("name"), *keys, "ts", sig.alias("sig"), fwd.alias("fwd"))
            .filter(F.col("fwd").isNotNull()))


def session_observations(bars: DataFrame, open_minute: int = 810, close_minute: int = 1200, window: int = 30,
                         keys=KEYS) -> DataFrame:
    """Opening delta sign against the clock-time move to the close; incomplete sessions drop."""
    m = B.minute_of_day()
    d = I.with_atr(bars, 14, "atr", keys)

    def at(minute, c):
        return F.max(F.when(m == minute, F.col(c)))

    entry = open_minute + window
    g = d.groupBy(*keys, F.to_date("ts").alias("day")).agg(
        F.sum(F.when((m >= open_minute) & (m < entry), F.col("delta"))).alias("_delta"),
        at(entry, "ts").alias("ts"), at(entry, "close").alias("_in"), at(entry, "atr").alias("_atr"),
        at(close_minute, "close").alias("_out"))
    return (g.filter(F.col("_delta").isNotNull() & F.col("_in").isNotNull() & F.col("_out").isNotNull()
                     & (F.col("_atr") > 0))
            .select(*keys, "day", "ts", F.signum("_delta").alias("sig"),
                    ((F.col("_out") - F.col("_in")) / F.col("_atr")).alias("fwd")))


def spread_by_minute(quotes: DataFrame, anchor_hour: int, before: int = 10, after: int = 70, keys=KEYS) -> DataFrame:
    """Median spread by minute relative to a daily anchor."""
    offset = B.minute_of_day() - anchor_hour * 60
    d = quotes.withColumn("minute_offset", offset).filter(F.col("minute_offset").between(-before, after - 1))
    return quantiles.exact_median(d, [*keys, "minute_offset"], F.col("spread"), "median_spread")


def spread_profile(quotes: DataFrame, keys=KEYS) -> DataFrame:
    """Median spread by UTC hour with the cheapest and worst hours."""
    d = quotes.withColumn("hour", F.hour("ts"))
    med = quantiles.exact_median(d, [*keys, "hour"], F.col("spread"), "median_spread")
    n = d.groupBy(*keys, "hour").agg(F.count(F.lit(1)).alias("samples"))
    w = Window.partitionBy(*keys)
    return (med.join(n, [*keys, "hour"])
            .withColumn("cheapest_hour", F.min_by("hour", F.struct("median_spread", "hour")).over(w))
            .withColumn("worst_hour", F.max_by("hour", F.struct("median_spread", -F.col("hour"))).over(w)))
