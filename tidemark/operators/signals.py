"""Trading rules as columns over a bar table, seen from a flat position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.functions import scan
from tidemark.operators.asof import align_higher_timeframe

KEYS = ("symbol",)


def to_confidence(forecast: Column, cap: float = 2.0, floor: float = 0.25) -> Column:
    """Forecast strength as a size in [floor, 1]; nothing to say is 0."""
    strength = F.least(F.abs(forecast) / cap, F.lit(1.0))
    return F.when(forecast.isNull() | (forecast == 0), 0.0).otherwise(F.greatest(strength, F.lit(floor)))


def probability_to_confidence(p: Column, threshold: float = 0.5) -> Column:
    """0 below the threshold, then linear up to 1."""
    scaled = (p - threshold) / max(1.0 - threshold, 1e-9)
    return F.when(p < threshold, 0.0).otherwise(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))


def _position(df: DataFrame, keys) -> DataFrame:
    w = I.by(keys)
    return (df.withColumn("i", F.row_number().over(w) - 1)
            .withColumn("is_last", F.lead("ts").over(w).isNull()))


def _rule(df: DataFrame, side: Column, stop_multiple: float, warmup: int, keys=KEYS) -> DataFrame:
    ok = F.col("atr").isNotNull() & (F.col("atr") > 0)
    return (_position(df, keys).withColumn("side", F.when(ok, side))
            .withColumn("stop_distance", F.when(F.col("side").isNotNull(), F.col("atr") * stop_multiple))
            .withColumn("warmup", F.lit(warmup)))


def trend(bars: DataFrame, lookback: int = 60, span: int = 60, stop: float = 2.5, veto: float | None = 0.95,
          rank: int = 252, keys=KEYS) -> DataFrame:
    """Momentum sign and the side of the EMA must agree; no entry on an extreme ATR."""
    d = I.with_forecast(scan.ema(I.with_atr(bars, 14, "atr", keys), "close", span, "ema", keys), lookback, keys)
    side = (F.when((F.col("mom") > 0) & (F.col("close") > F.col("ema")), 1)
            .when((F.col("mom") < 0) & (F.col("close") < F.col("ema")), -1))
    if veto is not None:
        d = d.withColumn("atr_pct", I.rolling_percentile("atr", rank, keys))
        side = F.when(F.coalesce(F.col("atr_pct") <= veto, F.lit(True)), side)
    return _rule(d, side, stop, max(lookback, span, 14) + 5, keys)


def time_series_momentum(bars: DataFrame, lookback: int = 250, stop: float = 4.0, period_start: Column | None = None,
                         keys=KEYS) -> DataFrame:
    """Sign of the lookback move, decided on the first bar of a period (a month by default)
    and held to the next decision."""
    d = I.with_forecast(I.with_atr(bars, 14, "atr", keys), lookback, keys)
    d = d.withColumn("decides", I.month_start(keys) if period_start is None else period_start)
    sign = F.when(F.col("decides"), F.when(F.col("mom") > 0, 1).when(F.col("mom") < 0, -1))
    d = _rule(d, sign, stop, max(lookback, 14) + 5, keys)
    decision = F.when(F.col("decides"), F.coalesce("side", F.lit(0)))
    held = F.last(decision, True).over(I.by(keys).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("held_side", F.coalesce(held, F.lit(0)))


def carry_forecast(df: DataFrame, smooth: int = 20, norm: int = 252, vol_window: int = 63,
                   mode: str = "own_sd", keys=KEYS) -> DataFrame:
    """Smoothed carry over its own deviation, or over annualised price volatility of the raw level."""
    fill = F.last("carry", True).over(I.by(keys).rowsBetween(Window.unboundedPreceding, 0))
    d = scan.ema(df.withColumn("_raw", fill), "_raw", smooth, "carry_s", keys)
    if mode == "own_sd":
        w = I.trailing(norm, keys)
        sd = I.when_full(F.stddev_samp("_raw").over(w), F.col("_raw"), w, norm // 2)
        return d.withColumn("carry_sd", sd).withColumn("forecast", F.try_divide("carry_s", "carry_sd")).drop("_raw")
    level = F.abs(F.col("raw_close"))
    d = I.price_vol(d, vol_window, "_pv", keys)
    vol = F.try_divide(F.col("_pv") * 252.0 ** 0.5, level)
    return d.withColumn("forecast", F.try_divide(F.col("carry_s"), vol)).drop("_raw", "_pv")


def carry(df: DataFrame, threshold: float = 0.25, stop: float = 2.5, monthly: bool = False, keys=KEYS,
          **forecast) -> DataFrame:
    d = I.with_atr(carry_forecast(df, keys=keys, **forecast), 14, "atr", keys)
    side = F.when(F.abs("forecast") >= threshold, F.signum("forecast").cast("int"))
    if monthly:
        side = F.when(I.month_start(keys), side)
    norm = forecast.get("norm", 252) // 2 if forecast.get("mode", "own_sd") == "own_sd" else forecast.get("vol_window", 63)
    return _rule(d, side, stop, max(norm + forecast.get("smooth", 20), 14) + 5, keys)


def breakout(bars: DataFrame, entry: int = 55, exit: int | None = None, stop: float = 2.0, keys=KEYS) -> DataFrame:
    """Close beyond the entry channel, with flags for the shorter exit channel."""
    exit = exit if exit is not None else max(2, entry // 2)
    d = I.with_atr(bars, 14, "atr", keys)
    (ehi, elo), (xhi, xlo) = I.donchian(entry, keys), I.donchian(exit, keys)
    d = (d.withColumn("entry_hi", ehi).withColumn("entry_lo", elo)
         .withColumn("exit_long", F.coalesce(F.col("close") < xlo, F.lit(False)))
         .withColumn("exit_short", F.coalesce(F.col("close") > xhi, F.lit(False))))
    side = F.when(F.col("close") > F.col("entry_hi"), 1).when(F.col("close") < F.col("entry_lo"), -1)
    return _rule(d, side, stop, max(entry, exit, 14) + 5, keys)


def prior_period_mean(bars: DataFrame, period: Column, cycle: Column, min_cycles: int = 5, keys=KEYS) -> DataFrame:
    """Return of each period (a calendar month), and the mean of the same period over strictly
    earlier cycles (years)."""
    keys = list(keys)
    per = (bars.groupBy(*keys, cycle.alias("cycle"), period.alias("period"))
           .agg(F.min_by("close", "ts").alias("_a"), F.max_by("close", "ts").alias("_b"))
           .withColumn("ret", F.try_divide(F.col("_b") - F.col("_a"), F.abs("_a"))))
    w = Window.partitionBy(*keys, "period").orderBy("cycle").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.count("ret").over(w)
    return per.select(*keys, "cycle", "period", "ret", seen.alias("prior_n"),
                      F.when(seen >= min_cycles, F.avg("ret").over(w)).alias("prior_mean"))


def seasonality(bars: DataFrame, min_years: int = 5, stop: float = 4.0, keys=KEYS) -> DataFrame:
    """On the first bar of a month, the sign of that month's mean over earlier years."""
    m = prior_period_mean(bars, F.month("ts"), F.year("ts"), min_years, keys)
    d = (I.with_atr(bars, 14, "atr", keys).withColumn("cycle", F.year("ts")).withColumn("period", F.month("ts"))
         .join(m, [*keys, "cycle", "period"], "left"))
    side = F.when(I.month_start(keys) & (F.col("prior_mean") != 0), F.signum("prior_mean").cast("int"))
    return _rule(d, side, stop, 252 * min_years + 30, keys)


def buy_and_hold(bars: DataFrame, stop: float = 10.0, keys=KEYS) -> DataFrame:
    return _rule(I.with_atr(bars, 14, "atr", keys), F.lit(1), stop, 16, keys)


def signal_events(ruled: DataFrame, warmup: int | None = None) -> DataFrame:
    """Rows past warm-up, the last bar excepted, where the rule opens from flat."""
    w = F.col("warmup") if warmup is None else F.lit(warmup)
    return ruled.filter(F.col("side").isNotNull() & (F.col("i") >= w) & ~F.col("is_last"))


def filter_by_model(signals: DataFrame, probability: str, regime_scalar: str | None = None,
                    threshold: float = 0.5, min_confidence: float = 0.05) -> DataFrame:
    """Shrink each entry's confidence by regime and conviction; drop what falls to nothing."""
    conviction = probability_to_confidence(F.col(probability), threshold)
    c = F.coalesce(F.col("confidence"), F.lit(1.0))
    if regime_scalar:
        c = c * F.least(F.coalesce(F.col(regime_scalar), F.lit(1.0)), F.lit(1.0))
    return (signals.filter(F.col(probability).isNotNull()).withColumn("ml_confidence", c * conviction)
            .filter((conviction > 0) & (F.col("ml_confidence") > min_confidence)))


# ------------------------------------------------------- multi-timeframe pullback

def bias_frame(htf: DataFrame, span: int = 50, slope: int = 5, keys=KEYS) -> DataFrame:
    """Direction of a higher frame: the side of its EMA, confirmed by the EMA's slope."""
    d = scan.ema(htf, "close", span, "ema", keys).withColumn("_slope", I.change("ema", slope, keys))
    bias = (F.when((F.col("close") > F.col("ema")) & (F.col("_slope") > 0), 1)
            .when((F.col("close") < F.col("ema")) & (F.col("_slope") < 0), -1).otherwise(0))
    return d.select(*keys, "ts", bias.alias("bias"), "ema")


def structure_frame(htf: DataFrame, n: int = 14, keys=KEYS) -> DataFrame:
    return I.with_atr(htf, n, "atr", keys).select(*keys, "ts", "atr")


def mtf_prepare(execution: DataFrame, frames: dict[str, DataFrame], bias_timeframes=("H4", "H1"),
                stop_timeframe: str | None = None, bar_minutes: int = 60, span: int = 20, bias_span: int = 50,
                session=(7, 20), flat_hour: int = 20, all_agree: bool = True, keys=KEYS) -> DataFrame:
    """Execution bars with location, session, runway and the closed higher frames' bias."""
    d = scan.ema(I.with_atr(execution, 14, "atr", keys), "close", span, "ema", keys)
    five = I.trailing(5, keys)
    d = (d.withColumn("ext_atr", F.try_divide(F.col("close") - F.col("ema"), F.col("atr")))
         .withColumn("ext_max_5", F.max("ext_atr").over(five)).withColumn("ext_min_5", F.min("ext_atr").over(five))
         .withColumn("in_session", I.session_mask(*session))
         .withColumn("bars_to_flat", I.bars_until(flat_hour, bar_minutes)))
    if stop_timeframe:
        d = align_higher_timeframe(d, structure_frame(frames[stop_timeframe], 14, keys), stop_timeframe,
                                   ["atr"], "stop", keys)
    else:
        d = d.withColumn("stop_atr", F.col("atr"))
    names = []
    for tf in bias_timeframes:
        d = align_higher_timeframe(d, bias_frame(frames[tf], bias_span, 5, keys), tf, ["bias"], None, keys)
        names.append(F.coalesce(F.col(f"{tf.lower()}_bias"), F.lit(0)))
    if not names:
        return d.withColumn("bias", F.lit(0))
    if all_agree:
        bias = F.when(F.least(*names, F.lit(1)) == 1, 1).when(F.greatest(*names, F.lit(-1)) == -1, -1).otherwise(0)
    else:
        bias = F.signum(sum(names[1:], names[0])).cast("int")
    return d.withColumn("bias", bias)


def trigger(keys=KEYS) -> Column:
    """Momentum resuming in the bias direction, beyond the previous bar."""
    up = (F.col("close") > F.col("open")) & (F.col("close") > I.prev("high", 1, keys))
    down = (F.col("close") < F.col("open")) & (F.col("close") < I.prev("low", 1, keys))
    return F.coalesce(F.when(F.col("bias") > 0, up).when(F.col("bias") < 0, down), F.lit(False))


def mtf_pullback(prepared: DataFrame, max_extension: float = 1.0, min_pullback: float = 0.25,
                 min_bars_before_flat: int = 4, stop: float = 1.5, warmup: int = 60, keys=KEYS) -> DataFrame:
    ext, b = F.col("ext_atr"), F.col("bias")
    back = F.when(b > 0, (F.col("ext_min_5") <= -min_pullback) | (ext < 0)).when(
        b < 0, (F.col("ext_max_5") >= min_pullback) | (ext > 0))
    go = ((b != 0) & F.col("in_session") & (F.col("bars_to_flat") > 2 * min_bars_before_flat)
          & (F.abs(ext) <= max_extension) & back & F.col("_fired") & (F.col("stop_atr") > 0))
    d = prepared.withColumn("_fired", trigger(keys))
    return (_rule(d, F.when(go, b), stop, warmup, keys)
            .withColumn("stop_distance", F.when(F.col("side").isNotNull(), F.col("stop_atr") * stop)).drop("_fired"))
