"""Friction: spreads, slippage, commission, overnight financing, and their calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import quantiles

ROLLOVER_HOUR = 21
#: Slippage below this share of the spread is an artefact of a venue that fills at the quote.
MIN_CREDIBLE_SLIP_RATIO = 0.05


def with_specs(df: DataFrame, dim: DataFrame, key: str = "symbol") -> DataFrame:
    """Join a dimension that must cover every row: an unknown key is an error, never free.

    The failure is raised by the job that computes the join."""
    d = df.join(dim.withColumn("_known", F.lit(True)), key, "left")
    guard = F.when(F.col("_known"), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("no cost model for "), F.col(key).cast("string"))).cast("boolean"))
    return d.filter(guard).drop("_known")


def entry_cost(at_open: Column | None = None, stress: float = 1.0) -> Column:
    """Half the spread, widened at a session open, plus slippage."""
    wide = F.col("spread") if at_open is None else F.col("spread") * F.when(at_open, F.col("spread_multiple_at_open")).otherwise(1.0)
    return (wide / 2.0 + F.col("slippage")) * stress


def fill_price(reference: Column, side: Column, at_open: Column | None = None, stress: float = 1.0) -> Column:
    return reference + entry_cost(at_open, stress) * side


def round_trip(stress: float = 1.0) -> Column:
    return 2.0 * entry_cost(None, stress)


def round_trip_cash(volume: Column, value_per_unit: Column, stress: float = 1.0) -> Column:
    return round_trip(stress) * volume * value_per_unit + 2.0 * F.col("commission") * volume * stress


def edge_ratio(expected_move: Column) -> Column:
    return F.try_divide(expected_move, round_trip())


def _day_number(d: Column) -> Column:
    return F.unix_date(d)


def _weekday_count(first: Column, last: Column, weekday: Column) -> Column:
    """Days of one weekday (Monday = 0) in [first, last], both day numbers since 1970-01-01."""
    shift = F.lit(3) - weekday  # day 0 was a Thursday
    return F.floor((last + shift) / 7) - F.floor((first - 1 + shift) / 7)


def swap_nights(entry: str, exit: str, triple_weekday: Column) -> Column:
    """Rollovers after the entry and up to the exit, the triple weekday counted three times."""
    after = F.hour(entry) * 3600 + F.minute(entry) * 60 + F.second(entry) >= ROLLOVER_HOUR * 3600
    reached = F.hour(exit) >= ROLLOVER_HOUR
    first = _day_number(F.to_date(entry)) + F.when(after, 1).otherwise(0)
    last = _day_number(F.to_date(exit)) - F.when(reached, 0).otherwise(1)
    n = last - first + 1
    return F.when(n > 0, n + 2 * _weekday_count(first, last, triple_weekday)).otherwise(0).cast("long")


def swap_rate(is_long: Column, price: Column, value_per_unit: Column) -> Column:
    """Cash per lot and night, converted from the unit each symbol is quoted in."""
    rate = F.when(is_long, F.col("swap_long")).otherwise(F.col("swap_short"))
    mode = F.col("swap_mode")
    return (F.when((rate == 0) | (mode == 0), 0.0)
            .when(mode == 1, rate * F.col("point") * value_per_unit)
            .when(mode.isin(5, 6, 7, 8), rate / 100.0 * price * F.col("contract_size") / 360.0)
            .otherwise(rate))


def swap_cash(is_long: Column, price: Column, value_per_unit: Column, volume: Column, nights: Column,
              stress: float = 1.0) -> Column:
    """Financing as a positive cost."""
    return -swap_rate(is_long, price, value_per_unit) * volume * nights * stress


def futures_costs(roots: DataFrame, spread_ticks: float = 1.0, slippage_ticks: float = 0.5) -> DataFrame:
    """Costs in price units from tick sizes; futures carry no financing."""
    return roots.select(F.col("root").alias("symbol"), (F.col("tick_size") * spread_ticks).alias("spread"),
                        (F.col("tick_size") * slippage_ticks).alias("slippage"), F.col("commission"),
                        F.lit(2.0).alias("spread_multiple_at_open"))


def stress_sweep(trades: DataFrame, keys: list[str], factors: list[float]) -> DataFrame:
    """Expectancy and net result at multiples of the charged costs, and the share that survives."""
    k = F.explode(F.array(*[F.lit(float(f)) for f in factors])).alias("factor")
    t = trades.select(*keys, "gross_pnl", "costs", "risk_cash", k)
    net = F.col("gross_pnl") - F.col("factor") * F.col("costs")
    g = t.groupBy(*keys, "factor").agg(
        F.count(F.lit(1)).alias("trades"), F.sum(net).alias("net_pnl"),
        F.avg(F.when(F.col("risk_cash") != 0, net / F.nullif("risk_cash", F.lit(0.0))).otherwise(0.0)).alias("expectancy_r"))
    base = (g.filter(F.col("factor") == 1.0).select(*keys, F.col("expectancy_r").alias("_b")))
    survival = F.when(F.col("_b") > 0, F.col("expectancy_r") / F.nullif("_b", F.lit(0.0))).otherwise(0.0)
    return g.join(base, keys).withColumn("survival", survival).drop("_b")


def calibrate(fills: DataFrame, quotes: DataFrame, baseline: DataFrame, min_fills: int = 2, min_quotes: int = 30) -> DataFrame:
    """Fitted spread and slippage per symbol, with what was refused and why.

    Quoted spreads are preferred once there are enough; a zero spread or an implausibly small
    slippage keeps the assumption. Medians are exact at any size. Symbols of the baseline that
    nothing measured are reported as such."""
    key = ["symbol"]
    fn = fills.groupBy("symbol").agg(F.count(F.lit(1)).alias("fills"), F.count("slippage").alias("_slips"))
    qn = quotes.groupBy("symbol").agg(F.count("spread").alias("quotes"))
    seen = (fills.select("symbol", F.col("spread").alias("_f"), F.abs("slippage").alias("_s"), F.lit(None).cast("double").alias("_q"))
            .unionByName(quotes.select("symbol", F.lit(None).cast("double").alias("_f"), F.lit(None).cast("double").alias("_s"),
                                       F.col("spread").alias("_q"))))
    medians = quantiles.exact_quantiles(seen, key, {"_fs": ("_f", 0.5), "_ss": ("_s", 0.5), "_qs": ("_q", 0.5)})
    b = baseline.select("symbol", F.col("spread").alias("_bs"), F.col("slippage").alias("_bl"))
    d = fn.join(qn, key, "full_outer").join(b, key, "full_outer").join(medians, key, "left")
    d = d.fillna(0, ["fills", "quotes", "_slips"])
    use_quotes = F.col("quotes") >= min_quotes
    spread = F.when(use_quotes, F.col("_qs")).otherwise(F.col("_fs"))
    none = (F.col("fills") == 0) & (F.col("quotes") == 0)
    thin = spread.isNull() | ((F.col("quotes") == 0) & (F.col("fills") < min_fills))
    spread_ok = ~none & ~thin & (spread > 0)
    ratio = F.try_divide(F.col("_ss"), spread)
    slip_ok = spread_ok & (F.col("_slips") > 0) & (F.col("_ss") > 0) & (ratio >= MIN_CREDIBLE_SLIP_RATIO)
    note = (F.when(none, "never measured").when(thin, "too few observations").when(spread <= 0, "spread is zero")
            .when(F.col("_slips") == 0, "no slippage observations").when(F.col("_ss") <= 0, "slippage is zero")
            .when(ratio < MIN_CREDIBLE_SLIP_RATIO, "slippage implausibly small").otherwise("measured"))
    return d.select("symbol", "fills", "quotes",
                    F.when(spread_ok, spread).otherwise(F.col("_bs")).alias("spread"),
                    F.when(slip_ok, F.col("_ss")).otherwise(F.col("_bl")).alias("slippage"),
                    F.coalesce(spread_ok, F.lit(False)).alias("spread_calibrated"),
                    F.coalesce(slip_ok, F.lit(False)).alias("slippage_calibrated"), note.alias("note"))
