"""Scalar rules on columns: contract arithmetic, clocks, identifiers, sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- contracts

def value_per_unit() -> Column:
    """Cash per lot for a move of 1.0 in price."""
    return F.col("tick_value") / F.col("tick_size")


def risk_for(volume, stop_distance) -> Column:
    return _c(volume) * _c(stop_distance) * value_per_unit()


def min_stop_distance() -> Column:
    return F.col("stops_level_points") * F.col("point")


def normalize_price(price) -> Column:
    """Round to the symbol's own number of digits, halves to the even neighbour."""
    scale = F.pow(F.lit(10.0), F.col("digits"))
    return F.bround(_c(price) * scale, 0) / scale


def round_volume(volume) -> Column:
    """Down to the step: rounding up would exceed the risk just computed."""
    v = _c(volume)
    steps = F.floor(v / F.col("volume_step") + 1e-9)
    return F.when(v > 0, F.round(steps * F.col("volume_step"), 8)).otherwise(0.0)


def size_positions(df: DataFrame, max_volume: str | None = None) -> DataFrame:
    """Volatility-scaled size with its outcome; df carries equity, risk_fraction, stop_distance,
    the spec columns, and optionally regime_scalar and confidence."""
    scale = F.lit(1.0)
    for c in ("regime_scalar", "confidence"):
        if c in df.columns:
            scale = scale * F.greatest(F.col(c), F.lit(0.0))
    budget = F.col("equity") * F.col("risk_fraction") * scale
    valid = ((F.col("equity") > 0) & (F.col("stop_distance") > 0) & (F.col("risk_fraction") > 0)
             & (F.col("risk_fraction") < 1) & (budget > 0))
    valid = F.coalesce(valid, F.lit(False))
    per_lot = F.col("stop_distance") * value_per_unit()
    raw = round_volume(F.try_divide(budget, per_lot))
    top = round_volume("volume_max")
    d = df.withColumn("_raw", F.when(valid, raw))
    small = F.col("_raw") < F.col("volume_min")
    capped = F.col("_raw") > F.col("volume_max")
    d = d.withColumn("_v", F.when(capped, top).otherwise(F.col("_raw")))
    outcome = F.when(capped, "capped_by_maximum").otherwise("ok")
    volume = F.col("_v")
    if max_volume:
        cap = round_volume(max_volume)
        hit = F.coalesce(F.col("_v") > F.col(max_volume), F.lit(False))
        outcome = F.when(hit & (cap < F.col("volume_min")), "below_minimum").when(hit, "capped_by_margin").otherwise(outcome)
        volume = F.when(hit & (cap < F.col("volume_min")), 0.0).when(hit, cap).otherwise(F.col("_v"))
    d = (d.withColumn("outcome", F.when(~valid, "invalid").when(small, "below_minimum").otherwise(outcome))
          .withColumn("sized_volume", F.when(~valid | small, 0.0).otherwise(volume)))
    return (d.withColumn("risk_cash_sized", F.col("sized_volume") * per_lot)
            .withColumn("risk_fraction_sized", F.coalesce(F.try_divide(F.col("risk_cash_sized"), F.col("equity")), F.lit(0.0)))
            .drop("_raw", "_v"))


def minimum_viable_equity(risk_fraction: float) -> Column:
    """What an account must hold before the least volume, stopped out, costs no more than the fraction."""
    return F.col("volume_min") * F.col("stop_distance") * value_per_unit() / risk_fraction


def capital_ladder(df: DataFrame, levels: list[float], risk_fraction: float) -> DataFrame:
    """Size of every (symbol, day, stop) row at each equity level, and the equity one lot needs."""
    d = (df.withColumn("equity", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
         .withColumn("risk_fraction", F.lit(float(risk_fraction))))
    return size_positions(d).withColumn("min_equity", minimum_viable_equity(risk_fraction))


def viability(df: DataFrame, equity: float, risk_fraction: float) -> DataFrame:
    """Risk of one minimum lot at each row's stop, and whether the account can carry it."""
    d = df.withColumn("equity", F.lit(float(equity))).withColumn("risk_fraction", F.lit(float(risk_fraction)))
    d = (size_positions(d).withColumn("min_lot_risk", risk_for("volume_min", "stop_distance"))
         .withColumn("min_equity", minimum_viable_equity(risk_fraction)))
    return (d.withColumn("min_lot_share", F.col("min_lot_risk") / F.col("equity"))
            .withColumn("verdict", F.when(F.col("sized_volume") > 0, "OK").otherwise("TOO SMALL")))


# -------------------------------------------------------------------- clocks

#: The broker's wall clock is New York's plus seven hours, all year.
BROKER_ANCHOR = "America/New_York"
BROKER_SHIFT = "INTERVAL 7 HOURS"


def server_to_utc(server_ts) -> Column:
    """A server wall-clock stamp (written as if it were UTC) to the true instant."""
    return F.to_utc_timestamp(_c(server_ts) - F.expr(BROKER_SHIFT), BROKER_ANCHOR)


def utc_to_server(ts) -> Column:
    return F.from_utc_timestamp(_c(ts), BROKER_ANCHOR) + F.expr(BROKER_SHIFT)


def clock_check(server_ts, now, tolerance: float = 15, stale: float = 30) -> Column:
    """A fresh quote in the wrong place is a clock change; an old one proves nothing."""
    drift = (F.unix_timestamp(_c(now)) - F.unix_timestamp(server_to_utc(server_ts))) / 60.0
    return (F.when(F.abs(drift) <= tolerance, "verified").when(drift > stale, "unverifiable").otherwise("mismatch"))


# --------------------------------------------------------------- identifiers

# Contract month letters, January to December.
MONTH_CODES = "FGHJKMNQUVXZ"

# Substrings of a broker's refusal, looked for in this order.
TERMINAL = ("invalid volume", "invalid stops", "invalid price", "not enough money",
            "market closed", "trade disabled", "below minimum", "unsupported filling")
AMBIGUOUS = ("timeout", "connection", "no reply", "returned none")
TRANSIENT = ("requote", "price changed", "off quotes", "busy", "timeout", "too many requests")


def contract_code(root, year, month) -> Column:
    return F.concat(_c(root), F.substr(F.lit(MONTH_CODES), _c(month).cast("int"), F.lit(1)),
                    (_c(year) % 10).cast("string"))


def client_id(strategy, symbol, side, bar_ts) -> Column:
    """The same intent always gets the same id."""
    seed = F.concat_ws("|", _c(strategy), _c(symbol), _c(side), _c(bar_ts))
    return F.concat(F.left(_c(strategy), F.lit(12)), F.lit("#"), F.left(F.sha1(seed), F.lit(10)))


def classify_failure(reason) -> Column:
    text = F.lower(F.coalesce(_c(reason), F.lit("")))

    def has(words):
        return text.rlike("|".join(words))

    return (F.when(has(TERMINAL), "terminal").when(has(AMBIGUOUS), "ambiguous")
            .when(has(TRANSIENT), "transient").otherwise("terminal"))


def sleeve_of(comment) -> Column:
    return F.split_part(_c(comment), F.lit("#"), F.lit(1))


def default_stop(bars: DataFrame, keys=("symbol",)) -> DataFrame:
    """Twice the latest daily range."""
    return bars.groupBy(*keys).agg((F.max_by(F.col("high") - F.col("low"), "ts") * 2).alias("default_stop"))


def cash_changes(bars: DataFrame, specs: DataFrame, keys=("symbol",)) -> DataFrame:
    """Cash result of one contract held over each bar."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy("ts")
    chg = F.col("close") - F.lag("close").over(w)
    return bars.join(specs, list(keys)).select(*keys, "ts", (chg * value_per_unit()).alias("cash"))
