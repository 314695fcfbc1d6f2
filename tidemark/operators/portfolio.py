"""Ranked and vectorised monthly books over a long panel (symbol, month, level).

A panel holds one row per symbol and month, so windows over a symbol or a month are short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.distributions import normal_quantile


def by_symbol():
    return Window.partitionBy("symbol").orderBy("month")



def month_end_panel(bars: DataFrame, keys=("symbol",)) -> DataFrame:
    """Last close of each month."""
    return (bars.groupBy(*keys, F.trunc("ts", "MM").alias("month")).agg(F.max_by("close", "ts").alias("level")))


def load_panel(bars: DataFrame, limit: int = 3, min_share: float = 0.9) -> DataFrame:
    """Complete daily panel: first close per day, forward fill of short holes, symbols with too
    little history dropped, then only days on which every kept symbol has a value.

    Filling explodes each observed row over the hole behind it (at most `limit` rows), so the
    universe is never multiplied by the calendar."""
    day = bars.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.min_by("close", "ts").alias("close"))
    one = Window.partitionBy(F.lit(1))
    calendar = (day.select("day").distinct().withColumn("_r", F.row_number().over(one.orderBy("day")))
                .withColumn("_days", F.count(F.lit(1)).over(one)))
    w = Window.partitionBy("symbol").orderBy("_r")
    d = day.join(calendar, "day")
    hole = F.coalesce(F.lead("_r").over(w), F.col("_days") + 1) - F.col("_r") - 1
    d = d.withColumn("_fill", F.least(hole, F.lit(limit)).cast("int"))
    d = (d.withColumn("_k", F.explode(F.sequence(F.lit(0), "_fill")))
          .select("symbol", "close", (F.col("_r") + F.col("_k")).alias("_r"), "_days"))
    kept = (d.groupBy("symbol", "_days").agg(F.count(F.lit(1)).alias("_have"))
            .filter(F.col("_have") >= F.floor(F.col("_days") * min_share))
            .select("symbol", F.count(F.lit(1)).over(one).alias("_names")))
    d = d.join(kept, "symbol").withColumn("_here", F.count(F.lit(1)).over(Window.partitionBy("_r")))
    return (d.filter(F.col("_here") == F.col("_names")).join(calendar.select("day", "_r"), "_r")
            .select("symbol", "day", "close"))


def dense_months(panel: DataFrame) -> DataFrame:
    """Explicit null rows for the months a symbol skipped, so that a lag is a month."""
    span = panel.groupBy("symbol").agg(F.min("month").alias("_a"), F.max("month").alias("_b"))
    months = span.select("symbol", F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return months.join(panel, ["symbol", "month"], "left")


def with_returns(panel: DataFrame) -> DataFrame:
    return panel.withColumn("ret", F.try_divide(F.col("level"), F.lag("level").over(by_symbol())) - 1.0)


def pick_extremes(df: DataFrame, score: str, top_n: Column | int, keys=()) -> DataFrame:
    """side = +1 for the top n of a month, -1 for the bottom n, none where there are too few.
    Ties go to the first name."""
    n = F.lit(top_n) if isinstance(top_n, int) else top_n
    s = F.col(score)
    m = Window.partitionBy(*keys, "month")
    d = (df.withColumn("_n", F.count(s).over(m))
           .withColumn("_top", F.row_number().over(m.orderBy(s.desc_nulls_last(), "symbol")))
           .withColumn("_low", F.row_number().over(m.orderBy(s.asc_nulls_last(), "symbol"))))
    ok = s.isNotNull() & (F.col("_n") >= 2 * n)
    return d.withColumn("side", F.when(ok & (F.col("_top") <= n), 1).when(ok & (F.col("_low") <= n), -1)).drop(
        "_n", "_top", "_low")


def turnover(book: DataFrame, keys=()) -> DataFrame:
    """Members that entered or left since the previous book, over the book's size; 1 at first.

    A member stayed if the row before it (of the same symbol) is the previous book's."""
    keys = list(keys)
    members = book.filter(F.col("side").isNotNull()).select(*keys, "symbol", "month")
    months = members.groupBy(*keys, "month").agg(F.count(F.lit(1)).alias("size"))
    by_month = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("month")
    months = (months.withColumn("_prev", F.lag("month").over(by_month))
              .withColumn("_prev_size", F.lag("size").over(by_month)))
    w = Window.partitionBy(*keys, "symbol").orderBy("month")
    stayed = (members.withColumn("_last", F.lag("month").over(w)).join(months, [*keys, "month"])
              .groupBy(*keys, "month", "size", "_prev_size")
              .agg(F.sum(F.when(F.col("_last") == F.col("_prev"), 1).otherwise(0)).alias("_stay")))
    changed = F.col("size") + F.col("_prev_size") - 2 * F.col("_stay")
    return stayed.select(*keys, "month", F.when(F.col("_prev_size").isNull(), 1.0).otherwise(
        changed / F.greatest("size", F.lit(1))).alias("turnover"))


def long_short(book: DataFrame, keys=()) -> DataFrame:
    """Mean return of the longs minus mean return of the shorts, per month."""
    def leg(s):
        return F.avg(F.when(F.col("side") == s, F.col("ret")))
    return (book.groupBy(*keys, "month").agg((leg(1) - leg(-1)).alias("ret")).filter(F.col("ret").isNotNull()))


def momentum_books(panel: DataFrame, lookbacks: list[int], top_n: int) -> DataFrame:
    """The ranked books of several lookbacks at once, told apart by `lookback`.

    The signal is the return known at the start of the month."""
    w = by_symbol()
    d = with_returns(panel)
    for k in lookbacks:
        d = d.withColumn(f"_p{k}", F.try_divide(F.col("level"), F.lag("level", k).over(w)) - 1.0)
    d = d.select("symbol", "month", "ret", *[F.lag(f"_p{k}").over(w).alias(f"_s{k}") for k in lookbacks])
    runs = F.explode(F.array(*[F.struct(F.lit(k).alias("lookback"), F.col(f"_s{k}").alias("signal")) for k in lookbacks]))
    d = d.select("symbol", "month", "ret", runs.alias("r")).select("symbol", "month", "ret", "r.lookback", "r.signal")
    return pick_extremes(d, "signal", top_n, ["lookback"])


def xs_momentum(panel: DataFrame, lookbacks: list[int], top_n: int) -> DataFrame:
    """Long the strongest, short the weakest: monthly return and turnover per lookback."""
    books = momentum_books(panel, lookbacks, top_n)
    keys = ["lookback"]
    return long_short(books, keys).join(turnover(books, keys), [*keys, "month"], "left")


def tsmom_portfolio(panel: DataFrame, lookback: int = 12, target_vol: float = 0.10) -> DataFrame:
    """Each symbol on its own sign, sized by inverse volatility, averaged over symbols."""
    d = with_returns(panel)
    w12 = by_symbol().rowsBetween(-11, 0)
    d = (d.withColumn("_sign", F.signum(F.try_divide(F.col("level"), F.lag("level", lookback).over(by_symbol())) - 1.0))
          .withColumn("_vol", F.when(F.count("ret").over(w12) >= 12, F.stddev_samp("ret").over(w12))))
    d = (d.withColumn("_s", F.lag("_sign").over(by_symbol())).withColumn("_v", F.lag("_vol").over(by_symbol()) * 12 ** 0.5))
    weight = F.least(F.greatest(F.try_divide(F.col("_s") * target_vol, F.col("_v")), F.lit(-4.0)), F.lit(4.0))
    d = d.withColumn("weight", weight)
    d = d.withColumn("_step", F.abs(F.col("weight") - F.lag("weight").over(by_symbol())))
    return (d.groupBy("month").agg(
        F.avg(F.col("weight") * F.col("ret")).alias("ret"),
        F.try_divide(F.coalesce(F.sum("_step"), F.lit(0.0)), F.nullif(F.sum(F.abs("weight")), F.lit(0.0))).alias("turnover"))
        .filter(F.col("ret").isNotNull()))


def carry_portfolio(panel: DataFrame, carry: DataFrame, top_n: int) -> DataFrame:
    """A static book: long the highest carry, short the lowest, never both."""
    c = carry.filter(F.col("carry").isNotNull())
    one = Window.partitionBy(F.lit(1))
    n = F.least(F.lit(top_n), F.floor(F.count(F.lit(1)).over(one) / 2))
    c = (c.withColumn("_n", n)
          .withColumn("_hi", F.row_number().over(one.orderBy(F.desc("carry"), "symbol")))
          .withColumn("_lo", F.row_number().over(one.orderBy("carry", "symbol")))
          .withColumn("side", F.when(F.col("_hi") <= F.col("_n"), 1).when(F.col("_lo") <= F.col("_n"), -1)))
    d = with_returns(panel).join(c.filter(F.col("side").isNotNull()).select("symbol", "side"), "symbol")
    return long_short(d).withColumn("turnover", F.lit(0.0))


def swap_to_monthly_carry(rate: Column, contract_size: Column, price: Column, nights: int = 22) -> Column:
    """Financing per night as a share of notional, over a month of rollovers."""
    return F.try_divide(rate, contract_size * price) * nights


def value_scores(panel: DataFrame, years: float = 5.0, band: float = 0.5) -> DataFrame:
    """Mean log level of the band of months around `years` ago, minus the log level now."""
    lo, hi = int((years - band) * 12), int((years + band) * 12)
    w = by_symbol().rowsBetween(-hi, -lo)
    d = panel.withColumn("_log", F.when(F.col("level") > 0, F.ln("level")))
    full = F.count("_log").over(w) == hi - lo + 1
    return d.withColumn("value", F.when(full, F.avg("_log").over(w) - F.col("_log"))).drop("_log")


def value_weights(panel: DataFrame, vol_months: int = 3, min_names: int = 9, years: float = 5.0,
                  band: float = 0.5) -> DataFrame:
    """Long the cheap third, short the dear third, inverse-volatility weights of 0.5 a side."""
    w = by_symbol().rowsBetween(-(vol_months - 1), 0)
    d = value_scores(with_returns(panel), years, band)
    d = d.withColumn("vol", F.when(F.count("ret").over(w) >= 3, F.stddev_samp("ret").over(w)))
    d = d.withColumn("_score", F.when(F.col("vol") > 0, F.col("value")))
    n = F.count("_score").over(Window.partitionBy("month"))
    d = d.withColumn("_names", n)
    k = F.greatest(F.lit(1), F.floor(F.col("_names") / 3))
    d = pick_extremes(d, "_score", k).withColumn("side", F.when(F.col("_names") >= min_names, F.col("side")))
    inv = F.when(F.col("side").isNotNull(), 1.0 / F.col("vol"))
    d = d.withColumn("_inv", inv)
    share = F.col("_inv") / F.sum("_inv").over(Window.partitionBy("month", "side"))
    return d.withColumn("weight", F.coalesce(F.col("side") * 0.5 * share, F.lit(0.0))).drop("_names", "_inv", "_score")


def value_portfolio(weights: DataFrame, unit_cost: Column | float) -> DataFrame:
    """Decided at a month end, held the next month, charged on turnover."""
    d = (weights.withColumn("held", F.coalesce(F.lag("weight").over(by_symbol()), F.lit(0.0)))
         .withColumn("_step", F.abs(F.col("weight") - F.lag("weight").over(by_symbol()))))
    g = d.groupBy("month").agg(F.sum(F.col("held") * F.col("ret")).alias("gross"),
                               F.coalesce(F.sum("_step"), F.lit(0.0)).alias("turnover"))
    cost = unit_cost if isinstance(unit_cost, Column) else F.lit(float(unit_cost))
    return g.withColumn("ret", F.coalesce("gross", F.lit(0.0)) - F.col("turnover") * cost)


def median_friction(costs: DataFrame, prices: DataFrame) -> DataFrame:
    """Median over markets of the round trip as a share of the latest price."""
    d = costs.join(prices, "symbol").filter(F.col("price") > 0)
    return d.agg(F.median((F.col("spread") + 2 * F.col("slippage")) / F.abs("price")).alias("unit_cost"))


def portfolio_stats(port: DataFrame, keys: list[str], trials: int, spread_share: float = 0.0,
                    min_months: int = 24) -> DataFrame:
    """Annual return, volatility, Sharpe, t, drawdown, positive years and cost drag per variant."""
    w = Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    d = port.filter(F.col("ret").isNotNull())
    d = d.withColumn("_eq", F.exp(F.sum(F.ln(F.when(F.col("ret") > -1, 1.0 + F.col("ret")).otherwise(1e-300))).over(w)))
    d = d.withColumn("_dd", 1.0 - F.col("_eq") / F.max("_eq").over(w))
    years = (d.groupBy(*keys, F.year("month").alias("_y")).agg(F.sum("ret").alias("_r")).groupBy(*keys)
             .agg(F.sum(F.when(F.col("_r") > 0, 1).otherwise(0)).alias("years_pos"), F.count(F.lit(1)).alias("years")))
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("months"), F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_sd"),
                             F.max("_dd").alias("max_dd"), F.avg(F.coalesce("turnover", F.lit(0.0))).alias("_turn"))
    g = g.join(years, keys)
    ann = F.col("_m") * 12
    vol = F.col("_sd") * 12 ** 0.5
    t = F.try_divide(F.col("_m"), F.col("_sd") / F.sqrt("months"))
    enough = F.col("months") >= min_months
    bar = normal_quantile(1 - 0.025 / trials)
    out = g.select(*keys, "months", F.when(enough, ann).otherwise(0.0).alias("ann_return"),
                   F.when(enough, vol).otherwise(0.0).alias("ann_vol"),
                   F.when(enough, F.coalesce(F.try_divide(ann, vol), F.lit(0.0))).otherwise(0.0).alias("sharpe"),
                   F.when(enough, t).otherwise(0.0).alias("t"), F.when(enough, F.col("max_dd")).otherwise(0.0).alias("max_dd"),
                   F.when(enough, F.col("years_pos")).otherwise(0).alias("years_pos"),
                   F.when(enough, F.col("years")).otherwise(0).alias("years"),
                   F.when(enough & (F.col("_m") > 0), F.col("_turn") * spread_share / F.col("_m")).alias("cost_drag"))
    steady = (F.col("years") >= 6) & (F.col("years_pos") >= 0.65 * F.col("years"))
    return out.withColumn("verdict", F.when(~(F.col("months") >= min_months), "too few months")
                          .when((F.col("t") >= bar) & steady & (F.col("sharpe") > 0.4), "SURVIVES")
                          .when(F.col("t") >= bar, "significant, inconsistent")
                          .when((F.abs("t") >= 2) & steady, "consistent, below bar").otherwise("-"))
