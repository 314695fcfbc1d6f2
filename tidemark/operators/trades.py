"""Trade, equity and book analytics.

Trades are unbounded, so anything per trade is a plain aggregate or a chunked running
function; equity is first summed to one row per book and day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import chunks
from tidemark.operators import quantiles
from tidemark.session import materialize, saved

TRADING_DAYS = 252


def derived(trades: DataFrame) -> DataFrame:
    """Net result, result in units of initial risk, and days held."""
    net = F.col("gross_pnl") - F.col("costs")
    secs = F.unix_timestamp("exit_ts") - F.unix_timestamp("entry_ts")
    r = F.when(F.col("risk_cash") != 0, net / F.nullif("risk_cash", F.lit(0.0))).otherwise(0.0)
    return (trades.withColumn("net_pnl", net).withColumn("r_multiple", r)
            .withColumn("days_held", secs / 86400.0))


def daily_equity(trades: DataFrame, keys: list[str], start: float) -> DataFrame:
    """Realised equity per book at each exit day."""
    run = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    day = F.date_trunc("day", "exit_ts").alias("ts")
    return (trades.groupBy(*keys, day).agg(F.sum("net_pnl").alias("pnl"))
            .withColumn("equity", F.sum("pnl").over(run) + F.lit(float(start))))


def equity_returns(equity: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("ts")
    return equity.withColumn("ret", F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1.0)


def drawdown(equity: DataFrame, keys: list[str]) -> DataFrame:
    """Deepest relative fall from the running peak, and the longest time below it in days."""
    run = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    d = equity.withColumn("peak", F.max("equity").over(run))
    d = d.withColumn("_at", F.last(F.when(F.col("equity") >= F.col("peak"), F.col("ts")), True).over(run))
    under = (F.unix_timestamp("ts") - F.unix_timestamp("_at")) / 86400.0
    return d.groupBy(*keys).agg(
        F.max(F.try_divide(F.col("peak") - F.col("equity"), F.col("peak"))).alias("max_drawdown"),
        F.max(under).alias("max_dd_days"))


def annualisation(equity: DataFrame, keys: list[str]) -> DataFrame:
    """Periods per year implied by the median spacing of the equity rows."""
    w = Window.partitionBy(*keys).orderBy("ts")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))
    g = equity.select(*keys, gap.alias("_gap")).groupBy(*keys).agg(
        F.median("_gap").alias("_gap"), F.count(F.lit(1)).alias("_n"))
    per_day = F.try_divide(F.lit(86400.0), F.col("_gap"))
    fast = (F.col("_n") >= 3) & (per_day > 1)
    return g.select(*keys, F.when(fast, TRADING_DAYS * per_day).otherwise(float(TRADING_DAYS)).alias("periods"))


def metrics(trades: DataFrame, keys: list[str], start: float, realised_only: bool = False) -> DataFrame:
    """The book's trade and equity statistics, one row per key.

    realised_only leaves out positions closed merely because the data ended."""
    if realised_only:
        trades = trades.filter(F.col("exit_reason") != "end_of_data")
    t = derived(trades)
    win, net = F.col("r_multiple") > 0, F.col("net_pnl")
    side = lambda c, cond: F.sum(F.when(cond, c).otherwise(0.0))
    aggs = [F.count(F.lit(1)).alias("trades"), F.avg(F.when(win, 1.0).otherwise(0.0)).alias("win_rate"),
            F.avg(F.when(win, F.col("r_multiple"))).alias("_aw"), F.abs(F.avg(F.when(~win, F.col("r_multiple")))).alias("_al"),
            F.avg("r_multiple").alias("expectancy_r"), side(net, net > 0).alias("_gw"),
            F.abs(side(net, net <= 0)).alias("_gl"), F.sum("gross_pnl").alias("gross_pnl"),
            F.sum("costs").alias("total_costs"), side(F.col("gross_pnl"), F.col("gross_pnl") > 0).alias("_gp"),
            F.avg("days_held").alias("avg_days_held"), F.sum("days_held").alias("_held"),
            F.max("r_multiple").alias("best_r"), F.min("r_multiple").alias("worst_r")]
    for c in ("mae", "mfe"):
        if c in trades.columns:
            aggs.append(F.avg(c).alias(f"avg_{c}"))
    per_trade = t.groupBy(*keys).agg(*aggs)

    eq = daily_equity(t, keys, start)
    ret = equity_returns(eq, keys)
    down = F.when(F.col("ret") < 0, F.col("ret"))
    per_eq = ret.groupBy(*keys).agg(
        F.avg("ret").alias("_mean"), F.stddev_samp("ret").alias("_sd"), F.stddev_samp(down).alias("_down"),
        F.max_by("equity", "ts").alias("_final"), F.datediff(F.max("ts"), F.min("ts")).alias("_days"))
    d = (per_trade.join(per_eq, keys).join(annualisation(eq, keys), keys).join(drawdown(eq, keys), keys))
    years = F.greatest(F.col("_days") / 365.25, F.lit(1e-9))
    p = F.col("periods")
    d = (d.withColumn("payoff", F.try_divide(F.coalesce("_aw", F.lit(0.0)), F.col("_al")))
         .withColumn("profit_factor", F.try_divide("_gw", "_gl"))
         .withColumn("total_return", F.col("_final") / start - 1.0)
         .withColumn("cagr", F.pow(F.col("_final") / start, 1.0 / years) - 1.0)
         .withColumn("sharpe", F.coalesce(F.try_divide(F.col("_mean") * p, F.col("_sd") * F.sqrt(p)), F.lit(0.0)))
         .withColumn("sortino", F.coalesce(F.try_divide(F.col("_mean") * p, F.col("_down") * F.sqrt(p)), F.lit(0.0)))
         .withColumn("calmar", F.coalesce(F.try_divide("cagr", "max_drawdown"), F.lit(0.0)))
         .withColumn("cost_drag", F.try_divide("total_costs", "_gp"))
         .withColumn("exposure", F.least(F.col("_held") / (years * 365.25), F.lit(1.0))))
    return d.drop(*[c for c in d.columns if c.startswith("_")], "periods")


def metrics_verdict() -> Column:
    rules = [(F.col("trades") < 30, "INCONCLUSIVE"), (F.col("expectancy_r") <= 0, "DEAD"),
             (F.col("cost_drag") > 0.5, "COST-DOMINATED"), (F.col("sharpe") < 0.5, "WEAK"),
             (F.col("sharpe") < 1.0, "MARGINAL"), (F.col("sharpe") < 2.0, "WORKABLE")]
    return reduce(lambda acc, r: acc.when(*r), rules[1:], F.when(*rules[0])).otherwise("STRONG")


def yearly_pnl(equity: DataFrame, keys: list[str], min_bars: int = 200) -> DataFrame:
    """Last minus first equity per calendar year with enough rows."""
    return (equity.groupBy(*keys, F.year("ts").alias("year"))
            .agg((F.max_by("equity", "ts") - F.min_by("equity", "ts")).alias("pnl"), F.count(F.lit(1)).alias("bars"))
            .filter(F.col("bars") >= min_bars))


def attribution(trades: DataFrame, weights: DataFrame) -> DataFrame:
    """Per sleeve: count, net, share of the total, expectancy, win rate, normalised weight.
    Sleeves without trades keep a zero row. `weights` is the short declared list (sleeve, w)."""
    t = derived(trades).groupBy("sleeve").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("net_pnl").alias("net_pnl"), F.avg("r_multiple").alias("expectancy_r"),
        F.avg(F.when(F.col("r_multiple") > 0, 1.0).otherwise(0.0)).alias("win_rate"))
    everything = Window.partitionBy(F.lit(1))
    w = weights.withColumn("weight", F.col("w") / F.sum("w").over(everything)).drop("w")
    d = w.join(t, "sleeve", "full_outer").withColumn("_total", F.sum("net_pnl").over(everything))
    return (d.filter(F.col("weight").isNotNull())
            .fillna(0, ["trades", "net_pnl", "expectancy_r", "win_rate"])
            .withColumn("share", F.coalesce(F.try_divide("net_pnl", "_total"), F.col("net_pnl"))).drop("_total"))


def pnl_rollup(trades: DataFrame, symbol: str = "symbol", sector: str = "sector") -> DataFrame:
    """Net, gross, friction, counts and wins by market, by sector and in total, in one pass."""
    t = derived(trades)
    g = t.groupingSets([[symbol, sector], [sector], []], symbol, sector)
    return g.agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("trades"), F.sum("net_pnl").alias("net_pnl"),
                 F.sum("gross_pnl").alias("gross_pnl"), F.sum("costs").alias("friction"),
                 F.sum(F.when(F.col("net_pnl") > 0, 1).otherwise(0)).alias("wins"))


def concentration(markets: DataFrame, traded: Column, top=(1, 3, 5)) -> DataFrame:
    """From one row per market: rank, share, running share, top-k share, traded-forward share and
    the best market not traded."""
    m = markets.withColumn("_traded", traded)
    by = Window.partitionBy(F.lit(1)).orderBy(F.desc("net_pnl"), "symbol")
    run, all_ = by.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(F.lit(1))
    total = F.sum("net_pnl").over(all_)
    m = (m.withColumn("rank", F.row_number().over(by)).withColumn("share", F.try_divide(F.col("net_pnl"), total))
         .withColumn("running_share", F.try_divide(F.sum("net_pnl").over(run), total)))
    for k in top:
        m = m.withColumn(f"top{k}_share", F.sum(F.when(F.col("rank") <= k, F.col("share"))).over(all_))
    return (m.withColumn("forward_share", F.sum(F.when(F.col("_traded"), F.col("share")).otherwise(0.0)).over(all_))
            .withColumn("best_missed", F.max_by("symbol", F.when(~F.col("_traded"), F.struct("net_pnl"))).over(all_))
            .drop("_traded"))


def sleeve_changes(equity: DataFrame, period: Column, key: str) -> DataFrame:
    """Change of each sleeve's last value per period."""
    last = equity.groupBy(key, period.alias("period")).agg(F.max_by("equity", "ts").alias("_e"))
    w = Window.partitionBy(key).orderBy("period")
    return last.withColumn("chg", F.col("_e") - F.lag("_e").over(w)).drop("_e")


def pairwise_correlation(changes: DataFrame, key: str, value: str = "chg") -> DataFrame:
    """Pearson correlation of every pair of sleeves that is found, on periods where both moved."""
    from tidemark.operators import gram
    d = changes.select(F.unix_date(F.to_date("period")).cast("long").alias("period"), F.col(key).alias("member"), F.col(value).cast("double").alias("value"))
    return gram.pair_moments(gram.centred(d)).select("a", "b", gram.correlation().alias("rho"))


def flag_correlated(corr: DataFrame, threshold: float = 0.6) -> DataFrame:
    return corr.filter(F.col("rho") >= threshold).orderBy(F.desc("rho"), "a", "b")


def diversification_ratio(corr: DataFrame) -> DataFrame:
    """sqrt(n / (1 + (n-1) rho)) with the measured mean correlation of n members, those of the pairs."""
    n = corr.select(F.explode(F.array("a", "b")).alias("m")).agg(F.count_distinct("m").cast("double").alias("n")).scalar()
    d = corr.agg(F.avg("rho").alias("mean_rho")).withColumn("_n", n)
    rho = F.greatest(F.col("mean_rho"), F.try_divide(F.lit(-1.0), F.col("_n") - 1) + 1e-9)
    return d.select("mean_rho", F.when(F.col("mean_rho").isNotNull(), F.sqrt(F.try_divide("_n", 1 + (F.col("_n") - 1) * rho))).alias("ratio"))


def r_histogram(trades: DataFrame, keys: list[str], bins: int = 12) -> DataFrame:
    """Equal-width counts of R; the last edge is inclusive and a zero-width range is widened."""
    t = derived(trades).select(*keys, "r_multiple")
    edge = t.groupBy(*keys).agg(F.min("r_multiple").alias("_lo"), F.max("r_multiple").alias("_hi"))
    flat = F.col("_hi") <= F.col("_lo")
    edge = edge.select(*keys, F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
                       F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor((F.col("r_multiple") - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    return (t.join(edge, keys).groupBy(*keys, b.alias("bin"), "_lo", (width).alias("_w"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(*keys, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("lo"),
                    (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("hi"), "n"))


ORDER = ["exit_ts", "entry_ts", "symbol", "sleeve", "side", "volume", "gross_pnl", "costs"]


def consecutive_losses(trades: DataFrame, keys: list[str], order: list[str] = ORDER) -> DataFrame:
    """Losing streak after each close, and when its latest loss was."""
    # the trades are worked out once and ordered once; the rest comes from one row per chunk
    t = saved(trades)
    c, _ = chunks.cut(t, keys, order)
    w = Window.partitionBy(*keys, chunks.CHUNK).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    net = F.col("gross_pnl") - F.col("costs")
    c = c.withColumn("_n", F.row_number().over(w).cast("long"))
    c = saved(c.withColumn("_win", F.max(F.when(net >= 0, F.col("_n"))).over(run))
              .withColumn("_loss", F.last(F.when(net < 0, F.col("exit_ts")), True).over(run)))
    ends = materialize(c.groupBy(*keys, chunks.CHUNK).agg(
        F.max("_n").alias("_rows"), F.max("_win").alias("_won"), F.max_by("_loss", "_n").alias("_lost")))
    s = chunks.exclusive(ends, keys, "_rows", "sum", "_rows_before").withColumn("_won", F.col("_won") + F.coalesce("_rows_before", F.lit(0)))
    s = chunks.exclusive(materialize(s), keys, "_won", "last", "_won_before")
    s = chunks.exclusive(materialize(s), keys, "_lost", "last", "_lost_before")
    c = chunks.attach(c, s.drop("_rows", "_won", "_lost"), keys)
    start = F.coalesce("_rows_before", F.lit(0))
    win = F.coalesce(F.col("_win") + start, F.col("_won_before"), F.lit(0))
    return (derived(c).withColumn("last_loss_ts", F.coalesce("_loss", "_lost_before"))
            .withColumn("streak", (F.col("_n") + start - win).cast("long"))
            .drop("_n", "_win", "_loss", "_rows_before", "_won_before", "_lost_before", chunks.CHUNK))


def session_book(snapshots: DataFrame, keys: list[str], order: list[str], start: float) -> DataFrame:
    """Day-start equity, running high-water, daily result and both drawdowns per snapshot."""
    c = chunks.ordered_chunks(snapshots.withColumn("_day", F.to_date("ts")), keys, order)
    first = c.groupBy(*keys, "_day").agg(F.min_by("equity", F.struct(*order)).alias("day_start_equity"))
    c = chunks.running_max(c, keys, order, F.greatest(F.col("equity"), F.lit(float(start))), "high_water_equity")
    d = c.join(first, [*keys, "_day"])
    fall = lambda ref: F.greatest(F.try_divide(ref - F.col("equity"), ref), F.lit(0.0))
    return (d.withColumn("daily_pnl_fraction", F.try_divide(F.col("equity") - F.col("day_start_equity"), F.col("day_start_equity")))
            .withColumn("static_drawdown", fall(F.lit(float(start))))
            .withColumn("trailing_drawdown", fall(F.col("high_water_equity")))
            .drop("_day", chunks.CHUNK))


# ----------------------------------------------------------- ranges over held bars

def range_extremes(bars: DataFrame, max_level: int, key: str = "symbol") -> DataFrame:
    """For each key, day and level k: highest high and lowest low of the 2^k days from that day.

    Bars are dense over the calendar first. Any span of days is then covered by two rows."""
    span = bars.groupBy(key).agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    days = span.select(key, F.explode(F.sequence("_a", "_b")).alias("day"))
    d = days.join(bars, [key, "day"], "left")
    w = Window.partitionBy(key).orderBy("day")
    d = d.withColumnsRenamed({"high": "_h0", "low": "_l0"})
    for k in range(1, max_level + 1):  # each level is two spans of the level below
        half = 2 ** (k - 1)
        d = (d.withColumn(f"_h{k}", F.greatest(f"_h{k - 1}", F.lead(f"_h{k - 1}", half).over(w)))
              .withColumn(f"_l{k}", F.least(f"_l{k - 1}", F.lead(f"_l{k - 1}", half).over(w))))
    levels = [F.struct(F.lit(k).alias("level"), F.col(f"_h{k}").alias("hi"), F.col(f"_l{k}").alias("lo"))
              for k in range(max_level + 1)]
    return (d.select(key, "day", F.explode(F.array(*levels)).alias("x"))
            .select(key, "day", "x.level", "x.hi", "x.lo"))


def excursions(trades: DataFrame, bars: DataFrame, value_per_unit: Column | float = 1.0, key: str = "symbol") -> DataFrame:
    """Worst and best excursion in R while a trade was held, from daily bars.

    Two equality lookups per trade instead of a join of every trade with every held bar; the spans
    reach as far as the longest holding of the trades, or the longest history of bars, asks."""
    held = trades.agg(F.max(F.datediff("exit_ts", "entry_ts"))).first()[0] or 0
    known = bars.groupBy(key).agg(F.datediff(F.max("day"), F.min("day")).alias("n")).agg(F.max("n")).first()[0] or 0
    max_level = max(0, (min(held, known) + 1).bit_length() - 1)
    ext = range_extremes(bars, max_level, key)
    edge = bars.groupBy(key).agg(F.min("day").alias("_min"), F.max("day").alias("_max"))
    t = trades.join(edge, key, "left")
    a = F.greatest(F.to_date("entry_ts"), F.col("_min"))
    b = F.least(F.to_date("exit_ts"), F.col("_max"))
    n = F.datediff(b, a) + 1
    level = F.floor(F.log2(F.when(n > 0, n).cast("double"))).cast("int")
    t = t.withColumn("_a", a).withColumn("_level", level)
    t = t.withColumn("_b", F.date_add(b, 1 - F.pow(F.lit(2), F.col("_level")).cast("int")))
    for side, p in (("_a", "_x"), ("_b", "_y")):
        e = ext.select(key, F.col("day").alias(side), F.col("level").alias("_level"),
                       F.col("hi").alias(p + "h"), F.col("lo").alias(p + "l"))
        t = t.join(e, [key, side, "_level"], "left")
    hi, lo = F.greatest("_xh", "_yh"), F.least("_xl", "_yl")
    up = (hi - F.col("entry_price")) * F.col("volume") * value_per_unit
    down = (lo - F.col("entry_price")) * F.col("volume") * value_per_unit
    long = F.col("side") > 0
    best, worst = F.when(long, up).otherwise(-down), F.when(long, down).otherwise(-up)
    risk = F.nullif("risk_cash", F.lit(0.0))
    out = (t.withColumn("mfe", F.greatest(F.coalesce(best / risk, F.lit(0.0)), F.lit(0.0)))
           .withColumn("mae", F.least(F.coalesce(worst / risk, F.lit(0.0)), F.lit(0.0))))
    return out.select(*trades.columns, "mae", "mfe")


def reconcile(expected: DataFrame, actual: DataFrame, key: str = "symbol", tolerance: float = 1e-9) -> DataFrame:
    """Signed volume per key on both sides; only disagreements are returned."""
    def side(df, name):
        return df.groupBy(key).agg(F.sum(F.col("side") * F.col("volume")).alias(name))

    d = side(expected, "expected").join(side(actual, "actual"), key, "full_outer").fillna(0.0, ["expected", "actual"])
    return d.filter(F.abs(F.col("expected") - F.col("actual")) > tolerance)


def orphans(positions: DataFrame, fills: DataFrame, ticket: str = "ticket") -> DataFrame:
    """Positions whose ticket no fill ever recorded."""
    return positions.join(fills.select(ticket).distinct(), ticket, "left_anti")


def sharpe_by(returns: DataFrame, keys: list[str], ret: str = "ret") -> DataFrame:
    """Mean over sample deviation per key; 0 with fewer than two rows or no spread."""
    return returns.groupBy(*keys).agg(
        F.count(ret).alias("n"), F.coalesce(F.try_divide(F.avg(ret), F.stddev_samp(ret)), F.lit(0.0)).alias("sharpe"))


def exact_median_by(df: DataFrame, keys: list[str], value, out: str) -> DataFrame:
    return quantiles.exact_median(df, keys, value, out)
