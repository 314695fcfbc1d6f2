"""Sizing a book to a volatility target from each market's recent cash changes.

With z the standardised changes of a market, s' R s equals the sum over days of (sum of s z)^2
divided by n-1. Quadratic forms of the correlation matrix are therefore two grouped sums, and
no pair of markets is ever formed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize


def recent_changes(cash: DataFrame, decisions: DataFrame, window: int) -> DataFrame:
    """Cash changes of the last `window` calendar rows up to each decision day.

    cash: symbol, day, cash. decisions: decision_day. Days are ranked over the observed calendar
    and each decision is expanded to its window, so the join is on the day."""
    one = Window.partitionBy(F.lit(1)).orderBy("day")
    days = cash.select("day").distinct().withColumn("_r", F.row_number().over(one))
    d = decisions.select("decision_day").distinct()
    last = (days.join(d, F.col("day") == F.col("decision_day")).select("decision_day", F.col("_r").alias("_last")))
    grid = last.select("decision_day", F.explode(F.sequence(F.greatest(F.col("_last") - window + 1, F.lit(1)), F.col("_last"))).alias("_r"))
    grid = grid.join(days, "_r").select("decision_day", "day")
    n = grid.groupBy("decision_day").agg(F.count(F.lit(1)).alias("n_days"))
    return grid.join(n, "decision_day").join(cash, "day")


def market_stats(recent: DataFrame) -> DataFrame:
    """Mean and deviation per decision and market; a day without a change counts as zero once the
    market has a change in the window. A market without any has no estimate, hence no row."""
    g = recent.filter(F.col("cash").isNotNull()).groupBy("decision_day", "n_days", "symbol").agg(
        F.count(F.lit(1)).alias("history"), F.sum("cash").alias("_s1"), F.sum(F.col("cash") * F.col("cash")).alias("_s2"))
    mean = F.col("_s1") / F.col("n_days")
    var = F.try_divide(F.col("_s2") - F.col("_s1") * mean, F.col("n_days") - 1)
    return g.select("decision_day", "n_days", "symbol", "history", mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sigma"))


def correlation_sums(recent: DataFrame, stats: DataFrame, loads: DataFrame) -> DataFrame:
    """For exposures (decision_day, symbol, s_free, x_fixed): the three quadratic sums per day.

    A market absent on a day sits at zero, that is at -mean/sigma; those terms are added through
    each decision's constant."""
    z0 = F.when(F.col("sigma") > 0, -F.col("mean") / F.nullif("sigma", F.lit(0.0))).otherwise(0.0)
    m = stats.join(loads, ["decision_day", "symbol"]).withColumn("_z0", z0)
    base = m.groupBy("decision_day", "n_days").agg(F.sum(F.col("s_free") * F.col("_z0")).alias("_f0"),
                                                   F.sum(F.col("x_fixed") * F.col("_z0")).alias("_x0"))
    step = F.when(F.col("sigma") > 0, F.col("cash") / F.nullif("sigma", F.lit(0.0))).otherwise(0.0)
    per_day = (recent.filter(F.col("cash").isNotNull()).select("decision_day", "day", "symbol", "cash").join(m, ["decision_day", "symbol"])
               .groupBy("decision_day", "day").agg(F.sum(F.col("s_free") * step).alias("_f"), F.sum(F.col("x_fixed") * step).alias("_x")))
    sums = per_day.groupBy("decision_day").agg(
        F.count(F.lit(1)).alias("_seen"), F.sum("_f").alias("_f1"), F.sum("_x").alias("_x1"),
        F.sum(F.col("_f") * F.col("_f")).alias("_ff"), F.sum(F.col("_f") * F.col("_x")).alias("_fx"), F.sum(F.col("_x") * F.col("_x")).alias("_xx"))
    d = base.join(sums, "decision_day")
    n = F.col("n_days")

    def total(p, q, pq, p1, q1):
        """Sum over all days of (p + p0)(q + q0), days without any change included."""
        return F.col(pq) + F.col(q) * F.col(p1) + F.col(p) * F.col(q1) + n * F.col(p) * F.col(q)

    return d.select("decision_day", (total("_f0", "_f0", "_ff", "_f1", "_f1") / (n - 1)).alias("ff"),
                    (total("_f0", "_x0", "_fx", "_f1", "_x1") / (n - 1)).alias("fx"),
                    (total("_x0", "_x0", "_xx", "_x1", "_x1") / (n - 1)).alias("xx"))


def allocate(legs: DataFrame, cash: DataFrame, target: float = 0.12, window: int = 126, min_history: int = 63,
             shrink: float = 0.5, max_risk: float = 0.01, periods: int = 252) -> DataFrame:
    """Contracts for every leg being sized, so that the book with its held legs meets the target.

    legs: decision_day, leg, symbol, side, stop_distance, value_per_unit, held_contracts (null
    when being sized), equity. Every free leg gets the same daily cash volatility c, the root
    of a c^2 + b c + d = T^2."""
    recent = recent_changes(cash, legs, window)
    stats = market_stats(recent)
    ready = stats.filter(F.col("history") >= min_history)
    l = legs.join(stats.select("decision_day", "symbol", "history", "sigma"), ["decision_day", "symbol"], "left")
    l = l.withColumn("ready", F.coalesce(F.col("history") >= min_history, F.lit(False)))
    free, fixed = F.col("held_contracts").isNull(), F.col("held_contracts").isNotNull()
    loads = l.filter("ready").groupBy("decision_day", "symbol").agg(
        F.sum(F.when(free, F.col("side").cast("double")).otherwise(0.0)).alias("s_free"),
        F.sum(F.when(fixed, F.col("side") * F.col("held_contracts") * F.col("sigma")).otherwise(0.0)).alias("x_fixed"))
    q = correlation_sums(recent, ready, loads)
    # shrinking towards the identity; a market that never moved keeps its unit diagonal
    still = F.when(F.col("sigma") > 0, shrink).otherwise(1.0)
    own = (loads.join(ready.select("decision_day", "symbol", "sigma"), ["decision_day", "symbol"]).groupBy("decision_day").agg(
        F.sum(still * F.col("s_free") * F.col("s_free")).alias("_iff"), F.sum(still * F.col("s_free") * F.col("x_fixed")).alias("_ifx"),
        F.sum(still * F.col("x_fixed") * F.col("x_fixed")).alias("_ixx")))
    a = (1 - shrink) * F.col("ff") + F.col("_iff")
    b = 2 * ((1 - shrink) * F.col("fx") + F.col("_ifx"))
    d = (1 - shrink) * F.col("xx") + F.col("_ixx")
    book = q.join(own, "decision_day").select("decision_day", a.alias("a"), b.alias("b"), d.alias("d"))
    l = l.join(book, "decision_day", "left").withColumn("t2", F.pow(F.lit(target) * F.col("equity") / float(periods) ** 0.5, F.lit(2.0)))
    disc = F.col("b") * F.col("b") - 4 * F.col("a") * (F.col("d") - F.col("t2"))
    c = F.when((F.col("a") > 0) & (disc >= 0), F.greatest((-F.col("b") + F.sqrt(F.greatest(disc, F.lit(0.0)))) / (2 * F.nullif("a", F.lit(0.0))), F.lit(0.0))).otherwise(0.0)
    l = l.filter(free).withColumn("c", c)
    sized = F.col("ready") & (F.col("c") > 0) & (F.col("sigma") > 0)
    per_contract = F.col("stop_distance") * F.col("value_per_unit")
    l = l.withColumn("_n", F.when(sized, F.col("c") / F.nullif("sigma", F.lit(0.0))).otherwise(0.0))
    risk = F.col("_n") * per_contract / F.col("equity")
    l = l.withColumn("risk_fraction", F.when(F.col("ready"), F.least(risk, F.lit(max_risk))))
    contracts = F.when(risk > max_risk, max_risk * F.col("equity") / per_contract).otherwise(F.col("_n"))
    return (l.withColumn("contracts", contracts)
            .withColumn("note", F.when(~F.col("ready"), "default").when(~sized, "at target").when(risk > max_risk, "capped").otherwise("sized"))
            .select("decision_day", "leg", "symbol", "side", "sigma", "c", "contracts", "risk_fraction", "note"))


def shrunk_correlation(recent: DataFrame, shrink: float = 0.5) -> DataFrame:
    """The shrunk correlation of every pair of markets that is found, per decision day; days a market
    did not trade count as no change, and a market that never moved correlates with none."""
    from tidemark.operators import gram
    d = recent.select("decision_day", F.unix_date("day").cast("long").alias("period"), F.col("symbol").alias("member"), F.col("cash").cast("double").alias("value"))
    d = materialize(d)
    traded = d.filter("value is not null")
    n = traded.groupBy("decision_day").agg(F.count_distinct("period").alias("_n"))
    own = traded.groupBy("decision_day", "member").agg(F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_q"))
    side = lambda k: own.select("decision_day", F.col("member").alias(k), F.col("_s").alias(f"_s{k}"), F.col("_q").alias(f"_q{k}"))
    p = gram.pair_moments(d, ("decision_day",), every_pair=True).join(n, "decision_day").join(side("a"), ["decision_day", "a"], "left").join(side("b"), ["decision_day", "b"], "left")

    def spread(k):
        return F.greatest(F.col(f"_q{k}") - F.col(f"_s{k}") * F.col(f"_s{k}") / F.col("_n"), F.lit(0.0))

    cov = F.col("sxy") - F.col("_sa") * F.col("_sb") / F.col("_n")
    rho = F.try_divide(cov, F.sqrt(spread("a") * spread("b")))
    return p.select("decision_day", "a", "b", ((1 - shrink) * F.coalesce(rho, F.lit(0.0))).alias("rho"))
