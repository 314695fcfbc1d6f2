"""What happens along return paths: drawdowns, targets and limits, from every start or resampled.

Returns are one row per book and period (`t` is the 0-based period number), so a path has a
bounded number of rows and each (book, risk, path) is a short window of its own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



@dataclass(frozen=True)
class Rules:
    account: float
    target: float
    max_loss: float
    trailing: bool
    daily_limit: float | None
    consistency: float | None
    min_days: int
    max_days: int
    winning_day: float = 150.0
    min_winning_days: int = 5


def hashed_index(seed: Column, n: Column) -> Column:
    """A reproducible draw from 0..n-1, out of 60 bits."""
    return F.conv(F.substring(F.md5(seed), 1, 15), 16, 10).cast("long") % n


def with_period(returns: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Number the periods of each book; with one row per period the window is calendar-bounded."""
    w = Window.partitionBy(*keys)
    return (returns.withColumn("t", (F.row_number().over(w.orderBy(*order)) - 1).cast("long"))
            .withColumn("n", F.count(F.lit(1)).over(w)))


def every_start(returns: DataFrame, keys: list[str], rules: Rules) -> DataFrame:
    """Each return belongs to the starts whose horizon reaches it; no join is needed."""
    first = F.greatest(F.col("t") - rules.max_days + 1, F.lit(0))
    return (returns.withColumn("path", F.explode(F.sequence(first, F.col("t"))))
            .filter(F.col("path") < F.col("n") - rules.min_days)
            .select(*keys, "path", (F.col("t") - F.col("path") + 1).alias("day"), "ret"))


def block_paths(returns: DataFrame, keys: list[str], paths: int, length: int, block: int = 20) -> DataFrame:
    """Resampled paths made of blocks of consecutive returns, by hashed block starts."""
    n = returns.groupBy(*keys).agg(F.max("n").alias("n"))
    blocks = -(-length // block)
    d = n.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1)))).repartition(*keys, "path")
    d = d.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    seed = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.col("path").cast("string"), F.col("_b").cast("string"))
    d = d.withColumn("_start", hashed_index(seed, F.col("n") - block))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    d = d.select(*keys, "path", (F.col("_b") * block + F.col("_o") + 1).alias("day"), (F.col("_start") + F.col("_o")).alias("t"))
    return d.filter(F.col("day") <= length).join(returns.select(*keys, "t", "ret"), [*keys, "t"]).drop("t")


def _equity(paths: DataFrame, keys: list[str], rules: Rules, risks: list[float]) -> tuple[DataFrame, list[str]]:
    d = paths.withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in risks])))
    ids = [*keys, "k", "path"]
    w = Window.partitionBy(*ids).orderBy("day")
    run, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    growth = 1.0 + F.col("k") * F.col("ret")
    log = F.when(growth > 0, F.ln(F.when(growth > 0, growth))).otherwise(-700.0)
    acc = F.lit(float(rules.account))
    d = d.withColumn("equity", acc * F.exp(F.sum(log).over(run)))
    d = (d.withColumn("sod", F.coalesce(F.lag("equity").over(w), acc))
          .withColumn("high", F.greatest(F.coalesce(F.max("equity").over(before), acc), acc)))
    return d, ids


def walk(paths: DataFrame, keys: list[str], rules: Rules, risks: list[float]) -> DataFrame:
    """Outcome and days of each path at each risk multiple.

    Within a day the daily limit is tested first, then the loss floor (from the high-water mark
    of the days before), then the target with its consistency rule."""
    d, ids = _equity(paths, keys, rules, risks)
    run = Window.partitionBy(*ids).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    gain = F.col("equity") - F.col("sod")
    d = d.withColumn("best", F.greatest(F.max(gain).over(run), F.lit(0.0)))
    floor = F.col("high") - rules.max_loss if rules.trailing else F.lit(float(rules.account - rules.max_loss))
    profit = F.col("equity") - rules.account
    won = (profit >= rules.target) & (F.col("day") >= rules.min_days)
    if rules.consistency is not None:
        won = won & (F.col("best") <= rules.consistency * profit)
    event = F.when(F.col("equity") <= floor, "max_loss").when(won, "pass")
    if rules.daily_limit is not None:
        event = F.when(-gain >= rules.daily_limit, "daily_limit").otherwise(event)
    d = d.withColumn("_e", event)
    at = F.when(F.col("_e").isNotNull(), F.col("day"))
    return d.groupBy(*ids).agg(F.coalesce(F.min_by("_e", at), F.lit("timeout")).alias("outcome"),
                               F.coalesce(F.min(at), F.max("day")).cast("long").alias("days"))


def tally(walked: DataFrame, keys: list[str]) -> DataFrame:
    """Outcome shares per book and risk, and the median days to pass."""
    def share(o):
        return F.avg(F.when(F.col("outcome") == o, 1.0).otherwise(0.0))

    return walked.groupBy(*keys, "k").agg(
        F.count(F.lit(1)).alias("paths"), share("pass").alias("p_pass"), share("max_loss").alias("p_max_loss"),
        share("daily_limit").alias("p_daily"), share("timeout").alias("p_timeout"),
        F.median(F.when(F.col("outcome") == "pass", F.col("days"))).alias("median_days_to_pass"))


def best_risk(tallied: DataFrame, keys: list[str]) -> DataFrame:
    """The risk multiple with the highest pass rate; the larger one on ties."""
    return tallied.groupBy(*keys).agg(F.max_by(F.struct("k", "p_pass", "p_max_loss", "p_daily", "p_timeout"),
                                               F.struct("p_pass", "k")).alias("b")).select(*keys, "b.*")


def survival(paths: DataFrame, keys: list[str], rules: Rules, risks: list[float], horizon: int = 252) -> DataFrame:
    """Alive and payable shares at the horizon; the trailing floor locks at the account once the
    high-water mark has risen by the limit."""
    d, ids = _equity(paths.filter(F.col("day") <= horizon), keys, rules, risks)
    if rules.trailing:
        floor = F.when(F.col("high") >= rules.account + rules.max_loss, F.lit(float(rules.account))).otherwise(
            F.col("high") - rules.max_loss)
    else:
        floor = F.lit(float(rules.account - rules.max_loss))
    d = d.withColumn("_died", F.when(F.col("equity") <= floor, F.col("day")))
    win = F.when(F.col("equity") - F.col("sod") >= rules.winning_day, 1).otherwise(0)
    p = d.groupBy(*ids).agg(F.min("_died").alias("died"), F.sum(win).alias("wins"))
    alive = F.col("died").isNull()
    pays = alive & (F.col("wins") >= rules.min_winning_days)
    return p.groupBy(*keys, "k").agg(
        F.count(F.lit(1)).alias("paths"), F.avg(F.when(alive, 1.0).otherwise(0.0)).alias("p_alive"),
        F.avg(F.when(pays, 1.0).otherwise(0.0)).alias("p_payable"), F.median("died").alias("median_days_alive"))


def risk_profile(returns: DataFrame, keys: list[str], risks: list[float], periods: int = 252) -> DataFrame:
    """Annual volatility and deepest drawdown at each risk multiple."""
    d = returns.withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in risks])))
    d = d.withColumn("_r", F.col("k") * F.col("ret"))
    run = Window.partitionBy(*keys, "k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_eq", F.exp(F.sum(F.ln(F.greatest(1.0 + F.col("_r"), F.lit(1e-300)))).over(run)))
    d = d.withColumn("_dd", 1.0 - F.col("_eq") / F.max("_eq").over(run))
    return d.groupBy(*keys, "k").agg((F.stddev_samp("_r") * float(periods) ** 0.5).alias("vol"), F.max("_dd").alias("max_dd"))


SEGMENT = 4096


def monte_carlo(returns: DataFrame, keys: list[str], paths: int, penalty: float = 0.0) -> DataFrame:
    """Resampled trade sequences: final-return and drawdown quantiles, and the chance of a loss.

    returns: keys, t, n, ret. A path as long as the trade list is cut into segments; a segment
    keeps its log growth, highest and lowest level and deepest fall, and a path is put together
    from its segments."""
    counts = returns.groupBy(*keys).agg(F.max("n").alias("n"))
    d = counts.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1)))).withColumn(
        "_seg", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SEGMENT))))
    d = d.repartition(*keys, "path", "_seg")
    last = F.least(F.col("_seg") * SEGMENT + SEGMENT, F.col("n")) - 1
    d = d.withColumn("step", F.explode(F.sequence(F.col("_seg") * SEGMENT, last)))
    seed = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.col("path").cast("string"), F.col("step").cast("string"))
    d = d.withColumn("t", hashed_index(seed, F.col("n"))).join(returns.select(*keys, "t", "ret"), [*keys, "t"])
    growth = 1.0 + F.col("ret") - penalty
    log = F.when(growth > 0, F.ln(F.when(growth > 0, growth))).otherwise(-700.0)
    ids = [*keys, "path"]
    w = Window.partitionBy(*ids, "_seg").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_l", F.sum(log).over(w))
    d = d.withColumn("_fall", F.max("_l").over(w) - F.col("_l"))
    s = d.groupBy(*ids, "_seg").agg(F.max_by("_l", "step").alias("_sum"), F.max("_l").alias("_hi"),
                                    F.min("_l").alias("_lo"), F.max("_fall").alias("_fall"))
    ws = Window.partitionBy(*ids).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_off", F.coalesce(F.sum("_sum").over(ws), F.lit(0.0)))
    s = s.withColumn("_peak", F.max(F.col("_off") + F.col("_hi")).over(ws))
    fall = F.greatest(F.col("_fall"), F.col("_peak") - (F.col("_off") + F.col("_lo")))
    p = s.groupBy(*ids).agg((F.exp(F.sum("_sum")) - 1.0).alias("final"), (1.0 - F.exp(-F.max(fall))).alias("dd"))
    return p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("paths"), F.median("final").alias("median_return"), F.percentile("final", 0.05).alias("p05_return"),
        F.percentile("dd", 0.95).alias("p95_drawdown"), F.median("dd").alias("median_drawdown"), F.max("dd").alias("worst_drawdown"),
        F.avg(F.when(F.col("final") < 0, 1.0).otherwise(0.0)).alias("prob_loss"))
