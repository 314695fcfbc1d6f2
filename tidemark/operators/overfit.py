"""Statistics that account for sample length, shape and the number of trials.

The data pass is a grouped aggregate; closed forms run on the grouped rows."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.chunks import array_split_id
from tidemark.functions.distributions import norm_cdf, norm_ppf, normal_quantile

# Fixed value: Euler-Mascheroni constant.
EULER = 0.5772156649015329


def return_moments(returns: DataFrame, keys: list[str], ret: str = "ret") -> DataFrame:
    """n, Sharpe, and skew and kurtosis standardised by the sample deviation."""
    g = returns.groupBy(*keys).agg(
        F.count(ret).alias("n"), F.coalesce(F.try_divide(F.avg(ret), F.stddev_samp(ret)), F.lit(0.0)).alias("sharpe"),
        F.stddev_samp(ret).alias("sd"), F.skewness(ret).alias("_s"), F.kurtosis(ret).alias("_k"))
    shrink = (F.col("n") - 1) / F.col("n")
    return (g.withColumn("skew", F.col("_s") * F.pow(shrink, F.lit(1.5)))
            .withColumn("kurt", (F.col("_k") + 3) * F.pow(shrink, F.lit(2.0))).drop("_s", "_k"))


def _variance_term() -> Column:
    sr = F.col("sharpe")
    return 1.0 - F.col("skew") * sr + (F.col("kurt") - 1.0) / 4.0 * sr * sr


def probabilistic_sharpe(moments: DataFrame, benchmark: Column | float = 0.0, out: str = "psr") -> DataFrame:
    """P(true Sharpe > benchmark)."""
    b = benchmark if isinstance(benchmark, Column) else F.lit(float(benchmark))
    v = _variance_term()
    ok = (F.col("n") >= 3) & (F.col("sd") > 0) & (v > 0)
    z = F.when(ok, (F.col("sharpe") - b) * F.sqrt(F.col("n") - 1) / F.sqrt(F.greatest(v, F.lit(1e-300))))
    return moments.withColumn("_z", z).withColumn(out, F.coalesce(norm_cdf("_z"), F.lit(0.0))).drop("_z")


def expected_max_sharpe(n_trials: Column, variance: Column) -> Column:
    """The Sharpe the best of n worthless trials is expected to show."""
    n = n_trials.cast("double")
    a = norm_ppf(F.when(n >= 2, 1.0 - 1.0 / n))
    b = norm_ppf(F.when(n >= 2, 1.0 - 1.0 / (n * math.e)))
    return F.when((n >= 2) & (variance > 0), F.sqrt(variance) * ((1.0 - EULER) * a + EULER * b)).otherwise(0.0)


def deflated_sharpe(moments: DataFrame, trials: DataFrame, n_trials: int) -> DataFrame:
    """PSR against the expected maximum, with the variance measured over the trials' Sharpes
    (column sharpe). The count is the larger of the declared and the measured."""
    t = trials.agg(F.var_samp("sharpe").alias("_var"), F.count("sharpe").alias("_nt")).select(
        expected_max_sharpe(F.greatest("_nt", F.lit(n_trials)), F.coalesce("_var", F.lit(0.0))).alias("sr0"))
    return probabilistic_sharpe(moments.withColumn("sr0", t.scalar()), F.col("sr0"), "dsr")


def min_track_record(moments: DataFrame, benchmark: float = 0.0, confidence: float = 0.95) -> DataFrame:
    """Observations needed before the Sharpe is significant; infinite without an edge."""
    edge = F.col("sharpe") - benchmark
    need = 1.0 + _variance_term() / F.nullif(edge * edge, F.lit(0.0)) * normal_quantile(confidence) ** 2
    return moments.withColumn("min_track_record", F.when((F.col("n") < 3) | (edge <= 0), F.lit(float("inf"))).otherwise(need))


def aligned(returns: DataFrame, config: str, t: str, ret: str) -> DataFrame:
    """Only the periods on which every configuration that is found has a value."""
    known = returns.filter(F.col(ret).isNotNull())
    every = known.agg(F.count_distinct(config).alias("_all")).scalar()
    full = known.groupBy(t).agg(F.count_distinct(config).alias("_n"))
    return known.join(full.filter(F.col("_n") == every).select(t), t, "left_semi")


def pbo_splits(returns: DataFrame, partitions: int = 8, config: str = "config", t: str = "t", ret: str = "ret") -> DataFrame:
    """Per way of choosing half the blocks in sample: the winner, its rank out of sample, logit.

    Each (block, configuration) is reduced to count, mean and squared deviations once; the
    splits combine those few rows and never read the returns again."""
    if partitions % 2 or partitions < 4:
        raise ValueError("partitions must be even and at least 4")
    one = Window.partitionBy(F.lit(1))
    times = returns.select(t).distinct()  # one row per period: bounded by the calendar
    times = times.withColumn("_blk", array_split_id(F.row_number().over(one.orderBy(t)), F.count(F.lit(1)).over(one), partitions))
    stats = (returns.join(times, t).groupBy("_blk", config)
             .agg(F.count(ret).alias("n"), F.avg(ret).alias("m"), (F.var_pop(ret) * F.count(ret)).alias("m2")))
    combos = list(combinations(range(partitions), partitions // 2))
    split = F.explode(F.array(*[F.struct(F.lit(i).alias("split"), F.array(*[F.lit(b) for b in c]).alias("blocks"))
                                for i, c in enumerate(combos)]))
    s = stats.withColumn("_s", split)
    s = s.select("_s.split", F.array_contains("_s.blocks", F.col("_blk")).alias("ins"), config, "n", "m", "m2")
    g = s.groupBy("split", config, "ins").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s1"),
                                              F.sum(F.col("m2") + F.col("n") * F.col("m") * F.col("m")).alias("s2"))
    mean = F.col("s1") / F.col("n")
    var = (F.col("s2") - F.col("s1") * mean) / (F.col("n") - 1)
    g = g.withColumn("sr", F.when(var > 0, mean / F.sqrt(F.greatest(var, F.lit(1e-300)))).otherwise(0.0))
    wide = g.groupBy("split", config).agg(F.max(F.when(F.col("ins"), F.col("sr"))).alias("is_sr"),
                                          F.max(F.when(~F.col("ins"), F.col("sr"))).alias("oos_sr"))
    w = Window.partitionBy("split")
    wide = (wide.withColumn("_best", F.row_number().over(w.orderBy(F.desc("is_sr"), config)))
            .withColumn("_rank", F.row_number().over(w.orderBy("oos_sr", config)))
            .withColumn("_n", F.count(F.lit(1)).over(w)))
    r = F.col("_rank") / (F.col("_n") + 1)
    return wide.filter(F.col("_best") == 1).select(
        "split", F.col(config).alias("winner"), "is_sr", F.col("oos_sr").alias("winner_oos_sr"), r.alias("oos_rank"),
        F.ln(r / (1 - r)).alias("logit"))


def pbo(splits: DataFrame) -> DataFrame:
    """Share of splits whose winner falls to the median or below, with its verdict."""
    d = splits.agg(F.avg(F.when(F.col("logit") <= 0, 1.0).otherwise(0.0)).alias("pbo"), F.count(F.lit(1)).alias("splits"))
    p = F.col("pbo")
    return d.withColumn("verdict", F.when(p < 0.10, "selection looks sound").when(p < 0.20, "acceptable")
                        .when(p < 0.50, "OVERFIT").otherwise("SEVERELY OVERFIT"))


def walk_forward(trades: DataFrame, folds: int = 6, min_trades: int = 3) -> DataFrame:
    """Expanding folds over the calendar after the first: trades, expectancy, and whether positive.

    trades: exit_ts, r_multiple. They are summed per day, days are cut into blocks, and block
    totals accumulate."""
    one = Window.partitionBy(F.lit(1))
    days = trades.groupBy(F.to_date("exit_ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("r_multiple").alias("s"))
    days = days.withColumn("fold", array_split_id(F.row_number().over(one.orderBy("day")), F.count(F.lit(1)).over(one), folds))
    f = days.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("day").alias("end_day"))
    run = one.orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    d = f.select("fold", "end_day", F.sum("n").over(run).alias("trades"), F.sum("s").over(run).alias("_s"))
    d = d.filter((F.col("fold") > 0) & (F.col("trades") >= min_trades))
    return d.withColumn("expectancy_r", F.col("_s") / F.col("trades")).withColumn("positive", F.col("expectancy_r") > 0).drop("_s")


def gates(metrics: DataFrame, thresholds: list[tuple[str, str, float]], keys: list[str]) -> DataFrame:
    """Declared thresholds over a wide metrics row: one PASS or FAIL row per gate."""
    rows = []
    for name, op, th in thresholds:
        c = F.col(name).cast("double")
        ok = c >= th if op == ">=" else c <= th
        rows.append(F.struct(F.lit(name).alias("gate"), c.alias("observed"), F.lit(op).alias("op"),
                             F.lit(float(th)).alias("threshold"), F.coalesce(ok, F.lit(False)).alias("passed")))
    return metrics.select(*keys, F.explode(F.array(*rows)).alias("g")).select(*keys, "g.*")


def gate_verdict(gated: DataFrame, keys: list[str]) -> DataFrame:
    """Overall result per key and the gates that blocked it."""
    return gated.groupBy(*keys).agg(
        F.bool_and("passed").alias("passed"), F.sum(F.when(F.col("passed"), 1).otherwise(0)).alias("gates_passed"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("gate")))), ",").alias("blocked"))


def compare_runs(metrics: DataFrame, key: str, base, other, columns: dict[str, bool]) -> DataFrame:
    """Metric-by-metric winner of two saved runs; True in `columns` means larger is better."""
    items = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v"), F.lit(up).alias("up"))
                      for c, up in columns.items()])
    long = metrics.filter(F.col(key).isin(base, other)).select(key, F.explode(items).alias("m")).select(key, "m.*")
    g = long.groupBy("metric", "up").agg(F.max(F.when(F.col(key) == base, F.col("v"))).alias("base"),
                                         F.max(F.when(F.col(key) == other, F.col("v"))).alias("other"))
    better = F.when(F.col("up"), F.col("other") > F.col("base")).otherwise(F.col("other") < F.col("base"))
    return g.select("metric", "base", "other", F.when(F.col("base") == F.col("other"), "tie")
                    .when(better, "other").otherwise("base").alias("winner"))


def calibration_report(scored: DataFrame, bins: int = 10, p: str = "p", y: str = "y", keys=()) -> DataFrame:
    """Reliability bins: predicted and observed frequency, count, overconfidence."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    g = scored.groupBy(*keys, F.greatest(b, F.lit(0)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed"))
    return g.withColumn("overconfident", F.col("predicted") - F.col("observed") > 0.10)


def brier(scored: DataFrame, p: str = "p", y: str = "y", keys=()) -> DataFrame:
    """Brier score of the model and of the base rate, and the share kept at one half."""
    yy = F.col(y).cast("double")
    g = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col(p) - yy, F.lit(2))).alias("brier"),
                                  F.avg(yy).alias("base_rate"), F.avg(F.when(F.col(p) >= 0.5, 1.0).otherwise(0.0)).alias("kept"))
    return g.withColumn("brier_base", F.col("base_rate") * (1 - F.col("base_rate")))
