"""Block-resampled paths at full size, put together from summaries of their blocks.

A block of consecutive returns is the same wherever it is drawn: its log growth, its highest and lowest
level and its largest daily gain and loss, all relative to the equity that enters it, are worked out
once per block start and risk level. Along a path these summaries compose: what enters a block (equity,
high-water mark, best day) is a prefix over the blocks before it, so a path of 400 days is 20 rows. Only
blocks in which the summaries allow an event are looked at day by day, and no day becomes a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.passage import Rules, hashed_index
from tidemark.session import materialize

#: Log growth of a day that loses everything.
RUINED = -700.0


def blocks(returns: DataFrame, keys: list[str], risks: list[float], block: int) -> DataFrame:
    """returns (keys, t, n, ret; one row per period) -> keys, start and by risk level k: the log growth
    after each day (`path`, from 0 on), its extremes, the gain of each day and the extremes of those."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(0, block - 1)
    d = returns.select(*keys, F.col("t").alias("start"), F.collect_list("ret").over(w).alias("_r")).filter(F.size("_r") == block)
    d = d.withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in risks])))

    def grown(path: Column, ret: Column) -> Column:
        growth = 1.0 + F.col("k") * ret
        return F.concat(path, F.array(F.element_at(path, -1) + F.when(growth > 0, F.ln(growth)).otherwise(RUINED)))

    d = d.withColumn("path", F.aggregate("_r", F.array(F.lit(0.0)), grown)).drop("_r")
    days = F.sequence(F.lit(1), F.lit(block))
    d = d.withColumn("gains", F.transform(days, lambda i: F.exp(F.get("path", i)) - F.exp(F.get("path", i - 1))))
    later = F.slice("path", 2, block)
    s = F.struct("k", "path", "gains", F.get("path", F.lit(block)).alias("total"), F.array_max(later).alias("top"), F.array_min(later).alias("low"),
                 F.array_max("gains").alias("best"), F.array_min("gains").alias("worst"))
    return d.groupBy(*keys, "start").agg(F.collect_list(s).alias("levels"))


def entered(returns: DataFrame, keys: list[str], rules: Rules, risks: list[float], paths: int, length: int, block: int = 20) -> DataFrame:
    """A row per path, risk level and block of hashed draws: the block's summaries, and what enters it:
    `eq`, `high` and `best` (so far; the account and 0 at first)."""
    n = returns.groupBy(*keys).agg(F.max("n").alias("n")).filter(F.col("n") > block)
    d = n.withColumn("path_no", F.explode(F.sequence(F.lit(0), F.lit(paths - 1)))).repartition(*keys, "path_no")
    d = d.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(-(-length // block) - 1))))
    seed = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.col("path_no").cast("string"), F.col("b").cast("string"))
    d = d.select(*keys, "path_no", "b", hashed_index(seed, F.col("n") - block).alias("start"))
    d = d.join(materialize(blocks(returns, keys, risks, block)), [*keys, "start"]).select(*keys, "path_no", "b", F.inline("levels"))
    ids = [*keys, "k", "path_no"]
    acc = F.lit(float(rules.account))
    before = Window.partitionBy(*ids).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("eq", acc * F.exp(F.coalesce(F.sum("total").over(before), F.lit(0.0))))
    return (d.withColumn("high", F.greatest(F.coalesce(F.max(F.col("eq") * F.exp("top")).over(before), acc), acc))
            .withColumn("best_day", F.greatest(F.coalesce(F.max(F.col("eq") * F.col("best")).over(before), F.lit(0.0)), F.lit(0.0))))


def _scan(event, block: int, days: Column) -> Column:
    """First (day in block, event) of a block, walked day by day: `event(i, equity, high before, gain,
    best so far)` is a Column, null on a quiet day."""
    start = F.struct(F.lit(None).cast("int").alias("day"), F.lit(None).cast("string").alias("what"), F.col("high").alias("high"), F.col("best_day").alias("best"))

    def step(s: Column, i: Column) -> Column:
        equity = F.col("eq") * F.exp(F.get("path", i))
        gain = F.col("eq") * F.get("gains", i - 1)
        best = F.greatest(s["best"], gain)
        now = F.when(i <= days, event(i, equity, s["high"], gain, best))
        return F.when(s["what"].isNotNull(), s).otherwise(
            F.struct(F.when(now.isNotNull(), i).alias("day"), now.alias("what"), F.greatest(s["high"], equity).alias("high"), best.alias("best")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(block)), start, step, lambda s: F.struct(s["day"].alias("day"), s["what"].alias("what")))


def walk(returns: DataFrame, keys: list[str], rules: Rules, risks: list[float], paths: int, block: int = 20) -> DataFrame:
    """Outcome and days of every resampled path at every risk level: keys, k, path, outcome, days.

    Within a day the daily limit is tested first, then the loss floor (from the high-water mark of the
    days before), then the target with its consistency rule."""
    length = rules.max_days
    d = entered(returns, keys, rules, risks, paths, length, block)
    days = F.least(F.lit(length) - F.col("b") * block, F.lit(block))
    acc = float(rules.account)
    top, low = F.col("eq") * F.exp("top"), F.col("eq") * F.exp("low")
    possible = top - acc >= rules.target
    possible |= (F.greatest("high", top) - low >= rules.max_loss) if rules.trailing else (low <= acc - rules.max_loss)
    if rules.daily_limit is not None:
        possible |= -F.col("eq") * F.col("worst") >= rules.daily_limit

    def event(i, equity, high, gain, best):
        profit = equity - acc
        won = (profit >= rules.target) & (F.col("b") * block + i >= rules.min_days)
        if rules.consistency is not None:
            won = won & (best <= rules.consistency * profit)
        floor = high - rules.max_loss if rules.trailing else F.lit(acc - rules.max_loss)
        lost = F.when(equity <= floor, "max_loss").when(won, "pass")
        return F.when(-gain >= rules.daily_limit, "daily_limit").otherwise(lost) if rules.daily_limit is not None else lost

    d = d.withColumn("_e", F.when(possible, _scan(event, block, days)))
    first = F.when(F.col("_e.what").isNotNull(), F.struct((F.col("b") * block + F.col("_e.day")).alias("day"), F.col("_e.what").alias("what")))
    g = d.groupBy(*keys, "k", F.col("path_no").alias("path")).agg(F.min(first).alias("_f"))
    return g.select(*keys, "k", "path", F.coalesce("_f.what", F.lit("timeout")).alias("outcome"), F.coalesce("_f.day", F.lit(length)).cast("long").alias("days"))


def survival(returns: DataFrame, keys: list[str], rules: Rules, risks: list[float], paths: int, horizon: int = 252, block: int = 20) -> DataFrame:
    """Alive and payable shares at the horizon; a trailing floor locks at the account once the high-water
    mark has risen by the limit: keys, k, paths, p_alive, p_payable, median_days_alive."""
    d = entered(returns, keys, rules, risks, paths, horizon, block)
    days = F.least(F.lit(horizon) - F.col("b") * block, F.lit(block))
    acc = float(rules.account)
    floor = lambda high: (F.when(high >= acc + rules.max_loss, F.lit(acc)).otherwise(high - rules.max_loss)
                          if rules.trailing else F.lit(acc - rules.max_loss))
    # the floor never falls, so it is highest behind the block's top
    possible = F.col("eq") * F.exp("low") <= F.greatest(floor(F.col("high")), floor(F.greatest("high", F.col("eq") * F.exp("top"))))
    d = d.withColumn("_e", F.when(possible, _scan(lambda i, equity, high, gain, best: F.when(equity <= floor(high), "died"), block, days)))
    wins = F.when(F.col("eq") * F.col("best") >= rules.winning_day,
                  F.size(F.filter(F.slice("gains", F.lit(1), days), lambda g: F.col("eq") * g >= rules.winning_day))).otherwise(0)
    p = d.groupBy(*keys, "k", "path_no").agg(F.min(F.when(F.col("_e.what").isNotNull(), F.col("b") * block + F.col("_e.day"))).alias("died"), F.sum(wins).alias("wins"))
    alive = F.col("died").isNull()
    return p.groupBy(*keys, "k").agg(
        F.count(F.lit(1)).alias("paths"), F.avg(F.when(alive, 1.0).otherwise(0.0)).alias("p_alive"),
        F.avg(F.when(alive & (F.col("wins") >= rules.min_winning_days), 1.0).otherwise(0.0)).alias("p_payable"), F.median("died").alias("median_days_alive"))
