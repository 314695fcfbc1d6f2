"""Hypothesis screens: every signal over every symbol from one scan, scored with its trial count."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.functions.distributions import normal_quantile, t_two_sided

KEYS = ["symbol"]


@dataclass(frozen=True)
class Hypothesis:
    """A causal signal column in {-1, 0, +1}, held for `horizon` bars, with its reason."""

    name: str
    why: str
    horizon: int
    signal: Callable[[], Column]


def _is(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def weekday(day: int):
    return lambda: _is(F.weekday("ts") == day)


def hour(h: int):
    return lambda: _is(F.hour("ts") == h)


def turn_of_month():
    """The two bars on either side of a month boundary; reads the calendar, never prices."""
    w, m = I.by(), F.month("ts")
    edge = F.lit(False)
    for k in (1, 2):
        edge = edge | F.coalesce(F.lead(m, k).over(w) != m, F.lit(False)) | F.coalesce(F.lag(m, k).over(w) != m, F.lit(False))
    return _is(edge & F.lead("ts", 2).over(w).isNotNull())


def momentum(k: int):
    return lambda: F.signum(I.rolling_return(k))


def reversal(k: int):
    return lambda: -F.signum(I.rolling_return(k))


def _step() -> Column:
    return F.signum(F.col("_chg"))


def streak_fade(k: int):
    def f():
        w = I.trailing(k)
        full = F.count("_chg").over(w) >= k
        return F.when(full & (F.min(_step()).over(w) > 0), -1.0).when(full & (F.max(_step()).over(w) < 0), 1.0).otherwise(0.0)
    return f


def range_expansion():
    return F.when(F.col("high") - F.col("low") > 2.0 * F.col("atr"), _step()).otherwise(0.0)


def narrow_range_breakout():
    w5, w20 = I.by().rowsBetween(-5, -1), I.by().rowsBetween(-20, -1)
    span = F.col("high") - F.col("low")
    narrow = (F.count(span).over(w20) >= 20) & (I.prev("_range") < F.avg(span).over(w20) * 0.6)
    full = F.count("high").over(w5) >= 5
    side = F.when(full & (F.col("close") > F.max("high").over(w5)), 1.0).when(
        full & (F.col("close") < F.min("low").over(w5)), -1.0).otherwise(0.0)
    return F.when(F.coalesce(narrow, F.lit(False)), side).otherwise(0.0)


def us_open_continuation():
    """Direction of the first half hour of the US cash session, on 15-minute bars."""
    open_hour = F.when(F.month("ts").between(4, 10), 13).otherwise(14)
    at = (F.hour("ts") == open_hour) & (F.minute("ts") == 45)
    return F.when(at, F.signum(F.col("close") - I.prev("open"))).otherwise(0.0)


def us_open_fade():
    return -us_open_continuation()


def overnight_long():
    return _is(F.hour("ts") == F.when(F.month("ts").between(4, 10), 20).otherwise(21))


def london_open():
    return F.when(F.hour("ts") == 7, F.signum(F.col("close") - F.col("open"))).otherwise(0.0)


def asian_range_break():
    """At 07:00, close beyond the range of the day's hours before 07:00."""
    day = Window.partitionBy(*KEYS, F.to_date("ts"))
    early = F.hour("ts") < 7
    hi, lo = F.max(F.when(early, F.col("high"))).over(day), F.min(F.when(early, F.col("low"))).over(day)
    at = F.hour("ts") == 7
    return F.when(at & (F.col("close") > hi), 1.0).when(at & (F.col("close") < lo), -1.0).otherwise(0.0)


def follows(column: str) -> Column:
    """Direction of another asset's known move; no view without one."""
    return F.coalesce(F.signum(column), F.lit(0.0))


def spec_extreme_fade():
    x = F.col("cot_spec_net_index")
    return F.when(x > 0.9, -1.0).when(x < 0.1, 1.0).otherwise(0.0)


def spec_change_follow():
    return F.signum("cot_spec_net_chg4")


def commercial_lead():
    x = F.col("cot_comm_net_index")
    return F.when(x > 0.8, 1.0).when(x < 0.2, -1.0).otherwise(0.0)


def spec_minus_commercial():
    d = F.col("cot_spec_net_index") - F.col("cot_comm_net_index")
    return F.when(d > 0.6, -1.0).when(d < -0.6, 1.0).otherwise(0.0)


DAILY = [
    Hypothesis("monday_long", "weekend information arrives on Monday", 1, weekday(0)),
    Hypothesis("friday_long", "positions are squared before the weekend", 1, weekday(4)),
    Hypothesis("turn_of_month", "flows at month boundaries", 1, turn_of_month),
    Hypothesis("reversal_1", "short-horizon overreaction", 1, reversal(1)),
    Hypothesis("reversal_5", "one-week overreaction", 5, reversal(5)),
    Hypothesis("momentum_20", "one-month continuation", 5, momentum(20)),
    Hypothesis("momentum_120", "six-month continuation", 10, momentum(120)),
    Hypothesis("momentum_250", "twelve-month continuation", 20, momentum(250)),
    Hypothesis("streak3_fade", "three same-direction bars exhaust the flow", 1, streak_fade(3)),
    Hypothesis("range_expansion", "a two-ATR bar is news, and news trends", 3, range_expansion),
    Hypothesis("narrow_range_breakout", "compression precedes expansion", 3, narrow_range_breakout),
]
INTRADAY = [
    Hypothesis("overnight_long", "inventory premium overnight", 16, overnight_long),
    Hypothesis("london_open", "arriving liquidity sets the direction", 4, london_open),
    Hypothesis("asian_range_break", "break of the quiet hours' range", 8, asian_range_break),
]
US_OPEN = [
    Hypothesis("us_open_continuation", "the opening imbalance persists", 24, us_open_continuation),
    Hypothesis("us_open_fade", "the opening imbalance is absorbed", 24, us_open_fade),
]
#: Rollover hours, whose quoted spreads make bid-based bars meaningless.
EXCLUDED_HOURS = {20, 21, 22, 23, 0, 1}
HOURS = [Hypothesis(f"hour_{h:02d}_long", "time-of-day flow", 1, hour(h))
         for h in range(24) if h not in EXCLUDED_HOURS]
POSITIONING = [
    Hypothesis(name, why, h, f)
    for name, why, f in (
        ("spec_extreme_fade", "crowded speculators revert", spec_extreme_fade),
        ("spec_change_follow", "four-week changes continue", spec_change_follow),
        ("commercial_lead", "follow the hedgers", commercial_lead),
        ("spec_minus_commercial", "fade the widest disagreement", spec_minus_commercial))
    for h in (5, 20)]
DRIFT = "_all"


def prepare(bars: DataFrame) -> DataFrame:
    return (I.with_atr(bars).withColumn("_chg", I.change("close"))
            .withColumn("_range", F.col("high") - F.col("low"))
            .withColumn("idx", F.row_number().over(I.by()) - 1))


def _observe(prepared: DataFrame, items: list[tuple[str, int, Column]], warmup: int) -> DataFrame:
    horizons = sorted({h for _, h, _ in items})
    fwd = {h: F.try_divide(F.lead("close", h).over(I.by()) - F.col("close"), F.col("atr")) for h in horizons}
    d = prepared.select(*KEYS, "ts", "idx", *[fwd[h].alias(f"_f{h}") for h in horizons],
                        *[c.cast("double").alias(f"_s{i}") for i, (_, _, c) in enumerate(items)])
    long = F.explode(F.array(*[
        F.struct(F.lit(n).alias("hypothesis"), F.lit(h).alias("horizon"),
                 F.col(f"_s{i}").alias("sig"), F.col(f"_f{h}").alias("fwd")) for i, (n, h, _) in enumerate(items)]))
    return (d.filter(F.col("idx") >= warmup).select(*KEYS, "ts", "idx", long.alias("o")).select(*KEYS, "ts", "idx", "o.*")
            .filter(F.col("fwd").isNotNull() & F.col("sig").isNotNull() & (F.col("sig") != 0)))


def stack(bars: DataFrame, registry: list[Hypothesis], warmup: int = 300) -> DataFrame:
    """Long observations (hypothesis, symbol, horizon, idx, ts, sig, fwd) from one pass."""
    return _observe(prepare(bars), [(h.name, h.horizon, h.signal()) for h in registry], warmup)


def whole_sample(bars: DataFrame, registry: list[Hypothesis], warmup: int = 300) -> DataFrame:
    """A constant signal per horizon: what the forward return is when nothing is asked."""
    return _observe(prepare(bars), [(DRIFT, h, F.lit(1.0)) for h in sorted({x.horizon for x in registry})], warmup)


BLOCK = 256


def nonoverlap(obs: DataFrame, keys: list[str], horizon: str = "horizon", idx: str = "idx") -> DataFrame:
    """Greedy thinning: keep a row only if its index is at least `horizon` past the last kept one.

    Indices are cut into blocks. For each block the next allowed index is worked out for every
    state it can be entered in (there are at most `horizon`); those tables are chained over the
    key's blocks, and then each block is thinned on its own. Rows travel inside their block; a key's
    tables hold `horizon` numbers for every 256 rows."""
    base, h = F.col("_blk") * BLOCK, F.col(horizon)
    rest = [c for c in obs.columns if c not in keys and c != horizon]
    row = F.struct(F.col(idx).cast("long").alias("_i"), *rest)
    blocks = (obs.filter(h > 1).groupBy(*keys, horizon, F.floor(F.col(idx) / BLOCK).alias("_blk"))
              .agg(F.array_sort(F.collect_list(row)).alias("_rows")))
    leave = F.transform(F.sequence(F.lit(0).cast("long"), h.cast("long") - 1), lambda s: F.aggregate(
        F.col("_rows"), base + s, lambda nxt, r: F.when(r["_i"] >= nxt, r["_i"] + h).otherwise(nxt)))
    # a key's tables meet once; one pass over them gives the state in which each block is entered
    keyed = [*keys, horizon]
    step = lambda nxt, e: F.when(nxt - e["base"] >= F.size(e["out"]), nxt).otherwise(
        F.element_at(e["out"], (F.greatest(nxt - e["base"], F.lit(0)) + 1).cast("int")))
    tables = (blocks.select(*keyed, F.struct("_blk", base.alias("base"), leave.alias("out")).alias("_t"))
              .groupBy(*keyed).agg(F.array_sort(F.collect_list("_t")).alias("_t")))
    entered = F.aggregate(
        F.col("_t"), F.struct(F.lit(0).cast("long").alias("nxt"), F.array().cast("array<bigint>").alias("at")),
        lambda a, e: F.struct(step(a["nxt"], e).alias("nxt"), F.array_append(a["at"], a["nxt"]).alias("at")), lambda a: a["at"])
    starts = tables.select(*keyed, F.explode(F.arrays_zip(F.col("_t._blk").alias("_blk"), entered.alias("_start"))).alias("x"))
    blocks = blocks.join(starts.select(*keyed, "x._blk", "x._start"), [*keyed, "_blk"])
    kept = F.aggregate(
        F.col("_rows"), F.struct(F.col("_start").alias("nxt"), F.array().cast("array<bigint>").alias("ids")),
        lambda a, r: F.when(r["_i"] >= a["nxt"], F.struct((r["_i"] + h).cast("long").alias("nxt"),
                                                          F.array_append(a["ids"], r["_i"]).alias("ids"))).otherwise(a),
        lambda a: a["ids"])
    blocks = blocks.withColumn("_kept", kept)
    thin = blocks.select(*keys, horizon, F.explode(F.filter("_rows", lambda r: F.array_contains("_kept", r["_i"]))).alias("r"))
    thin = thin.select(*keys, horizon, *[F.col("r").getField(c).alias(c) for c in rest])
    return obs.filter(h <= 1).unionByName(thin.select(*obs.columns))


def moments(obs: DataFrame, whole: DataFrame, period: Column) -> DataFrame:
    """Drift-removed signed returns per (hypothesis, symbol): first per period, then overall."""
    keep = nonoverlap(obs, ["hypothesis", *KEYS])
    drift = nonoverlap(whole, ["hypothesis", *KEYS]).groupBy(*KEYS, "horizon").agg(F.avg("fwd").alias("drift"))
    signed = (F.col("fwd") - F.col("drift")) * F.col("sig")
    per = (keep.join(drift, [*KEYS, "horizon"])
           .groupBy("hypothesis", "horizon", *KEYS, period.alias("period"))
           .agg(F.count(F.lit(1)).alias("n"), F.sum(signed).alias("s1"), F.sum(signed * signed).alias("s2"),
                F.sum(_is(signed > 0)).alias("hits")))
    return (per.groupBy("hypothesis", "horizon", *KEYS)
            .agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("hits").alias("hits"),
                 F.sum(F.when(F.col("s1") > 0, 1).otherwise(0)).alias("periods_pos"),
                 F.count(F.lit(1)).alias("periods")))


def student(n: Column, s1: Column, s2: Column) -> tuple[Column, Column]:
    """Mean and one-sample t from a count, a sum and a sum of squares."""
    mean = F.try_divide(s1, n)
    var = F.try_divide(s2 - s1 * mean, n - 1)
    return mean, F.try_divide(mean, F.sqrt(F.try_divide(F.greatest(var, F.lit(0.0)), n)))


def score(bars: DataFrame, registry: list[Hypothesis], trials: int, warmup: int = 300, period: Column | None = None,
          min_n: int = 10) -> DataFrame:
    """One scored row per (hypothesis, symbol)."""
    m = moments(stack(bars, registry, warmup), whole_sample(bars, registry, warmup), F.year("ts") if period is None else period)
    mean, t = student(F.col("n"), F.col("s1"), F.col("s2"))
    enough = F.col("n") >= min_n
    return (m.select("hypothesis", *KEYS, "horizon", "n",
                     F.when(enough, mean).otherwise(0.0).alias("excess_atr"),
                     F.when(enough, t).otherwise(0.0).alias("t"),
                     F.when(enough, F.col("hits") / F.col("n")).otherwise(0.0).alias("hit"),
                     F.when(enough, F.col("periods_pos")).otherwise(0).alias("periods_pos"),
                     F.when(enough, F.col("periods")).otherwise(0).alias("periods"))
            .withColumn("p", F.when(F.col("n") >= min_n, t_two_sided("t", (F.col("n") - 1).cast("double"))).otherwise(1.0))
            .withColumn("trials", F.lit(trials)).withColumn("verdict", verdict()))


def one_sample(grouped: DataFrame, trials: int) -> DataFrame:
    """Student's t against zero from n, s1, s2 per group, and the Bonferroni verdict."""
    mean, t = student(F.col("n"), F.col("s1"), F.col("s2"))
    d = grouped.withColumn("mean", mean).withColumn("t", t)
    d = d.withColumn("p", t_two_sided("t", (F.col("n") - 1).cast("double")))
    return d.withColumn("significant", F.col("p") < 0.05 / trials)


def verdict(min_periods: int = 6, share: float = 0.70) -> Column:
    strong = F.col("p") < 0.05 / F.col("trials")
    steady = (F.col("periods") >= min_periods) & (F.try_divide(F.col("periods_pos"), F.col("periods")) >= share)
    steady = F.coalesce(steady, F.lit(False))
    return (F.when(F.col("n") < 60, "too few").when(strong & steady, "SURVIVES")
            .when(strong, "significant, inconsistent")
            .when(steady & (F.abs("t") > 2), "consistent, weak").otherwise("-"))


def run_screen(bars: DataFrame, registry: list[Hypothesis], warmup: int = 300, trials: int | None = None,
               n_symbols: int = 1, period: Column | None = None) -> DataFrame:
    """All hypotheses on all symbols, ranked by |t| with ties broken by name."""
    trials = trials or len(registry) * n_symbols
    s = score(bars, registry, trials, warmup, period)
    rank = F.row_number().over(Window.orderBy(F.desc(F.abs("t")), "hypothesis", "horizon", *KEYS))
    return s.withColumn("rank", rank)  # one row per trial, so the global rank is over a short list


def bonferroni_bar(trials: int) -> float:
    return normal_quantile(1 - 0.025 / trials)


# --------------------------------------------------------------- pooled scoring

def score_pooled(obs: DataFrame, trials: int, cost: float, min_n: int = 30) -> DataFrame:
    """Observations (name, ts, sig, fwd) pooled over contracts, scored by calendar month.

    The drift is the mean of every observation of the name, fired or not."""
    drift = obs.groupBy("name").agg(F.avg("fwd").alias("drift_atr"))
    signed = (F.col("fwd") - F.col("drift_atr")) * F.col("sig")
    per = (obs.filter(F.col("sig") != 0).join(drift, "name")
           .groupBy("name", "drift_atr", F.trunc("ts", "MM").alias("month"))
           .agg(F.count(F.lit(1)).alias("n"), F.sum(signed).alias("s1"), F.sum(signed * signed).alias("s2"),
                F.sum(_is(signed > 0)).alias("hits")))
    m = per.groupBy("name", "drift_atr").agg(
        F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("hits").alias("hits"),
        F.sum(F.when(F.col("s1") > 0, 1).otherwise(0)).alias("months_pos"), F.count(F.lit(1)).alias("months"))
    mean, t = student(F.col("n"), F.col("s1"), F.col("s2"))
    d = (m.select("name", "n", mean.alias("edge_atr"), t.alias("t"), (F.col("hits") / F.col("n")).alias("hit"),
                  "drift_atr", "months_pos", "months")
         .withColumn("p", t_two_sided("t", (F.col("n") - 1).cast("double"))).withColumn("cost_atr", F.lit(float(cost))))
    bonf = F.col("p") < 0.05 / trials
    steady = (F.col("months") >= 3) & (F.col("months_pos") / F.col("months") >= 0.70)
    pays = F.col("edge_atr") > 2 * F.col("cost_atr")
    return d.withColumn("verdict", F.when(F.col("n") < min_n, "too few").when(bonf & steady & pays, "SURVIVES")
                        .when(bonf & steady, "real but does not pay")
                        .when(bonf, "significant, inconsistent").otherwise("no signal"))


# ---------------------------------------------------------------- decomposition

def measure_edge(df: DataFrame, keys: list[str], signed: Column, cost: Column | None = None) -> DataFrame:
    """n, mean, t, hit rate and mean net of cost per group; one pass."""
    n = F.count(signed)
    mean, sd = F.avg(signed), F.stddev_samp(signed)
    g = df.groupBy(*keys).agg(n.alias("n"), mean.alias("_m"), sd.alias("_sd"),
                              F.avg(_is(signed > 0)).alias("_hit"),
                              (F.max(cost) if cost is not None else F.lit(0.0)).alias("cost_atr"))
    two = F.col("n") >= 2
    t = F.coalesce(F.try_divide(F.col("_m"), F.col("_sd") / F.sqrt("n")), F.lit(0.0))
    return (g.withColumn("mean_atr", F.when(two, F.col("_m")).otherwise(0.0))
            .withColumn("t_stat", F.when(two, t).otherwise(0.0))
            .withColumn("hit_rate", F.when(two, F.col("_hit")).otherwise(0.0))
            .withColumn("net_atr", F.col("mean_atr") - F.col("cost_atr"))
            .withColumn("verdict", F.when(F.col("n") < 30, "too few samples")
                        .when(F.abs("t_stat") < 2.0, "no signal (t < 2)").when(F.col("mean_atr") <= 0, "signal INVERTED")
                        .when(F.col("net_atr") <= 0, "real but untradeable - cost exceeds it").otherwise("TRADEABLE"))
            .drop("_m", "_sd", "_hit"))


def decompose(prepared: DataFrame, fired: Column, horizon: int, cost_price: float, warmup: int = 60,
              max_extension: float = 1.0) -> DataFrame:
    """Score the nested claims of a pullback rule: each condition on its own, and its control.

    A row feeds several arms, so arms are exploded from one scan and grouped once."""
    w = I.by()
    d = (prepared.withColumn("_i", F.row_number().over(w) - 1)
         .withColumn("_fwd", F.try_divide(F.lead("close", horizon).over(w) - F.col("close"), F.col("atr")))
         .withColumn("_fired", fired))
    d = d.withColumn("_cost", F.lit(float(cost_price)) / F.median("atr").over(Window.partitionBy(*KEYS)))
    d = d.filter((F.col("_i") >= warmup) & (F.pmod(F.col("_i") - warmup, F.lit(horizon)) == 0) & F.col("_fwd").isNotNull())
    b = F.col("bias")
    directional = b != 0
    sess = directional & F.col("in_session")
    near = F.abs("ext_atr") <= max_extension
    arms = [("0 baseline", F.lit(True), F.lit(1)), ("1 bias", directional, b), ("1b bias in session", sess, b),
            ("2 location", sess & near, b), ("2b extended", sess & ~near, b),
            ("3 trigger", sess & near & F.col("_fired"), b), ("3b no trigger", sess & near & ~F.col("_fired"), b)]
    arm = F.explode(F.filter(F.array(*[
        F.struct(F.lit(n).alias("arm"), F.coalesce(c, F.lit(False)).alias("on"), (F.col("_fwd") * s).alias("ret"))
        for n, c, s in arms]), lambda a: a["on"]))
    long = d.select(*KEYS, "_cost", arm.alias("a")).select(*KEYS, "_cost", "a.arm", "a.ret")
    return measure_edge(long, [*KEYS, "arm"], F.col("ret"), F.col("_cost"))


def welch(df: DataFrame, keys: list[str], arm: str, value: str, first, second, min_n: int = 5) -> DataFrame:
    """Difference of two arms' means with unequal variances, from per-arm moments."""
    def part(a, p):
        x = F.when(F.col(arm) == a, F.col(value))
        return [F.count(x).alias(f"n_{p}"), F.avg(x).alias(f"mean_{p}"), F.var_samp(x).alias(f"_v{p}")]

    g = df.groupBy(*keys).agg(*part(first, "a"), *part(second, "b"))
    va, vb = F.col("_va") / F.col("n_a"), F.col("_vb") / F.col("n_b")
    ok = (F.col("n_a") >= min_n) & (F.col("n_b") >= min_n)
    diff = F.col("mean_a") - F.col("mean_b")
    dof = F.try_divide((va + vb) * (va + vb), va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))
    return (g.withColumn("diff", F.when(ok, diff))
            .withColumn("t", F.when(ok, F.try_divide(diff, F.sqrt(va + vb))).otherwise(0.0))
            .withColumn("dof", F.when(ok, dof))
            .withColumn("p", F.coalesce(t_two_sided("t", "dof"), F.lit(1.0))).drop("_va", "_vb"))


def hour_effect(bars: DataFrame, slot: Column) -> DataFrame:
    """Demeaned forward, gap and intrabar returns in ATR units by slot of the day."""
    w = I.by()
    d = I.with_atr(bars)
    nc, no = F.lead("close").over(w), F.lead("open").over(w)
    d = d.select(*KEYS, slot.alias("slot"), F.try_divide(nc - F.col("close"), F.col("atr")).alias("fwd"),
                 F.try_divide(no - F.col("close"), F.col("atr")).alias("gap"),
                 F.try_divide(nc - no, F.col("atr")).alias("intrabar"))
    per = d.groupBy(*KEYS, "slot").agg(*[f(c).alias(f"{p}{c}") for c in ("fwd", "gap", "intrabar")
                                        for f, p in ((F.sum, "s_"), (F.count, "n_"))], F.count(F.lit(1)).alias("n"))
    allw = Window.partitionBy(*KEYS)
    out = [(F.try_divide(F.col(f"s_{c}"), F.col(f"n_{c}"))
            - F.try_divide(F.sum(f"s_{c}").over(allw), F.sum(f"n_{c}").over(allw))).alias(c)
           for c in ("fwd", "gap", "intrabar")]
    return per.select(*KEYS, "slot", "n", *out)
