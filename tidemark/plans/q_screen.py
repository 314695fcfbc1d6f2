"""Rules, screens, decompositions and order-flow research."""

from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.operators import bars as B
from tidemark.operators import flow, quantiles, screen as S, signals as R
from tidemark.plans.registry import cte, query, rounded
from tidemark.plans.shared_sql import t_two_sided_sql
from tidemark.sources import views as V

W = "PARTITION BY symbol ORDER BY ts"
WARMUP = 100
REGISTRY = S.DAILY + S.INTRADAY


def lag(c, n=1):
    return f"lag({c}, {n}) OVER ({W})"


cte("sig_rows", f"""
SELECT *, rn - 1 AS idx, close - {lag('close')} AS chg, sign(close - {lag('close')}) AS step, high - low AS rng,
       lead(ts, 2) OVER ({W}) IS NOT NULL AS inner_row
FROM atr_h1
""", ("atr_h1",), materialized=True)


def _turn():
    tests = []
    for k in (1, 2):
        tests += [f"coalesce(month(lead(ts, {k}) OVER ({W})) <> month(ts), false)",
                  f"coalesce(month({lag('ts', k)}) <> month(ts), false)"]
    return f"CASE WHEN inner_row AND ({' OR '.join(tests)}) THEN 1 ELSE 0 END"


_T3 = f"({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
_P5 = f"({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
_P20 = f"({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_DAY = "(PARTITION BY symbol, CAST(ts AS DATE))"
_SIGNALS = [
    ("monday_long", 1, "CASE WHEN isodow(ts) = 1 THEN 1 ELSE 0 END"),
    ("friday_long", 1, "CASE WHEN isodow(ts) = 5 THEN 1 ELSE 0 END"),
    ("turn_of_month", 1, _turn()),
    ("reversal_1", 1, f"-sign(close / nullif({lag('close')}, 0) - 1)"),
    ("reversal_5", 5, f"-sign(close / nullif({lag('close', 5)}, 0) - 1)"),
    ("momentum_20", 5, f"sign(close / nullif({lag('close', 20)}, 0) - 1)"),
    ("momentum_120", 10, f"sign(close / nullif({lag('close', 120)}, 0) - 1)"),
    ("momentum_250", 20, f"sign(close / nullif({lag('close', 250)}, 0) - 1)"),
    ("streak3_fade", 1, f"CASE WHEN min(step) OVER {_T3} > 0 THEN -1 WHEN max(step) OVER {_T3} < 0 THEN 1 ELSE 0 END"),
    ("range_expansion", 3, "CASE WHEN rng > 2 * atr THEN step ELSE 0 END"),
    ("narrow_range_breakout", 3,
     f"CASE WHEN count(*) OVER {_P20} >= 20 AND {lag('rng')} < avg(rng) OVER {_P20} * 0.6 THEN "
     f"CASE WHEN close > max(high) OVER {_P5} THEN 1 WHEN close < min(low) OVER {_P5} THEN -1 ELSE 0 END ELSE 0 END"),
    ("overnight_long", 16, "CASE WHEN hour(ts) = CASE WHEN month(ts) BETWEEN 4 AND 10 THEN 20 ELSE 21 END THEN 1 ELSE 0 END"),
    ("london_open", 4, "CASE WHEN hour(ts) = 7 THEN sign(close - open) ELSE 0 END"),
    ("asian_range_break", 8,
     f"CASE WHEN hour(ts) = 7 AND close > max(CASE WHEN hour(ts) < 7 THEN high END) OVER {_DAY} THEN 1 "
     f"WHEN hour(ts) = 7 AND close < min(CASE WHEN hour(ts) < 7 THEN low END) OVER {_DAY} THEN -1 ELSE 0 END"),
] + [("_all", h, "1") for h in (1, 3, 4, 5, 8, 10, 16, 20)]

cte("sig_long", "\nUNION ALL\n".join(
    f"SELECT symbol, idx, ts, '{n}' AS hypothesis, {h} AS horizon, CAST({e} AS DOUBLE) AS sig,"
    f" (lead(close, {h}) OVER ({W}) - close) / nullif(atr, 0) AS fwd FROM sig_rows" for n, h, e in _SIGNALS), ("sig_rows",))
cte("sig_valid", f"SELECT * FROM sig_long WHERE idx >= {WARMUP} AND fwd IS NOT NULL AND sig IS NOT NULL AND sig <> 0",
    ("sig_long",), materialized=True)
cte("sig_next", """
SELECT a.hypothesis, a.symbol, a.horizon, a.idx, min(b.idx) AS nx
FROM sig_valid a LEFT JOIN sig_valid b ON b.hypothesis = a.hypothesis AND b.symbol = a.symbol AND b.horizon = a.horizon
     AND b.idx >= a.idx + a.horizon GROUP BY ALL
""", ("sig_valid",), materialized=True)
cte("sig_walk", """
SELECT hypothesis, symbol, horizon, min(idx) AS idx FROM sig_valid GROUP BY ALL
UNION ALL
SELECT n.hypothesis, n.symbol, n.horizon, n.nx FROM sig_walk k JOIN sig_next n ON n.hypothesis = k.hypothesis
  AND n.symbol = k.symbol AND n.horizon = k.horizon AND n.idx = k.idx WHERE n.nx IS NOT NULL
""", ("sig_next", "sig_valid"))
cte("sig_kept", "SELECT v.* FROM sig_valid v JOIN sig_walk USING (hypothesis, symbol, horizon, idx)",
    ("sig_walk", "sig_valid"), materialized=True)


@query("nonoverlap_kept", "SELECT hypothesis, symbol, horizon, idx, sig, round(fwd, 6) AS fwd FROM sig_kept", ("sig_kept",))
def _(spark, sf):
    b = V.stored_bars(spark, sf)
    both = S.stack(b, REGISTRY, WARMUP).unionByName(S.whole_sample(b, REGISTRY, WARMUP))
    kept = S.nonoverlap(both, ["hypothesis", "symbol"])
    return rounded(kept.select("hypothesis", "symbol", "horizon", "idx", "sig", "fwd"))


cte("screen_scores", """
SELECT hypothesis, symbol, horizon, n, CASE WHEN n >= 10 THEN s1 / n ELSE 0 END AS excess_atr,
  CASE WHEN n >= 10 THEN (s1 / n) / sqrt((s2 - s1 * s1 / n) / (n - 1) / n) ELSE 0 END AS t,
  CASE WHEN n >= 10 THEN hits / n ELSE 0 END AS hit, CASE WHEN n >= 10 THEN pos ELSE 0 END AS periods_pos,
  CASE WHEN n >= 10 THEN periods ELSE 0 END AS periods
FROM (SELECT hypothesis, symbol, horizon, CAST(sum(n) AS BIGINT) AS n, sum(s1) AS s1, sum(s2) AS s2, sum(hits) AS hits,
             CAST(count(*) FILTER (s1 > 0) AS BIGINT) AS pos, count(*) AS periods
  FROM (SELECT hypothesis, symbol, horizon, date_trunc('week', ts) AS period, count(*) AS n, sum(x) AS s1, sum(x * x) AS s2,
               sum(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS hits
    FROM (SELECT k.*, (k.fwd - d.drift) * k.sig AS x FROM sig_kept k
          JOIN (SELECT symbol, horizon, avg(fwd) AS drift FROM sig_kept WHERE hypothesis = '_all' GROUP BY ALL) d
          USING (symbol, horizon) WHERE hypothesis <> '_all') GROUP BY ALL) GROUP BY ALL)
""", ("sig_kept",))


@query("screen_scores", f"""
WITH s AS (SELECT *, CASE WHEN n >= 10 THEN {t_two_sided_sql('t', '(n - 1)')} ELSE 1 END AS p FROM screen_scores)
SELECT hypothesis, symbol, horizon, n, round(excess_atr, 6) AS excess_atr, round(t, 6) AS t, round(hit, 6) AS hit,
  periods_pos, periods, round(p, 6) + 0.0 AS p, CAST(70 AS INTEGER) AS trials,
  CASE WHEN n < 60 THEN 'too few' WHEN p < 0.05 / 70 AND steady THEN 'SURVIVES' WHEN p < 0.05 / 70 THEN 'significant, inconsistent'
       WHEN steady AND abs(t) > 2 THEN 'consistent, weak' ELSE '-' END AS verdict,
  row_number() OVER (ORDER BY abs(t) DESC, hypothesis, horizon, symbol) AS rank
FROM (SELECT *, periods >= 6 AND periods_pos / nullif(periods, 0) >= 0.7 AS steady FROM s)
""", ("screen_scores",))
def _(spark, sf):
    d = S.run_screen(V.stored_bars(spark, sf), REGISTRY, WARMUP, n_symbols=5, period=F.date_trunc("week", "ts"))
    return rounded(d)


@query("screen_hours", f"""
WITH h AS (SELECT symbol, ts, hour(ts) AS hr, (lead(close) OVER ({W}) - close) / nullif(atr, 0) AS fwd FROM sig_rows
           QUALIFY idx >= {WARMUP} AND fwd IS NOT NULL),
x AS (SELECT symbol, hr, fwd - avg(fwd) OVER (PARTITION BY symbol) AS x FROM h)
SELECT 'hour_' || lpad(CAST(hr AS VARCHAR), 2, '0') || '_long' AS hypothesis, symbol, count(*) AS n,
       round(avg(x), 6) AS excess_atr, round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 6) AS t
FROM x WHERE hr NOT IN (20, 21, 22, 23, 0, 1) GROUP BY hr, symbol HAVING count(*) >= 10
""", ("sig_rows",))
def _(spark, sf):
    d = S.score(V.stored_bars(spark, sf), S.HOURS, len(S.HOURS) * 5, WARMUP, F.date_trunc("week", "ts"))
    return rounded(d.filter(F.col("n") >= 10).select("hypothesis", "symbol", "n", "excess_atr", "t"))


@query("screen_us_open_15m")
def _(spark, sf):
    """Quarter-hour opening signals; rows only, its parts are covered by the hourly screen."""
    return rounded(S.score(V.stored_bars(spark, sf, "15 minutes"), S.US_OPEN, 10, WARMUP, F.date_trunc("week", "ts")))


@query("forward_return_atr", f"""
SELECT symbol, ts, round((lead(close, 5) OVER ({W}) - close) / nullif(atr, 0), 6) AS fwd5,
       CASE WHEN step IS NULL THEN NULL ELSE CAST(step AS DOUBLE) END AS step FROM sig_rows
""", ("sig_rows",))
def _(spark, sf):
    d = S.prepare(V.bars(spark, sf))
    fwd = F.try_divide(F.lead("close", 5).over(I.by()) - F.col("close"), F.col("atr"))
    return rounded(d.select("symbol", "ts", fwd.alias("fwd5"), F.signum("_chg").alias("step")))


@query("hour_effect", f"""
WITH r AS (SELECT symbol, hour(ts) AS slot, (lead(close) OVER ({W}) - close) / nullif(atr, 0) AS fwd,
  (lead(open) OVER ({W}) - close) / nullif(atr, 0) AS gap, (lead(close) OVER ({W}) - lead(open) OVER ({W})) / nullif(atr, 0) AS intrabar
  FROM atr_h1),
m AS (SELECT symbol, avg(fwd) AS f, avg(gap) AS g, avg(intrabar) AS i FROM r GROUP BY symbol)
SELECT r.symbol, CAST(slot AS INTEGER) AS slot, count(*) AS n, round(avg(fwd) - max(f), 6) AS fwd, round(avg(gap) - max(g), 6) AS gap,
       round(avg(intrabar) - max(i), 6) AS intrabar
FROM r JOIN m ON m.symbol = r.symbol GROUP BY r.symbol, slot
""", ("atr_h1",))
def _(spark, sf):
    return rounded(S.hour_effect(V.bars(spark, sf), F.hour("ts")))


# ------------------------------------------------------- multi-timeframe rule

for _tf, _iv in (("h4", "4 hours"), ("h1", "1 hour")):
    cte(f"bias_{_tf}", f"""
SELECT symbol, ts + INTERVAL '{_iv}' AS available_at,
  CASE WHEN close > e AND e - lag(e, 5) OVER ({W}) > 0 THEN 1 WHEN close < e AND e - lag(e, 5) OVER ({W}) < 0 THEN -1 ELSE 0 END AS bias
FROM (SELECT b.*, CASE WHEN b.rn >= 20 THEN x.y END AS e FROM rows_{_tf} b JOIN ema20_{_tf} x ON x.symbol = b.symbol AND x.rn = b.rn)
""", (f"rows_{_tf}", f"ema20_{_tf}"), materialized=True)

cte("mtf_base", f"""
SELECT a.*, CASE WHEN a.rn >= 20 THEN (a.close - e.y) / nullif(a.atr, 0) END AS ext_atr, hour(a.ts) >= 7 AND hour(a.ts) < 20 AS in_session,
  CAST(floor((CASE WHEN 72000 - hour(a.ts) * 3600 > 0 THEN 72000 - hour(a.ts) * 3600 ELSE 158400 - hour(a.ts) * 3600 END) / 3600.0) AS INTEGER) AS bars_to_flat,
  lag(a.high) OVER (PARTITION BY a.symbol ORDER BY a.ts) AS ph, lag(a.low) OVER (PARTITION BY a.symbol ORDER BY a.ts) AS pl
FROM atr_h1 a JOIN ema20_h1 e ON e.symbol = a.symbol AND e.rn = a.rn
""", ("atr_h1", "ema20_h1"), materialized=True)
cte("mtf", """
SELECT b.*, coalesce(x.bias, 0) AS b4, coalesce(y.bias, 0) AS b1, s.atr AS stop_atr,
  CASE WHEN coalesce(x.bias, 0) = 1 AND coalesce(y.bias, 0) = 1 THEN 1 WHEN coalesce(x.bias, 0) = -1 AND coalesce(y.bias, 0) = -1 THEN -1 ELSE 0 END AS bias,
  max(ext_atr) OVER f AS ext_max_5, min(ext_atr) OVER f AS ext_min_5
FROM mtf_base b ASOF LEFT JOIN bias_h4 x ON x.symbol = b.symbol AND b.ts >= x.available_at
ASOF LEFT JOIN bias_h1 y ON y.symbol = b.symbol AND b.ts >= y.available_at
ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL '4 hours' AS available_at, atr FROM atr_h4) s ON s.symbol = b.symbol AND b.ts >= s.available_at
WINDOW f AS (PARTITION BY b.symbol ORDER BY b.ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
""", ("mtf_base", "bias_h4", "bias_h1", "atr_h4"), materialized=True)
cte("mtf_fired", """
SELECT *, coalesce(CASE WHEN bias > 0 THEN close > open AND close > ph WHEN bias < 0 THEN close < open AND close < pl END, false) AS fired FROM mtf
""", ("mtf",))


def mtf(spark, sf):
    h1 = V.stored_bars(spark, sf)
    h4 = B.resample(h1, "4 hours")
    return R.mtf_prepare(h1, {"H4": h4, "H1": h1}, ("H4", "H1"), "H4", bias_span=20)


@query("mtf_pullback_events", """
SELECT symbol, ts, bias AS side, round(stop_atr * 1.5, 6) AS stop_distance, round(ext_atr, 6) AS ext_atr
FROM mtf_fired WHERE bias <> 0 AND in_session AND bars_to_flat > 8 AND abs(ext_atr) <= 1 AND fired AND stop_atr > 0
 AND atr > 0 AND rn - 1 >= 60 AND (CASE WHEN bias > 0 THEN ext_min_5 <= -0.25 OR ext_atr < 0 ELSE ext_max_5 >= 0.25 OR ext_atr > 0 END)
 AND ts < (SELECT max(ts) FROM mtf m WHERE m.symbol = mtf_fired.symbol)
""", ("mtf_fired", "mtf"))
def _(spark, sf):
    ev = R.signal_events(R.mtf_pullback(mtf(spark, sf)))
    return rounded(ev.select("symbol", "ts", "side", "stop_distance", "ext_atr"))


@query("decompose_arms", f"""
WITH d AS (SELECT *, (lead(close, 4) OVER ({W}) - close) / nullif(atr, 0) AS fwd FROM mtf_fired),
k AS (SELECT d.*, c.cost FROM d JOIN (SELECT symbol, 0.5 / median(atr) AS cost FROM mtf GROUP BY symbol) c USING (symbol)
      WHERE rn - 1 >= 60 AND (rn - 61) % 4 = 0 AND fwd IS NOT NULL),
a AS (SELECT symbol, cost, '0 baseline' AS arm, fwd AS r FROM k
 UNION ALL SELECT symbol, cost, '1 bias', fwd * bias FROM k WHERE bias <> 0
 UNION ALL SELECT symbol, cost, '1b bias in session', fwd * bias FROM k WHERE bias <> 0 AND in_session
 UNION ALL SELECT symbol, cost, '2 location', fwd * bias FROM k WHERE bias <> 0 AND in_session AND abs(ext_atr) <= 1
 UNION ALL SELECT symbol, cost, '2b extended', fwd * bias FROM k WHERE bias <> 0 AND in_session AND abs(ext_atr) > 1
 UNION ALL SELECT symbol, cost, '3 trigger', fwd * bias FROM k WHERE bias <> 0 AND in_session AND abs(ext_atr) <= 1 AND fired
 UNION ALL SELECT symbol, cost, '3b no trigger', fwd * bias FROM k WHERE bias <> 0 AND in_session AND abs(ext_atr) <= 1 AND NOT fired),
g AS (SELECT symbol, arm, count(*) AS n, max(cost) AS cost_atr, CASE WHEN count(*) >= 2 THEN avg(r) ELSE 0 END AS mean_atr,
  CASE WHEN count(*) >= 2 THEN coalesce(avg(r) / nullif(stddev_samp(r) / sqrt(count(*)), 0), 0) ELSE 0 END AS t_stat,
  CASE WHEN count(*) >= 2 THEN avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) ELSE 0 END AS hit_rate FROM a GROUP BY ALL)
SELECT symbol, arm, n, round(cost_atr, 6) AS cost_atr, round(mean_atr, 6) AS mean_atr, round(t_stat, 6) AS t_stat,
  round(hit_rate, 6) AS hit_rate, round(mean_atr - cost_atr, 6) AS net_atr,
  CASE WHEN n < 30 THEN 'too few samples' WHEN abs(t_stat) < 2 THEN 'no signal (t < 2)' WHEN mean_atr <= 0 THEN 'signal INVERTED'
       WHEN mean_atr - cost_atr <= 0 THEN 'real but untradeable - cost exceeds it' ELSE 'TRADEABLE' END AS verdict FROM g
""", ("mtf_fired", "mtf"))
def _(spark, sf):
    return rounded(S.decompose(mtf(spark, sf), R.trigger(), 4, 0.5))


@query("welch_location", f"""
WITH d AS (SELECT symbol, ((lead(close, 3) OVER ({W}) - close) / nullif(atr, 0)) * bias AS r, bias, rn, abs(ext_atr) <= 0.5 AS near FROM mtf),
g AS (SELECT symbol, count(*) FILTER (near) AS n_a, count(*) FILTER (NOT near) AS n_b, avg(r) FILTER (near) AS mean_a,
  avg(r) FILTER (NOT near) AS mean_b, var_samp(r) FILTER (near) AS va, var_samp(r) FILTER (NOT near) AS vb
  FROM d WHERE bias <> 0 AND rn - 1 >= 60 AND (rn - 61) % 3 = 0 AND r IS NOT NULL AND near IS NOT NULL GROUP BY symbol),
s AS (SELECT *, CASE WHEN n_a >= 5 AND n_b >= 5 THEN mean_a - mean_b END AS diff,
  CASE WHEN n_a >= 5 AND n_b >= 5 THEN (mean_a - mean_b) / sqrt(va / n_a + vb / n_b) ELSE 0 END AS t, CASE WHEN n_a >= 5 AND n_b >= 5 THEN
  pow(va / n_a + vb / n_b, 2) / (pow(va / n_a, 2) / (n_a - 1) + pow(vb / n_b, 2) / (n_b - 1)) END AS dof FROM g)
SELECT symbol, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(diff, 6) AS diff, round(t, 6) AS t,
  round(dof, 6) AS dof, CASE WHEN dof IS NULL THEN 1 ELSE round({t_two_sided_sql('t', 'dof')}, 6) END AS p FROM s
""", ("mtf",))
def _(spark, sf):
    d = mtf(spark, sf)
    i = F.row_number().over(I.by()) - 1
    r = F.try_divide(F.lead("close", 3).over(I.by()) - F.col("close"), F.col("atr")) * F.col("bias")
    d = (d.select("symbol", "bias", i.alias("i"), r.alias("r"), (F.abs("ext_atr") <= 0.5).alias("near"))
         .filter((F.col("bias") != 0) & (F.col("i") >= 60) & (F.pmod(F.col("i") - 60, F.lit(3)) == 0)
                 & F.col("r").isNotNull() & F.col("near").isNotNull()))
    return rounded(S.welch(d, ["symbol"], "near", "r", True, False))


# ------------------------------------------------------------- flat-side rules

cte("trend_rows", f"""
SELECT a.symbol, a.ts, a.rn, a.close, a.atr, a.close - lag(a.close, 60) OVER w AS mom, CASE WHEN a.rn >= 50 THEN e.y END AS ema,
  CASE WHEN a.rn >= 61 THEN stddev_samp(d) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) END AS pv, lead(a.ts) OVER w IS NULL AS is_last
FROM (SELECT *, close - lag(close) OVER ({W}) AS d FROM atr_h1) a JOIN ema50_h1 e ON e.symbol = a.symbol AND e.rn = a.rn
WINDOW w AS (PARTITION BY a.symbol ORDER BY a.ts)
""", ("atr_h1", "ema50_h1"), materialized=True)
cte("atr_rank100", """
SELECT a.symbol, a.rn, (count(*) FILTER (b.atr < a.atr) + (count(*) FILTER (b.atr = a.atr) + 1) / 2.0) / 100 AS pct
FROM atr_h1 a JOIN atr_h1 b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn - 99 AND a.rn WHERE a.rn >= 113 GROUP BY 1, 2
""", ("atr_h1",))
cte("trend_events", """
SELECT * FROM (SELECT t.*, p.pct, mom / nullif(pv * sqrt(60), 0) AS forecast,
  CASE WHEN mom > 0 AND close > ema THEN 1 WHEN mom < 0 AND close < ema THEN -1 END AS side
  FROM trend_rows t LEFT JOIN atr_rank100 p ON p.symbol = t.symbol AND p.rn = t.rn)
WHERE side IS NOT NULL AND atr > 0 AND coalesce(pct <= 0.95, true) AND rn - 1 >= 65 AND NOT is_last
""", ("trend_rows", "atr_rank100"))


def trend_rule(spark, sf, bars=None):
    return R.trend(V.bars(spark, sf) if bars is None else bars, 60, 50, rank=100)


@query("trend_events", """
SELECT symbol, ts, side, round(atr * 2.5, 6) AS stop_distance, round(forecast, 6) AS forecast,
  round(CASE WHEN forecast IS NULL OR forecast = 0 THEN 0 ELSE greatest(least(abs(forecast) / 2, 1), 0.25) END, 6) AS confidence
FROM trend_events
""", ("trend_events",))
def _(spark, sf):
    ev = R.signal_events(trend_rule(spark, sf), warmup=65)
    return rounded(ev.select("symbol", "ts", "side", "stop_distance", "forecast",
                             R.to_confidence(F.col("forecast")).alias("confidence")))


@query("ts_momentum_weekly", f"""
WITH d AS (SELECT symbol, ts, rn, atr, close - lag(close, 100) OVER ({W}) AS mom,
  coalesce(date_trunc('week', lag(ts) OVER ({W})) <> date_trunc('week', ts), true) AS decides FROM atr_h1),
s AS (SELECT *, CASE WHEN decides AND atr > 0 THEN CASE WHEN mom > 0 THEN 1 WHEN mom < 0 THEN -1 END END AS side FROM d)
SELECT symbol, ts, decides, CAST(coalesce(last_value(CASE WHEN decides THEN coalesce(side, 0) END IGNORE NULLS) OVER ({W}), 0) AS INTEGER) AS held_side FROM s
""", ("atr_h1",))
def _(spark, sf):
    week = F.date_trunc("week", "ts")
    first = F.coalesce(F.lag(week).over(I.by()) != week, F.lit(True))
    return R.time_series_momentum(V.bars(spark, sf), 100, period_start=first).select("symbol", "ts", "decides", "held_side")


@query("breakout_events", f"""
WITH d AS (SELECT *, CASE WHEN rn > 55 THEN max(high) OVER p END AS hi, CASE WHEN rn > 55 THEN min(low) OVER p END AS lo,
  CASE WHEN rn > 27 THEN max(high) OVER x END AS xhi, CASE WHEN rn > 27 THEN min(low) OVER x END AS xlo, lead(ts) OVER ({W}) IS NULL AS is_last
  FROM atr_h1 WINDOW p AS ({W} ROWS BETWEEN 55 PRECEDING AND 1 PRECEDING), x AS ({W} ROWS BETWEEN 27 PRECEDING AND 1 PRECEDING))
SELECT symbol, ts, CASE WHEN close > hi THEN 1 ELSE -1 END AS side, round(atr * 2, 6) AS stop_distance,
  coalesce(close < xlo, false) AS exit_long, coalesce(close > xhi, false) AS exit_short
FROM d WHERE atr > 0 AND (close > hi OR close < lo) AND rn - 1 >= 60 AND NOT is_last
""", ("atr_h1",))
def _(spark, sf):
    ev = R.signal_events(R.breakout(V.bars(spark, sf)))
    return rounded(ev.select("symbol", "ts", "side", "stop_distance", "exit_long", "exit_short"))


@query("seasonal_hours", f"""
WITH p AS (SELECT symbol, CAST(ts AS DATE) AS cycle, hour(ts) AS period, first(price ORDER BY ts, seq) AS a, last(price ORDER BY ts, seq) AS b
  FROM prints GROUP BY ALL), r AS (SELECT *, (b - a) / nullif(abs(a), 0) AS ret FROM p)
SELECT symbol, CAST(cycle AS VARCHAR) AS cycle, CAST(period AS INTEGER) AS period, round(ret, 6) AS ret, count(ret) OVER w AS prior_n,
  round(CASE WHEN count(ret) OVER w >= 5 THEN avg(ret) OVER w END, 6) AS prior_mean
FROM r WINDOW w AS (PARTITION BY symbol, period ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""", ("prints",))
def _(spark, sf):
    p = V.prints(spark, sf).select("symbol", F.struct("ts", "seq").alias("ts"), F.col("price").alias("close"))
    return rounded(R.prior_period_mean(p, F.hour("ts.ts"), F.to_date("ts.ts"), 5))


@query("prior_month_mean", """
WITH m AS (SELECT symbol, month, level, level / nullif(lag(level) OVER (PARTITION BY symbol ORDER BY month), 0) - 1 AS ret FROM panel)
SELECT symbol, CAST(month AS VARCHAR) AS month, round(ret, 6) AS ret,
  round(CASE WHEN count(ret) OVER w >= 3 THEN avg(ret) OVER w END, 6) AS prior_mean
FROM m WINDOW w AS (PARTITION BY symbol, month(month) ORDER BY year(month) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""", ("panel",))
def _(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("symbol").orderBy("month")
    d = V.panel(spark, sf).withColumn("ret", F.try_divide(F.col("level"), F.lag("level").over(w)) - 1)
    p = (Window.partitionBy("symbol", F.month("month")).orderBy(F.year("month"))
         .rowsBetween(Window.unboundedPreceding, -1))
    return rounded(d.select("symbol", "month", "ret",
                            F.when(F.count("ret").over(p) >= 3, F.avg("ret").over(p)).alias("prior_mean")))


# ----------------------------------------------------------------- order flow

cte("crossings", f"""
SELECT symbol, abs(price - pp) AS spread FROM (SELECT *, lag(price) OVER w AS pp, lag(side) OVER w AS ps, lag(ts) OVER w AS pt
FROM signed_prints WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq))
WHERE abs(side - ps) = 2 AND epoch(ts - pt) <= 600 AND abs(price - pp) > 0
""", ("signed_prints",))
cte("spreads", """
SELECT p.symbol, p.prints, coalesce(c.n, 0) AS crossings, CASE WHEN c.n > 30 THEN c.m END AS spread
FROM (SELECT symbol, count(*) AS prints FROM prints GROUP BY symbol) p
LEFT JOIN (SELECT symbol, count(*) AS n, median(spread) AS m FROM crossings GROUP BY symbol) c USING (symbol)
""", ("crossings", "prints"))


@query("measured_spread", "SELECT symbol, prints, crossings, round(spread, 6) AS spread FROM spreads", ("spreads",))
def _(spark, sf):
    return rounded(flow.measured_spread(V.signed_prints(spark, sf, True), 600, 30))


@query("weighted_spread", """
SELECT round(sum(spread * prints) / sum(CASE WHEN spread IS NOT NULL THEN prints END), 6) AS spread,
       round(sum(spread * prints) / sum(CASE WHEN spread IS NOT NULL THEN prints END) + 0.5, 6) AS round_trip FROM spreads
""", ("spreads",))
def _(spark, sf):
    return rounded(flow.weighted_spread(flow.measured_spread(V.signed_prints(spark, sf, True), 600, 30), 0.25))


cte("flow_obs", f"""
WITH a AS (SELECT d.*, t.atr, row_number() OVER (PARTITION BY d.symbol ORDER BY d.ts) AS k FROM delta_h1 d JOIN atr_h1 t ON t.symbol = d.symbol AND t.ts = d.ts)
SELECT 'delta_continuation' AS name, symbol, ts, CASE WHEN k <= 50 THEN 0 ELSE sign(delta) END AS sig,
       (lead(close) OVER ({W}) - close) / nullif(atr, 0) AS fwd FROM a QUALIFY fwd IS NOT NULL
""", ("delta_h1", "atr_h1"))


@query("flow_continuation", f"""
WITH x AS (SELECT *, (fwd - avg(fwd) OVER ()) * sig AS x, avg(fwd) OVER () AS drift FROM flow_obs),
g AS (SELECT name, count(*) AS n, avg(x) AS edge, avg(x) / (stddev_samp(x) / sqrt(count(*))) AS t,
  avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS hit, max(drift) AS drift FROM x WHERE sig <> 0 GROUP BY name),
p AS (SELECT g.*, {t_two_sided_sql('t', '(n - 1)')} AS p FROM g)
SELECT name, n, round(edge, 6) AS edge_atr, round(t, 6) AS t, round(hit, 6) AS hit, round(drift, 6) AS drift_atr,
  CAST(CASE WHEN edge > 0 THEN 1 ELSE 0 END AS BIGINT) AS months_pos, CAST(1 AS BIGINT) AS months, round(p, 6) + 0.0 AS p, 0.05::DOUBLE AS cost_atr,
  CASE WHEN n < 30 THEN 'too few' WHEN p < 0.05 / 9 THEN 'significant, inconsistent' ELSE 'no signal' END AS verdict FROM p
""", ("flow_obs",))
def _(spark, sf):
    d = B.delta_bars(V.signed_prints(spark, sf), "1 hour")
    return rounded(S.score_pooled(flow.bar_observations(d, "delta_continuation", F.signum("delta")), 9, 0.05))


cte("delta_h1_atr", "SELECT d.*, t.atr FROM delta_h1 d JOIN atr_h1 t ON t.symbol = d.symbol AND t.ts = d.ts", ("delta_h1", "atr_h1"))


@query("session_observations", """
SELECT symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, max(ts) FILTER (hour(ts) = 14) AS ts,
  CAST(sign(sum(delta) FILTER (hour(ts) IN (12, 13))) AS DOUBLE) AS sig,
  round((max(close) FILTER (hour(ts) = 20) - max(close) FILTER (hour(ts) = 14)) / max(atr) FILTER (hour(ts) = 14), 6) AS fwd
FROM delta_h1_atr GROUP BY symbol, CAST(ts AS DATE)
HAVING sum(delta) FILTER (hour(ts) IN (12, 13)) IS NOT NULL AND max(close) FILTER (hour(ts) = 20) IS NOT NULL
   AND max(atr) FILTER (hour(ts) = 14) > 0
""", ("delta_h1_atr",))
def _(spark, sf):
    d = B.delta_bars(V.signed_prints(spark, sf), "1 hour")
    return rounded(flow.session_observations(d, 720, 1200, 120))


cte("quotes", "SELECT symbol, ts, price AS bid, price * 1.0005 + size / 1000 AS ask, price * 1.0005 + size / 1000 - price AS spread FROM prints", ("prints",))


def quotes(spark, sf):
    """Two-sided quotes around each print."""
    ask = F.col("price") * 1.0005 + F.col("size") / 1000
    return V.prints(spark, sf).select("symbol", "ts", F.col("price").alias("bid"), ask.alias("ask"),
                                      (ask - F.col("price")).alias("spread"))


@query("spread_profile", """
WITH h AS (SELECT symbol, hour(ts) AS hr, count(*) AS samples, median(spread) AS m FROM quotes GROUP BY ALL)
SELECT symbol, CAST(hr AS INTEGER) AS hour, round(m, 6) AS median_spread, samples,
  CAST(first_value(hr) OVER (PARTITION BY symbol ORDER BY m, hr) AS INTEGER) AS cheapest_hour,
  CAST(first_value(hr) OVER (PARTITION BY symbol ORDER BY m DESC, hr) AS INTEGER) AS worst_hour FROM h
""", ("quotes",))
def _(spark, sf):
    return rounded(flow.spread_profile(quotes(spark, sf)))


@query("spread_by_minute", """
SELECT symbol, CAST(hour(ts) * 60 + minute(ts) - 1260 AS INTEGER) AS minute_offset, round(median(spread), 9) AS median_spread FROM quotes
WHERE hour(ts) * 60 + minute(ts) - 1260 BETWEEN -10 AND 69 GROUP BY ALL
""", ("quotes",))
def _(spark, sf):
    return rounded(flow.spread_by_minute(quotes(spark, sf), 21), 9)


@query("signal_rate", """
SELECT b.symbol, b.bars, coalesce(e.fired, 0) AS fired, round(coalesce(e.fired, 0) / b.bars, 6) AS rate
FROM (SELECT symbol, count(*) AS bars FROM trend_rows WHERE rn - 1 >= 65 AND NOT is_last GROUP BY symbol) b
LEFT JOIN (SELECT symbol, count(*) AS fired FROM trend_events GROUP BY symbol) e USING (symbol)
""", ("trend_rows", "trend_events"))
def _(spark, sf):
    d = trend_rule(spark, sf).filter((F.col("i") >= 65) & ~F.col("is_last"))
    return rounded(d.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.count("side").alias("fired"))
                   .withColumn("rate", F.col("fired") / F.col("bars")))
