"""Trades, equity, attribution and costs."""

from pyspark.sql import functions as F

from tidemark.operators import costs as C
from tidemark.operators import trades as T
from tidemark.plans.registry import cte, query, rounded
from tidemark.session import materialize
from tidemark.sources import views as V

START = 1e9

cte("specs", """
SELECT symbol, 2 AS digits, 0.01::DOUBLE AS point, 0.01::DOUBLE AS tick_size, floor(sz) / 100.0 AS tick_value, 1.0::DOUBLE AS volume_min,
  40.0::DOUBLE AS volume_max, 1.0::DOUBLE AS volume_step, 100.0::DOUBLE AS contract_size, 5 AS stops_level_points, code * -0.5::DOUBLE AS swap_long,
  code * 0.25::DOUBLE AS swap_short, code AS swap_mode, CASE WHEN code % 2 = 0 THEN 2 ELSE 4 END AS swap_triple_weekday, floor(px) / 1000.0 AS spread,
  floor(px) / 2000.0 AS slippage, 0.75::DOUBLE AS commission
FROM (SELECT p_brand AS symbol, avg(p_size) AS sz, avg(p_retailprice) AS px, CAST(right(p_brand, 1) AS INTEGER) AS code FROM part GROUP BY p_brand)
""")
cte("equity", f"""
SELECT sleeve, date_trunc('day', exit_ts) AS ts, sum(net_pnl) AS pnl,
       sum(sum(net_pnl)) OVER (PARTITION BY sleeve ORDER BY date_trunc('day', exit_ts)) + {START} AS equity
FROM trades GROUP BY sleeve, date_trunc('day', exit_ts)
""", ("trades",), materialized=True)
cte("eq_ret", "SELECT *, equity / lag(equity) OVER (PARTITION BY sleeve ORDER BY ts) - 1 AS ret FROM equity", ("equity",), materialized=True)
cte("dd", """
SELECT sleeve, max((peak - equity) / peak) AS max_drawdown, max(epoch(ts - top_ts) / 86400.0) AS max_dd_days FROM (
 SELECT *, last_value(CASE WHEN equity >= peak THEN ts END IGNORE NULLS) OVER (PARTITION BY sleeve ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top_ts
 FROM (SELECT *, max(equity) OVER (PARTITION BY sleeve ORDER BY ts) AS peak FROM equity)) GROUP BY sleeve
""", ("equity",))


@query("drawdown", "SELECT sleeve, round(max_drawdown, 9) AS max_drawdown, round(max_dd_days, 6) AS max_dd_days FROM dd", ("dd",))
def _(spark, sf):
    eq = T.daily_equity(T.derived(V.trades(spark, sf)), ["sleeve"], START)
    return rounded(T.drawdown(eq, ["sleeve"]), max_drawdown=9)


@query("trade_metrics", f"""
WITH t AS (SELECT sleeve, count(*) AS trades, avg(CASE WHEN r_multiple > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
  avg(r_multiple) FILTER (r_multiple > 0) / abs(avg(r_multiple) FILTER (r_multiple <= 0)) AS payoff, avg(r_multiple) AS expectancy_r,
  sum(net_pnl) FILTER (net_pnl > 0) / abs(sum(net_pnl) FILTER (net_pnl <= 0)) AS profit_factor, sum(gross_pnl) AS gross_pnl, sum(costs) AS total_costs,
  sum(costs) / sum(gross_pnl) FILTER (gross_pnl > 0) AS cost_drag, avg(days_held) AS avg_days_held, sum(days_held) AS held, max(r_multiple) AS best_r, min(r_multiple) AS worst_r
  FROM trades GROUP BY sleeve),
e AS (SELECT sleeve, avg(ret) AS m, stddev_samp(ret) AS sd, stddev_samp(ret) FILTER (ret < 0) AS dn, arg_max(equity, ts) AS fin,
  date_diff('day', min(ts), max(ts)) / 365.25 AS years FROM eq_ret GROUP BY sleeve)
SELECT t.sleeve, trades, round(win_rate, 6) AS win_rate, round(payoff, 6) AS payoff, round(expectancy_r, 6) AS expectancy_r,
  round(profit_factor, 6) AS profit_factor, round(fin / {START} - 1, 6) AS total_return, round(pow(fin / {START}, 1 / years) - 1, 6) AS cagr,
  round(m * 252 / (sd * sqrt(252)), 6) AS sharpe, round(m * 252 / (dn * sqrt(252)), 6) AS sortino, round(max_drawdown, 6) AS max_drawdown,
  round(max_dd_days, 6) AS max_dd_days, round((pow(fin / {START}, 1 / years) - 1) / max_drawdown, 6) AS calmar, round(avg_days_held, 6) AS avg_days_held,
  round(gross_pnl, 2) AS gross_pnl, round(total_costs, 2) AS total_costs, round(cost_drag, 6) AS cost_drag, round(best_r, 6) AS best_r,
  round(worst_r, 6) AS worst_r, round(least(held / (years * 365.25), 1), 6) AS exposure,
  CASE WHEN trades < 30 THEN 'INCONCLUSIVE' WHEN expectancy_r <= 0 THEN 'DEAD' WHEN cost_drag > 0.5 THEN 'COST-DOMINATED'
       WHEN m * 252 / (sd * sqrt(252)) < 0.5 THEN 'WEAK' WHEN m * 252 / (sd * sqrt(252)) < 1 THEN 'MARGINAL'
       WHEN m * 252 / (sd * sqrt(252)) < 2 THEN 'WORKABLE' ELSE 'STRONG' END AS verdict
FROM t JOIN e USING (sleeve) JOIN dd USING (sleeve)
""", ("trades", "eq_ret", "dd"))
def _(spark, sf):
    m = T.metrics(V.trades(spark, sf), ["sleeve"], START).withColumn("verdict", T.metrics_verdict())
    return rounded(m, gross_pnl=2, total_costs=2)


@query("annualisation", """
SELECT strategy, round(252 * CASE WHEN 86400.0 / median(gap) > 1 THEN 86400.0 / median(gap) ELSE 1 END, 6) AS periods FROM (
SELECT event_type AS strategy, epoch(ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) AS gap FROM
(SELECT DISTINCT event_type, time_bucket(INTERVAL '1 hour', ts) AS ts FROM events)) GROUP BY strategy
""")
def _(spark, sf):
    eq = V.bars(spark, sf).select(F.col("symbol").alias("strategy"), "ts")
    return rounded(T.annualisation(eq, ["strategy"]))


@query("yearly_pnl", """
SELECT sleeve, CAST(year(ts) AS INTEGER) AS year, round(arg_max(equity, ts) - arg_min(equity, ts), 2) AS pnl, count(*) AS bars
FROM equity GROUP BY ALL HAVING count(*) >= 200
""", ("equity",))
def _(spark, sf):
    eq = T.daily_equity(T.derived(V.trades(spark, sf)), ["sleeve"], START)
    return rounded(T.yearly_pnl(eq, ["sleeve"]), 2)


@query("attribution", """
WITH w AS (SELECT * FROM (VALUES ('A', 0.5), ('N', 0.3), ('R', 0.2), ('Z', 1.0)) v(sleeve, w)),
t AS (SELECT sleeve, count(*) AS trades, sum(net_pnl) AS net_pnl, avg(r_multiple) AS expectancy_r, avg(CASE WHEN r_multiple > 0 THEN 1.0 ELSE 0.0 END) AS win_rate
      FROM trades GROUP BY sleeve)
SELECT w.sleeve, round(w.w / 2.0, 6) AS weight, coalesce(trades, 0) AS trades, round(coalesce(net_pnl, 0), 2) AS net_pnl,
  round(coalesce(expectancy_r, 0), 6) AS expectancy_r, round(coalesce(win_rate, 0), 6) AS win_rate, round(coalesce(net_pnl, 0) / (SELECT sum(net_pnl) FROM t), 6) + 0.0 AS share
FROM w LEFT JOIN t USING (sleeve)
""", ("trades",))
def _(spark, sf):
    w = spark.createDataFrame([("A", 0.5), ("N", 0.3), ("R", 0.2), ("Z", 1.0)], "sleeve string, w double")
    return rounded(T.attribution(V.trades(spark, sf), w), net_pnl=2)


@query("pnl_rollup", """
SELECT symbol, sector, grouping_id(symbol, sector) AS level, count(*) AS trades, round(sum(net_pnl), 2) AS net_pnl, round(sum(gross_pnl), 2) AS gross_pnl,
  round(sum(costs), 2) AS friction, count(*) FILTER (net_pnl > 0) AS wins
FROM (SELECT *, left(symbol, 7) AS sector FROM trades) GROUP BY GROUPING SETS ((symbol, sector), (sector), ())
""", ("trades",))
def _(spark, sf):
    t = V.trades(spark, sf).withColumn("sector", F.substring("symbol", 1, 7))
    return rounded(T.pnl_rollup(t), 2)


@query("concentration", """
WITH m AS (SELECT symbol, sum(net_pnl) AS net_pnl, right(symbol, 1) IN ('1', '2') AS traded FROM trades GROUP BY symbol),
r AS (SELECT *, row_number() OVER (ORDER BY net_pnl DESC, symbol) AS rank, net_pnl / sum(net_pnl) OVER () AS share FROM m)
SELECT symbol, round(net_pnl, 2) AS net_pnl, rank, round(share, 6) AS share, round(sum(share) OVER (ORDER BY rank), 6) AS running_share,
  round(sum(share) FILTER (rank <= 1) OVER (), 6) AS top1_share, round(sum(share) FILTER (rank <= 3) OVER (), 6) AS top3_share,
  round(sum(share) FILTER (rank <= 5) OVER (), 6) AS top5_share, round(sum(share) FILTER (traded) OVER (), 6) AS forward_share,
  (SELECT arg_max(symbol, net_pnl) FROM r WHERE NOT traded) AS best_missed FROM r
""", ("trades",))
def _(spark, sf):
    m = T.derived(V.trades(spark, sf)).groupBy("symbol").agg(F.sum("net_pnl").alias("net_pnl"))
    return rounded(T.concentration(m, F.substring("symbol", -1, 1).isin("1", "2")), net_pnl=2)


cte("weekly", """
SELECT sleeve, period, e - lag(e) OVER (PARTITION BY sleeve ORDER BY period) AS chg
FROM (SELECT sleeve, date_trunc('week', ts) AS period, arg_max(equity, ts) AS e FROM equity GROUP BY ALL)
""", ("equity",), materialized=True)
cte("rho", """
SELECT a.sleeve AS a, b.sleeve AS b, corr(a.chg, b.chg) AS rho FROM weekly a JOIN weekly b ON a.period = b.period AND a.sleeve < b.sleeve
WHERE a.chg IS NOT NULL AND b.chg IS NOT NULL GROUP BY ALL
""", ("weekly",), materialized=True)


def sleeve_rho(spark, sf):
    eq = T.daily_equity(T.derived(V.trades(spark, sf)), ["sleeve"], START)
    return T.pairwise_correlation(T.sleeve_changes(eq, F.date_trunc("week", "ts"), "sleeve"), "sleeve")


@query("pairwise_corr", "SELECT a, b, round(rho, 6) AS rho FROM rho", ("rho",))
def _(spark, sf):
    return rounded(sleeve_rho(spark, sf))


@query("flag_correlated", "SELECT a, b, round(rho, 6) AS rho FROM rho WHERE rho >= 0.0", ("rho",))
def _(spark, sf):
    return rounded(T.flag_correlated(sleeve_rho(spark, sf), 0.0))


@query("diversification", """
SELECT round(m, 6) AS mean_rho, round(sqrt(n / (1 + (n - 1) * greatest(m, -1.0 / (n - 1) + 1e-9))), 6) AS ratio
FROM (SELECT avg(rho) AS m, (SELECT count(DISTINCT s)::DOUBLE FROM (SELECT a AS s FROM rho UNION SELECT b FROM rho)) AS n FROM rho)
""", ("rho",))
def _(spark, sf):
    return rounded(T.diversification_ratio(materialize(sleeve_rho(spark, sf))))


@query("r_histogram", """
WITH e AS (SELECT sleeve, min(r_multiple) AS lo, (max(r_multiple) - min(r_multiple)) / 12 AS w FROM trades GROUP BY sleeve)
SELECT sleeve, bin, round(lo + bin * w, 6) AS lo, round(lo + (bin + 1) * w, 6) AS hi, count(*) AS n
FROM (SELECT sleeve, lo, w, CAST(least(floor((r_multiple - lo) / w), 11) AS INTEGER) AS bin FROM trades JOIN e USING (sleeve)) GROUP BY ALL
""", ("trades",))
def _(spark, sf):
    return rounded(T.r_histogram(V.trades(spark, sf), ["sleeve"]))


@query("consecutive_losses", """
WITH o AS (SELECT *, row_number() OVER w AS n FROM trades WINDOW w AS (PARTITION BY strategy ORDER BY exit_ts, entry_ts, symbol, sleeve, side, volume, gross_pnl, costs))
SELECT strategy, exit_ts, symbol, round(net_pnl, 5) AS net_pnl,
  n - coalesce(max(CASE WHEN net_pnl >= 0 THEN n END) OVER (PARTITION BY strategy ORDER BY n), 0) AS streak,
  max(CASE WHEN net_pnl < 0 THEN exit_ts END) OVER (PARTITION BY strategy ORDER BY n) AS last_loss_ts FROM o
""", ("trades",))
def _(spark, sf):
    d = T.consecutive_losses(V.trades(spark, sf).drop("entry_price"), ["strategy"])
    return rounded(d.select("strategy", "exit_ts", "symbol", "net_pnl", "streak", "last_loss_ts"), 5)


cte("snapshots", """
SELECT symbol AS account, ts, seq, (price - 45.0) * size AS pnl,
  round(sum((price - 45.0) * size) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) + 100000, 6) AS equity FROM prints
""", ("prints",))
cte("book", """
SELECT account, ts, seq, equity, first_value(equity) OVER (PARTITION BY account, CAST(ts AS DATE) ORDER BY ts, seq) AS day_start_equity,
  greatest(max(equity) OVER (PARTITION BY account ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 100000) AS high_water_equity FROM snapshots
""", ("snapshots",))


@query("session_book", """
SELECT account, seq, round(equity, 2) AS equity, round(day_start_equity, 2) AS day_start_equity, round(high_water_equity, 2) AS high_water_equity,
  round((equity - day_start_equity) / nullif(day_start_equity, 0), 9) AS daily_pnl_fraction, round(greatest((100000 - equity) / 100000, 0), 9) AS static_drawdown,
  round(greatest((high_water_equity - equity) / high_water_equity, 0), 9) AS trailing_drawdown FROM book
""", ("book",))
def _(spark, sf):
    d = T.session_book(V.snapshots(spark, sf).drop("pnl"), ["account"], ["ts", "seq"], 100_000.0)
    return rounded(d.drop("ts"), 9, equity=2, day_start_equity=2, high_water_equity=2)


cte("daily_prices", """
SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS day, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
""", materialized=True)


@query("excursions", """
WITH t AS (SELECT *, row_number() OVER () AS id FROM trades),
x AS (SELECT t.id, max(high) AS hi, min(low) AS lo FROM t JOIN daily_prices d ON d.symbol = t.symbol AND d.day BETWEEN CAST(entry_ts AS DATE) AND CAST(exit_ts AS DATE) GROUP BY t.id),
r AS (SELECT t.symbol, t.sleeve, greatest(coalesce(CASE WHEN side > 0 THEN hi - entry_price ELSE entry_price - lo END * volume / risk_cash, 0), 0) AS mfe,
  least(coalesce(CASE WHEN side > 0 THEN lo - entry_price ELSE entry_price - hi END * volume / risk_cash, 0), 0) AS mae FROM t LEFT JOIN x USING (id))
SELECT symbol, sleeve, count(*) AS n, round(avg(mfe), 6) AS mfe, round(avg(mae), 6) AS mae, round(max(mfe), 6) AS best, round(min(mae), 6) AS worst FROM r GROUP BY ALL
""", ("trades", "daily_prices"))
def _(spark, sf):
    e = T.excursions(V.trades(spark, sf), V.daily_prices(spark, sf))
    return rounded(e.groupBy("symbol", "sleeve").agg(
        F.count(F.lit(1)).alias("n"), F.avg("mfe").alias("mfe"), F.avg("mae").alias("mae"),
        F.max("mfe").alias("best"), F.min("mae").alias("worst")))


@query("reconcile", """
SELECT symbol, coalesce(e.v, 0) AS expected, coalesce(a.v, 0) AS actual FROM
(SELECT symbol, sum(side * volume) AS v FROM trades GROUP BY symbol) e FULL JOIN
(SELECT CASE symbol WHEN 'Brand#11' THEN 'Brand#99' ELSE symbol END AS symbol, sum(side * CASE WHEN sleeve = 'R' AND symbol > 'Brand#2' THEN 0 ELSE volume END) AS v FROM trades GROUP BY 1) a USING (symbol)
WHERE abs(coalesce(e.v, 0) - coalesce(a.v, 0)) > 1e-9
""", ("trades",))
def _(spark, sf):
    t = V.trades(spark, sf)
    held = t.withColumn("volume", F.when((F.col("sleeve") == "R") & (F.col("symbol") > "Brand#2"), 0.0).otherwise(F.col("volume")))
    held = held.withColumn("symbol", F.when(F.col("symbol") == "Brand#11", "Brand#99").otherwise(F.col("symbol")))
    return rounded(T.reconcile(t, held))


@query("orphans_anti", """
SELECT o_orderkey AS ticket, o_totalprice AS notional FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
""")
def _(spark, sf):
    pos = (V.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "O")
           .select(F.col("o_orderkey").alias("ticket"), F.col("o_totalprice").alias("notional")))
    return T.orphans(pos, V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ticket")))


# ---------------------------------------------------------------------- costs

cte("costed", """
SELECT t.symbol, t.side, t.volume, t.entry_ts + INTERVAL 1 HOUR * (CAST(t.volume AS INTEGER) % 24) AS entry_ts, t.exit_ts + INTERVAL 1 HOUR * (CAST(t.volume AS INTEGER) * 7 % 24) AS exit_ts,
  t.entry_price, t.gross_pnl, s.spread, s.slippage, s.commission, s.point, s.contract_size, s.swap_mode, s.swap_triple_weekday,
  s.tick_value / s.tick_size AS vpu, CASE WHEN t.side > 0 THEN swap_long ELSE swap_short END AS rate
FROM trades t JOIN specs s USING (symbol)
""", ("trades", "specs"))


def costed(spark, sf):
    """Trades with their cost dimension and intraday entry and exit times."""
    v = F.col("volume").cast("int")
    t = (V.trades(spark, sf)
         .withColumn("entry_ts", F.timestamp_micros(F.unix_micros("entry_ts") + (v % 24).cast("long") * 3_600_000_000))
         .withColumn("exit_ts", F.timestamp_micros(F.unix_micros("exit_ts") + (v * 7 % 24).cast("long") * 3_600_000_000)))
    return C.with_specs(t, V.specs(spark, sf)).withColumn("vpu", F.col("tick_value") / F.col("tick_size"))


@query("entry_costs", """
SELECT symbol, count(*) AS n, round(avg(entry_price + (spread / 2 + slippage) * side), 6) AS avg_fill, round(avg(CASE WHEN hour(entry_ts) < 2 THEN spread * 2 ELSE spread END / 2 + slippage), 6) AS avg_entry_cost,
  round(sum(2 * (spread / 2 + slippage) * 2 * volume * vpu + 2 * commission * volume * 2), 2) AS stressed_cash, round(avg(abs(entry_price) / (2 * (spread / 2 + slippage))), 6) AS edge_ratio
FROM costed GROUP BY symbol
""", ("costed",))
def _(spark, sf):
    d = costed(spark, sf)
    return rounded(d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg(C.fill_price(F.col("entry_price"), F.col("side"))).alias("avg_fill"),
        F.avg(C.entry_cost(F.hour("entry_ts") < 2)).alias("avg_entry_cost"),
        F.sum(C.round_trip_cash(F.col("volume"), F.col("vpu"), 2.0)).alias("stressed_cash"),
        F.avg(C.edge_ratio(F.abs("entry_price"))).alias("edge_ratio")), stressed_cash=2)


@query("swap_nights", """
WITH r AS (SELECT *, row_number() OVER () AS id FROM costed),
n AS (SELECT r.id, sum(CASE WHEN isodow(d) - 1 = swap_triple_weekday THEN 3 ELSE 1 END) AS nights FROM r,
  LATERAL (SELECT unnest(generate_series(date_trunc('day', r.entry_ts) + INTERVAL '21 hours', r.exit_ts, INTERVAL '1 day')) AS d) g
  WHERE d > r.entry_ts AND d <= r.exit_ts GROUP BY r.id),
c AS (SELECT r.symbol, coalesce(n.nights, 0) AS nights, volume * coalesce(n.nights, 0) * -(CASE WHEN rate = 0 OR swap_mode = 0 THEN 0 WHEN swap_mode = 1 THEN rate * point * vpu
  WHEN swap_mode BETWEEN 5 AND 8 THEN rate / 100 * entry_price * contract_size / 360 ELSE rate END) AS swap FROM r LEFT JOIN n USING (id))
SELECT symbol, CAST(sum(nights) AS BIGINT) AS nights, CAST(max(nights) AS BIGINT) AS longest, round(sum(swap), 2) AS swap_cash FROM c GROUP BY symbol
""", ("costed",))
def _(spark, sf):
    d = costed(spark, sf).withColumn("nights", C.swap_nights("entry_ts", "exit_ts", F.col("swap_triple_weekday")))
    cash = C.swap_cash(F.col("side") > 0, F.col("entry_price"), F.col("vpu"), F.col("volume"), F.col("nights"))
    return rounded(d.groupBy("symbol").agg(F.sum("nights").alias("nights"), F.max("nights").alias("longest"),
                                           F.sum(cash).alias("swap_cash")), 2)


@query("stress_sweep", """
WITH s AS (SELECT sleeve, f AS factor, count(*) AS trades, sum(gross_pnl - f * costs) AS net_pnl, avg((gross_pnl - f * costs) / risk_cash) AS e
  FROM trades, (VALUES (1.0::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE)) v(f) GROUP BY ALL)
SELECT s.sleeve, s.factor, s.trades, round(s.net_pnl, 2) AS net_pnl, round(s.e, 6) AS expectancy_r, round(CASE WHEN b.e > 0 THEN s.e / b.e ELSE 0 END, 6) AS survival
FROM s JOIN s b ON b.sleeve = s.sleeve AND b.factor = 1.0
""", ("trades",))
def _(spark, sf):
    return rounded(C.stress_sweep(V.trades(spark, sf), ["sleeve"], [1.0, 2.0, 3.0]), net_pnl=2)


@query("friction_share", """
SELECT symbol, round(sum(costs) / nullif(abs(sum(gross_pnl)), 0), 6) AS friction_share, round(sum(costs) / nullif(sum(gross_pnl) FILTER (gross_pnl > 0), 0), 6) AS cost_drag
FROM trades GROUP BY symbol
""", ("trades",))
def _(spark, sf):
    g = V.trades(spark, sf).groupBy("symbol").agg(
        F.sum("costs").alias("c"), F.sum("gross_pnl").alias("g"),
        F.sum(F.when(F.col("gross_pnl") > 0, F.col("gross_pnl"))).alias("gp"))
    return rounded(g.select("symbol", F.try_divide(F.col("c"), F.abs("g")).alias("friction_share"),
                            F.try_divide("c", "gp").alias("cost_drag")))


cte("fills", """
SELECT CASE event_type WHEN 'purchase' THEN 'other' ELSE event_type END AS symbol, value * 0.002 AS spread, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_type = 'view' THEN 0.0 WHEN event_type = 'click' THEN value * 0.00005
  ELSE value * 0.0005 - 0.01 END AS slippage FROM events
""")
cte("quote_samples", """
SELECT CASE event_type WHEN 'error' THEN 'quoted_only' ELSE event_type END AS symbol, CASE WHEN event_type = 'signup' THEN 0.0 ELSE value * 0.0015 END AS spread FROM events
""")


@query("cost_calibration", """
WITH f AS (SELECT symbol, count(*) AS fills, count(slippage) AS slips, median(spread) AS fs, median(abs(slippage)) AS ss FROM fills GROUP BY symbol),
q AS (SELECT symbol, count(*) AS quotes, median(spread) AS qs FROM quote_samples GROUP BY symbol),
b AS (SELECT CASE event_type WHEN 'view' THEN 'unmeasured' ELSE event_type END AS symbol, avg(value) * 0.002 AS bs, avg(value) * 0.0004 AS bl FROM events GROUP BY 1),
j AS (SELECT symbol, coalesce(fills, 0) AS fills, coalesce(quotes, 0) AS quotes, coalesce(slips, 0) AS slips, ss, bs, bl, CASE WHEN coalesce(quotes, 0) >= 30 THEN qs ELSE fs END AS s
  FROM b FULL JOIN f USING (symbol) FULL JOIN q USING (symbol))
SELECT symbol, fills, quotes, round(CASE WHEN s > 0 THEN s ELSE bs END, 6) AS spread,
  round(CASE WHEN s > 0 AND slips > 0 AND ss > 0 AND ss / s >= 0.05 THEN ss ELSE bl END, 6) AS slippage, coalesce(s > 0, false) AS spread_calibrated,
  coalesce(s > 0 AND slips > 0 AND ss > 0 AND ss / s >= 0.05, false) AS slippage_calibrated,
  CASE WHEN fills = 0 AND quotes = 0 THEN 'never measured' WHEN s IS NULL OR (quotes = 0 AND fills < 2) THEN 'too few observations' WHEN s <= 0 THEN 'spread is zero'
       WHEN slips = 0 THEN 'no slippage observations' WHEN ss <= 0 THEN 'slippage is zero' WHEN ss / s < 0.05 THEN 'slippage implausibly small' ELSE 'measured' END AS note FROM j
""", ("fills", "quote_samples"))
def _(spark, sf):
    e = V.table(spark, sf, "events")
    kind, val = F.col("event_type"), F.col("value")
    slip = (F.when(F.col("event_id") % 11 == 0, None).when(kind == "view", 0.0).when(kind == "click", val * 0.00005)
            .otherwise(val * 0.0005 - 0.01))
    name = lambda was, now: F.when(kind == was, now).otherwise(kind).alias("symbol")
    fills = e.select(name("purchase", "other"), (val * 0.002).alias("spread"), slip.alias("slippage"))
    quotes = e.select(name("error", "quoted_only"), F.when(kind == "signup", 0.0).otherwise(val * 0.0015).alias("spread"))
    base = e.groupBy(name("view", "unmeasured")).agg((F.avg("value") * 0.002).alias("spread"), (F.avg("value") * 0.0004).alias("slippage"))
    return rounded(C.calibrate(fills, quotes, base))


@query("cost_to_stop", """
WITH s AS (SELECT symbol, median(spread) AS spread FROM quotes GROUP BY symbol),
a AS (SELECT 'H1' AS timeframe, symbol, median(atr) AS atr FROM atr_h1 GROUP BY symbol UNION ALL SELECT 'H4', symbol, median(atr) FROM atr_h4 GROUP BY symbol
      UNION ALL SELECT 'D1', symbol, median(atr) FROM atr_d1 GROUP BY symbol)
SELECT timeframe, symbol, round(2 * spread, 6) AS friction, round(1.5 * atr, 6) AS stop, round(2 * spread / (1.5 * atr), 6) AS cost_to_stop FROM a JOIN s USING (symbol)
""", ("quotes", "atr_h1", "atr_h4", "atr_d1"))
def _(spark, sf):
    from tidemark.functions import indicators as I
    from tidemark.plans.q_screen import quotes
    spread = T.exact_median_by(quotes(spark, sf), ["symbol"], F.col("spread"), "spread")
    out = None
    for tf, freq in (("H1", "1 hour"), ("H4", "4 hours"), ("D1", "1 day")):
        a = (I.with_atr(V.bars(spark, sf, freq)).groupBy("symbol").agg(F.median("atr").alias("atr"))
             .withColumn("timeframe", F.lit(tf)))
        out = a if out is None else out.unionByName(a)
    friction, stop = 2 * F.col("spread"), 1.5 * F.col("atr")
    return rounded(out.join(spread, "symbol").select("timeframe", "symbol", friction.alias("friction"), stop.alias("stop"),
                                                     F.try_divide(friction, stop).alias("cost_to_stop")))
