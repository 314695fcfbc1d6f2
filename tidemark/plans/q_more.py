"""Reports built from several operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.functions import scalars as X
from tidemark.operators import journal as J
from tidemark.operators import portfolio as P
from tidemark.operators import positioning as PO
from tidemark.operators import screen as S
from tidemark.operators import signals as R
from tidemark.plans import q_data, q_ops, q_portfolio, q_screen
from tidemark.plans.registry import cte, query, rounded
from tidemark.plans.shared_sql import t_two_sided_sql
from tidemark.sources import views as V

W = "PARTITION BY symbol ORDER BY ts"


@query("location_by_week", f"""
WITH d AS (SELECT symbol, ts, date_trunc('week', ts) AS week, close, ((lead(close, 3) OVER ({W}) - close) / nullif(atr, 0)) * bias AS r, bias, rn, abs(ext_atr) <= 0.5 AS near FROM mtf),
c AS (SELECT symbol, week, arg_max(close, ts) / nullif(arg_min(close, ts), 0) - 1 AS price_change FROM d GROUP BY ALL),
g AS (SELECT symbol, week, count(*) FILTER (near) AS n_a, count(*) FILTER (NOT near) AS n_b, avg(r) FILTER (near) AS mean_a, avg(r) FILTER (NOT near) AS mean_b, var_samp(r) FILTER (near) AS va, var_samp(r) FILTER (NOT near) AS vb
 FROM d WHERE bias <> 0 AND rn - 1 >= 60 AND r IS NOT NULL AND near IS NOT NULL GROUP BY ALL)
SELECT symbol, week, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_a - mean_b, 6) AS diff, round((mean_a - mean_b) / sqrt(va / n_a + vb / n_b), 6) AS t, round(price_change, 6) AS price_change
FROM g JOIN c USING (symbol, week) WHERE n_a >= 5 AND n_b >= 5
""", ("mtf",))
def _(spark, sf):
    """The location effect by period, beside what the price did in it."""
    d = q_screen.mtf(spark, sf).withColumn("week", F.date_trunc("week", "ts"))
    w = I.by()
    r = F.try_divide(F.lead("close", 3).over(w) - F.col("close"), F.col("atr")) * F.col("bias")
    d = d.withColumn("i", F.row_number().over(w) - 1).withColumn("r", r).withColumn("near", F.abs("ext_atr") <= 0.5)
    per = Window.partitionBy("symbol", "week")
    chg = F.try_divide(F.max_by("close", "ts").over(per), F.min_by("close", "ts").over(per)) - 1
    d = (d.withColumn("price_change", chg)
         .filter((F.col("bias") != 0) & (F.col("i") >= 60) & F.col("r").isNotNull() & F.col("near").isNotNull()))
    out = S.welch(d, ["symbol", "week", "price_change"], "near", "r", True, False).filter(F.col("diff").isNotNull())
    return rounded(out.drop("dof", "p"))


cte("monthly_carry", """
SELECT symbol, month, level, CASE WHEN lag(level) OVER (PARTITION BY symbol ORDER BY month) > 0 THEN (lag(level) OVER (PARTITION BY symbol ORDER BY month) - level) / level END AS carry, row_number() OVER (PARTITION BY symbol ORDER BY month) AS rn FROM panel
""", ("panel",), materialized=True)
cte("carry_ema", """
SELECT symbol, rn, carry AS y FROM monthly_carry WHERE rn = 2 UNION ALL
SELECT k.symbol, k.rn, (1 - 2.0 / 6) * e.y + 2.0 / 6 * k.carry FROM carry_ema e JOIN monthly_carry k ON k.symbol = e.symbol AND k.rn = e.rn + 1
""", ("monthly_carry",))


@query("carry_signals", """
WITH v AS (SELECT c.symbol, c.month, c.rn, c.level, CASE WHEN c.rn - 1 >= 5 THEN e.y END AS cs, CASE WHEN count(d) OVER w >= 12 THEN stddev_samp(d) OVER w END AS pv
 FROM (SELECT *, level - lag(level) OVER (PARTITION BY symbol ORDER BY month) AS d FROM monthly_carry) c LEFT JOIN carry_ema e ON e.symbol = c.symbol AND e.rn = c.rn WINDOW w AS (PARTITION BY c.symbol ORDER BY c.month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT symbol, CAST(month AS VARCHAR) AS month, CASE WHEN f > 0 THEN 1 ELSE -1 END AS side, round(f, 6) AS forecast FROM (SELECT *, cs / nullif(pv * sqrt(252) / nullif(abs(level), 0), 0) AS f FROM v) WHERE abs(f) >= 0.01
""", ("monthly_carry", "carry_ema"))
def _(spark, sf):
    """Carry in risk units of the raw level, with a deadband."""
    w = Window.partitionBy("symbol").orderBy("ts")
    p = V.panel(spark, sf).select("symbol", F.col("month").cast("timestamp").alias("ts"), F.col("level").alias("close"))
    prev = F.lag("close").over(w)
    d = p.withColumn("carry", F.when(prev > 0, (prev - F.col("close")) / F.col("close"))).withColumn("raw_close", F.col("close"))
    for c in ("open", "high", "low"):
        d = d.withColumn(c, F.col("close") + {"open": 0.0, "high": 1.0, "low": -1.0}[c])
    f = R.carry_forecast(d, smooth=5, vol_window=12, mode="price_vol").filter(F.abs("forecast") >= 0.01)
    return rounded(f.select("symbol", F.to_date("ts").alias("month"), F.signum("forecast").cast("int").alias("side"), "forecast"))


@query("state_changes", """
SELECT CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS runner, CASE user_id % 3 WHEN 0 THEN 'gone' WHEN 1 THEN 'up_but_not_serving' ELSE 'restarting' END AS state, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen
FROM events WHERE event_type = 'error' GROUP BY ALL
""")
def _(spark, sf):
    u = F.col("user_id")
    e = V.table(spark, sf, "events").filter(F.col("event_type") == "error").select(
        F.when(u % 2 == 0, "alpha").otherwise("beta").alias("runner"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(u % 3 == 0, "gone").when(u % 3 == 1, "up_but_not_serving").otherwise("restarting").alias("state"))
    return J.state_changes(e)


@query("forward_report", """
SELECT runner, count(*) FILTER (event = 'heartbeat') AS heartbeats, count(*) FILTER (event = 'decision') AS decisions, count(*) FILTER (status = 'filled') AS filled, count(*) FILTER (approved) AS approved, count(*) FILTER (event = 'roll') AS rolls,
 CAST(floor(epoch(max(ts) FILTER (event = 'heartbeat') - min(ts) FILTER (event = 'heartbeat')) / 86400) AS BIGINT) AS span_days, round(arg_min(equity, ts), 6) AS equity_start, round(arg_max(equity, ts), 6) AS equity_end FROM journal GROUP BY runner
""", ("journal",))
def _(spark, sf):
    return rounded(J.forward_report(q_ops.journal(spark, sf), ["runner"]))


@query("runner_status", """
WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY runner ORDER BY ts DESC, seq DESC) AS newest FROM journal) WHERE newest <= 500)
SELECT runner, max(ts) FILTER (event = 'heartbeat') AS last_beat, epoch(TIMESTAMP '2024-01-31 00:00:00' - max(ts) FILTER (event = 'heartbeat')) < 7200 AS running, arg_max(halted, ts) FILTER (event = 'heartbeat') AS halted,
 count(*) FILTER (event = 'decision') AS recent_decisions, count(*) FILTER (event = 'fill') AS recent_fills FROM r GROUP BY runner
""", ("journal",))
def _(spark, sf):
    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    return J.status(q_ops.journal(spark, sf), now, 7200, 500, ["runner"])


@query("cross_asset_signals", """
WITH o AS (SELECT CAST(ts AS DATE) AS day, lag(r) OVER (ORDER BY ts) AS lagged FROM (SELECT ts, close / lag(close) OVER (ORDER BY ts) - 1 AS r FROM nation_bars WHERE symbol = 'NATION_1'))
SELECT symbol, ts, CAST(coalesce(sign(lagged), 0) AS DOUBLE) AS follow, CAST(-coalesce(sign(lagged), 0) AS DOUBLE) AS fade FROM nation_bars LEFT JOIN o ON o.day = CAST(ts AS DATE) WHERE symbol <> 'NATION_1'
""", ("nation_bars",))
def _(spark, sf):
    b = q_data.nation_bars(spark, sf)
    d = PO.lagged_cross_asset(b.filter(F.col("symbol") != "NATION_1"), b.filter(F.col("symbol") == "NATION_1"), "lagged")
    return d.select("symbol", "ts", S.follows("lagged").alias("follow"), (0.0 - S.follows("lagged")).alias("fade"))


@query("value_scores", """
SELECT symbol, CAST(month AS VARCHAR) AS month, round(sc, 6) AS value FROM (SELECT symbol, month, CASE WHEN count(lp) OVER w = 13 THEN avg(lp) OVER w - lp END AS sc FROM (SELECT *, CASE WHEN level > 0 THEN ln(level) END AS lp FROM dense)
WINDOW w AS (PARTITION BY symbol ORDER BY month ROWS BETWEEN 66 PRECEDING AND 54 PRECEDING)) WHERE sc IS NOT NULL
""", ("dense",))
def _(spark, sf):
    d = P.value_scores(q_portfolio.panel(spark, sf))
    return rounded(d.filter(F.col("value").isNotNull()).select("symbol", "month", "value"))


@query("known_intents", """
SELECT client_id, count(*) AS n FROM (SELECT left(event_type, 12) || '#' || left(sha1(event_type || '|' || (user_id % 20) || '|buy|' || strftime(date_trunc('day', ts), '%Y-%m-%d')), 10) AS client_id FROM events) GROUP BY client_id
""")
def _(spark, sf):
    """Intents keyed so that a retry is recognised: how often each was submitted."""
    e = V.table(spark, sf, "events").select(X.client_id(
        "event_type", (F.col("user_id") % 20).cast("string"), F.lit("buy"), F.date_format("ts", "yyyy-MM-dd")).alias("client_id"))
    return e.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))


@query("bonferroni_hours", f"""
WITH h AS (SELECT symbol, hour(ts) AS hr, (lead(close) OVER ({W}) - close) / nullif(atr, 0) AS fwd FROM atr_h1),
g AS (SELECT hr, count(fwd) AS n, avg(fwd) / (stddev_samp(fwd) / sqrt(count(fwd))) AS t FROM h GROUP BY hr), p AS (SELECT *, {t_two_sided_sql('t', '(n - 1)')} AS p FROM g)
SELECT CAST(hr AS INTEGER) AS hour, n, round(t, 6) AS t, round(p, 6) AS p, p < 0.05 / 24 AS significant FROM p
""", ("atr_h1",))
def _(spark, sf):
    """One-sample t per hour against its trial-corrected bar."""
    d = I.with_atr(V.bars(spark, sf))
    d = d.withColumn("fwd", F.try_divide(F.lead("close").over(I.by()) - F.col("close"), F.col("atr")))
    g = d.groupBy(F.hour("ts").alias("hour")).agg(F.count("fwd").alias("n"), F.sum("fwd").alias("s1"), F.sum(F.col("fwd") * F.col("fwd")).alias("s2"))
    return rounded(S.one_sample(g, 24).select("hour", "n", "t", "p", "significant"))
