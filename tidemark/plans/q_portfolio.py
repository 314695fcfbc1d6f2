"""Ranked portfolios over the monthly panel."""

from pyspark.sql import functions as F

from tidemark.functions.distributions import normal_quantile
from tidemark.operators import costs as C
from tidemark.operators import portfolio as P
from tidemark.plans.registry import cte, query, rounded
from tidemark.sources import views as V

M = "PARTITION BY symbol ORDER BY month"

cte("dense", f"""
SELECT g.symbol, g.month, level, level / nullif(lag(level) OVER (PARTITION BY g.symbol ORDER BY g.month), 0) - 1 AS ret
FROM (SELECT symbol, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM panel GROUP BY symbol) g
LEFT JOIN panel p ON p.symbol = g.symbol AND p.month = g.month
""", ("panel",), materialized=True)


def panel(spark, sf):
    return P.dense_months(V.panel(spark, sf))


def _book(k: int, n: int) -> str:
    return f"""
SELECT * FROM (SELECT *, count(sig) OVER (PARTITION BY month) AS n, row_number() OVER (PARTITION BY month ORDER BY sig DESC NULLS LAST, symbol) AS hi,
  row_number() OVER (PARTITION BY month ORDER BY sig ASC NULLS LAST, symbol) AS lo
 FROM (SELECT *, lag(past) OVER ({M}) AS sig FROM (SELECT *, level / nullif(lag(level, {k}) OVER ({M}), 0) - 1 AS past FROM dense)))
WHERE sig IS NOT NULL AND n >= {2 * n} AND (hi <= {n} OR lo <= {n})
"""


for _k in (1, 3, 6, 12):
    cte(f"book_{_k}", _book(_k, 5), ("dense",), materialized=True)
    cte(f"turn_{_k}", f"""
SELECT b.month, CASE WHEN any_value(m.pm) IS NULL THEN 1.0 ELSE (any_value(m.sz) + any_value(m.psz) - 2 * count(p.symbol)) / any_value(m.sz) END AS turnover
FROM book_{_k} b JOIN (SELECT month, count(*) AS sz, lag(month) OVER (ORDER BY month) AS pm, lag(count(*)) OVER (ORDER BY month) AS psz FROM book_{_k} GROUP BY month) m USING (month)
LEFT JOIN book_{_k} p ON p.symbol = b.symbol AND p.month = m.pm GROUP BY b.month
""", (f"book_{_k}",))
    cte(f"xs_{_k}", f"""
SELECT b.month, avg(ret) FILTER (hi <= 5) - avg(ret) FILTER (hi > 5) AS ret, any_value(t.turnover) AS turnover
FROM book_{_k} b JOIN turn_{_k} t USING (month) GROUP BY b.month HAVING avg(ret) FILTER (hi <= 5) - avg(ret) FILTER (hi > 5) IS NOT NULL
""", (f"book_{_k}", f"turn_{_k}"))


@query("panel_complete", """
WITH b AS (SELECT symbol, day, high AS close FROM daily_prices), c AS (SELECT day, row_number() OVER (ORDER BY day) AS r, count(*) OVER () AS nd FROM (SELECT DISTINCT day FROM b)),
d AS (SELECT symbol, close, r, nd, coalesce(lead(r) OVER (PARTITION BY symbol ORDER BY r), nd + 1) AS nx FROM b JOIN c USING (day)),
f AS (SELECT symbol, close, r + k AS r, nd FROM d, (VALUES (0), (1), (2), (3)) v(k) WHERE r + k < nx),
s AS (SELECT symbol FROM f GROUP BY symbol, nd HAVING count(*) >= floor(nd * 0.9))
SELECT symbol, CAST(day AS VARCHAR) AS day, round(close, 9) AS close FROM f JOIN s USING (symbol) JOIN c USING (r)
WHERE r IN (SELECT r FROM f JOIN s USING (symbol) GROUP BY r HAVING count(*) = (SELECT count(*) FROM s))
""", ("daily_prices",))
def _(spark, sf):
    b = V.daily_prices(spark, sf).select("symbol", F.col("day").alias("ts"), F.col("high").alias("close"))
    return rounded(P.load_panel(b), 9)


@query("xs_momentum", "SELECT CAST(month AS VARCHAR) AS month, round(ret, 6) AS ret, round(turnover, 6) AS turnover FROM xs_3", ("xs_3",))
def _(spark, sf):
    return rounded(P.xs_momentum(panel(spark, sf), [3], 5).drop("lookback"))


@query("turnover", "SELECT CAST(month AS VARCHAR) AS month, round(turnover, 6) AS turnover FROM turn_6", ("turn_6",))
def _(spark, sf):
    return rounded(P.turnover(P.momentum_books(panel(spark, sf), [6], 5)))


BAR = normal_quantile(1 - 0.025 / 4)


@query("portfolio_stats", f"""
WITH p AS (SELECT 'xs_01m' AS variant, * FROM xs_1 UNION ALL SELECT 'xs_03m', * FROM xs_3 UNION ALL SELECT 'xs_06m', * FROM xs_6 UNION ALL SELECT 'xs_12m', * FROM xs_12),
e AS (SELECT *, exp(sum(ln(CASE WHEN ret > -1 THEN 1 + ret ELSE 1e-300 END)) OVER (PARTITION BY variant ORDER BY month)) AS eq FROM p),
d AS (SELECT variant, max(1 - eq / pk) AS max_dd FROM (SELECT *, max(eq) OVER (PARTITION BY variant ORDER BY month) AS pk FROM e) GROUP BY variant),
y AS (SELECT variant, CAST(count(*) FILTER (r > 0) AS BIGINT) AS years_pos, count(*) AS years FROM (SELECT variant, year(month) AS y, sum(ret) AS r FROM p GROUP BY ALL) GROUP BY variant),
g AS (SELECT variant, count(*) AS months, avg(ret) AS m, stddev_samp(ret) AS sd, avg(turnover) AS tu FROM p GROUP BY variant)
SELECT variant, months, CASE WHEN months >= 24 THEN round(m * 12, 6) ELSE 0 END AS ann_return, CASE WHEN months >= 24 THEN round(sd * sqrt(12), 6) ELSE 0 END AS ann_vol,
  CASE WHEN months >= 24 THEN round(m * 12 / (sd * sqrt(12)), 6) ELSE 0 END AS sharpe, CASE WHEN months >= 24 THEN round(m / (sd / sqrt(months)), 6) ELSE 0 END AS t,
  CASE WHEN months >= 24 THEN round(max_dd, 6) ELSE 0 END AS max_dd, CASE WHEN months >= 24 THEN years_pos ELSE 0 END AS years_pos, CASE WHEN months >= 24 THEN years ELSE 0 END AS years,
  CASE WHEN months >= 24 THEN round(CASE WHEN m > 0 THEN tu * 0.001 / m END, 6) END AS cost_drag,
  CASE WHEN months < 24 THEN 'too few months' WHEN m / (sd / sqrt(months)) >= {BAR} AND years >= 6 AND years_pos >= 0.65 * years AND m * 12 / (sd * sqrt(12)) > 0.4 THEN 'SURVIVES'
       WHEN m / (sd / sqrt(months)) >= {BAR} THEN 'significant, inconsistent'
       WHEN abs(m / (sd / sqrt(months))) >= 2 AND years >= 6 AND years_pos >= 0.65 * years THEN 'consistent, below bar' ELSE '-' END AS verdict
FROM g JOIN d USING (variant) JOIN y USING (variant)
""", ("xs_1", "xs_3", "xs_6", "xs_12"))
def _(spark, sf):
    runs = P.xs_momentum(panel(spark, sf), [1, 3, 6, 12], 5)
    named = runs.withColumn("variant", F.format_string("xs_%02dm", "lookback"))
    return rounded(P.portfolio_stats(named, ["variant"], 4, 0.001))


@query("tsmom_book", f"""
WITH a AS (SELECT *, sign(level / nullif(lag(level, 12) OVER ({M}), 0) - 1) AS sg, CASE WHEN count(ret) OVER w >= 12 THEN stddev_samp(ret) OVER w END AS v
  FROM dense WINDOW w AS ({M} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
b AS (SELECT *, least(greatest(lag(sg) OVER ({M}) * 0.1 / nullif(lag(v) OVER ({M}) * sqrt(12), 0), -4), 4) AS wt FROM a),
c AS (SELECT *, abs(wt - lag(wt) OVER ({M})) AS step FROM b)
SELECT CAST(month AS VARCHAR) AS month, round(avg(wt * ret), 6) AS ret, round(coalesce(sum(step), 0) / nullif(sum(abs(wt)), 0), 6) AS turnover FROM c GROUP BY month HAVING avg(wt * ret) IS NOT NULL
""", ("dense",))
def _(spark, sf):
    return rounded(P.tsmom_portfolio(panel(spark, sf)))


cte("nation_carry", """
SELECT n_name AS symbol, avg(c_acctbal) / 100000 / 12 * 22 AS carry FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")


@query("carry_book", """
WITH c AS (SELECT *, least(15, floor(count(*) OVER () / 2)) AS n, row_number() OVER (ORDER BY carry DESC, symbol) AS hi, row_number() OVER (ORDER BY carry, symbol) AS lo FROM nation_carry)
SELECT CAST(month AS VARCHAR) AS month, round(avg(ret) FILTER (hi <= n) - avg(ret) FILTER (hi > n AND lo <= n), 6) AS ret, 0.0::DOUBLE AS turnover
FROM dense JOIN c USING (symbol) GROUP BY month HAVING avg(ret) FILTER (hi <= n) - avg(ret) FILTER (hi > n AND lo <= n) IS NOT NULL
""", ("dense", "nation_carry"))
def _(spark, sf):
    cu = V.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("bal"))
    n = V.table(spark, sf, "nation").select("n_nationkey", "n_name")
    rate = P.swap_to_monthly_carry(F.col("bal") / 12.0, F.lit(1000.0), F.lit(100.0))
    carry = (cu.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("symbol"), rate.alias("carry")))
    return rounded(P.carry_portfolio(panel(spark, sf), carry, 15))


cte("value_w", f"""
WITH a AS (SELECT *, CASE WHEN count(ret) OVER v >= 3 THEN stddev_samp(ret) OVER v END AS vol, CASE WHEN level > 0 THEN ln(level) END AS lp FROM dense WINDOW v AS ({M} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
b AS (SELECT *, CASE WHEN vol > 0 AND count(lp) OVER w = 13 THEN avg(lp) OVER w - lp END AS sc FROM a WINDOW w AS ({M} ROWS BETWEEN 42 PRECEDING AND 30 PRECEDING)),
c AS (SELECT *, count(sc) OVER (PARTITION BY month) AS n, row_number() OVER (PARTITION BY month ORDER BY sc DESC NULLS LAST, symbol) AS hi, row_number() OVER (PARTITION BY month ORDER BY sc ASC NULLS LAST, symbol) AS lo FROM b),
d AS (SELECT *, CASE WHEN sc IS NOT NULL AND n >= 9 THEN CASE WHEN hi <= greatest(1, floor(n / 3)) THEN 1 WHEN lo <= greatest(1, floor(n / 3)) THEN -1 END END AS side FROM c)
SELECT symbol, month, ret, sc, side, coalesce(side * 0.5 * (1 / vol) / sum(CASE WHEN side IS NOT NULL THEN 1 / vol END) OVER (PARTITION BY month, side), 0) AS weight FROM d
""", ("dense",), materialized=True)


@query("value_weights", "SELECT symbol, CAST(month AS VARCHAR) AS month, round(weight, 6) AS weight FROM value_w WHERE weight <> 0", ("value_w",))
def _(spark, sf):
    w = P.value_weights(panel(spark, sf), years=3.0).filter(F.col("weight") != 0)
    return rounded(w.select("symbol", "month", "weight"))


cte("unit_cost", """
SELECT median((spread + 2 * slippage) / price) AS unit_cost FROM specs JOIN (SELECT symbol, arg_max(high, day) AS price FROM daily_prices GROUP BY symbol) USING (symbol) WHERE price > 0
""", ("specs", "daily_prices"))


def unit_cost(spark, sf):
    px = V.daily_prices(spark, sf).groupBy("symbol").agg(F.max_by("high", "day").alias("price"))
    return P.median_friction(V.specs(spark, sf), px)


@query("median_friction", "SELECT round(unit_cost, 9) AS unit_cost FROM unit_cost", ("unit_cost",))
def _(spark, sf):
    return rounded(unit_cost(spark, sf), 9)


@query("value_book", f"""
WITH h AS (SELECT *, coalesce(lag(weight) OVER ({M}), 0) AS held, abs(weight - lag(weight) OVER ({M})) AS step FROM value_w)
SELECT CAST(month AS VARCHAR) AS month, round(sum(held * ret), 6) AS gross, round(coalesce(sum(step), 0), 6) AS turnover,
  round(coalesce(sum(held * ret), 0) - coalesce(sum(step), 0) * 0.002, 6) AS ret FROM h GROUP BY month
""", ("value_w",))
def _(spark, sf):
    return rounded(P.value_portfolio(P.value_weights(panel(spark, sf), years=3.0), 0.002))


@query("futures_style_costs", """
SELECT symbol, tick_size * 1.0 AS spread, tick_size * 0.5 AS slippage, commission, 2.0::DOUBLE AS spread_multiple_at_open FROM specs
""", ("specs",))
def _(spark, sf):
    return rounded(C.futures_costs(V.specs(spark, sf).withColumnRenamed("symbol", "root")))
