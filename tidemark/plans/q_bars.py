"""Bars and order flow."""

from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.plans import shared_sql  # noqa: F401
from tidemark.plans.registry import query, rounded
from tidemark.sources import views as V

ROUND_DELTA = """
SELECT symbol, ts, open, high, low, close, volume, prints, buy_vol, sell_vol, delta,
       round(delta_pct, 6) AS delta_pct, round(absorption, 6) AS absorption, cum_delta FROM {t}
"""


def hourly_delta(spark, sf):
    return B.delta_bars(V.signed_prints(spark, sf), "1 hour")


@query("delta_bars_1h", ROUND_DELTA.format(t="delta_h1"), ("delta_h1",))
def _(spark, sf):
    return rounded(hourly_delta(spark, sf))


@query("flow_imbalance_1h", """
SELECT symbol, ts, delta, volume, cum_delta,
       round(CASE WHEN count(delta) OVER w >= 12 THEN sum(delta) OVER w / nullif(sum(volume) OVER w, 0) END, 6) AS imbalance
FROM delta_h1 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)
""", ("delta_h1",))
def flow_imbalance(spark, sf):
    d = hourly_delta(spark, sf).withColumn("imbalance", B.imbalance(12))
    return rounded(d.select("symbol", "ts", "delta", "volume", "cum_delta", "imbalance"))


@query("tick_rule_side", "SELECT symbol, seq, side FROM signed_prints", ("signed_prints",))
def _(spark, sf):
    return V.signed_prints(spark, sf).select("symbol", "seq", "side")


@query("resample_4h", """
SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS ts, first(open ORDER BY ts) AS open, max(high) AS high,
       min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume
FROM bars_h1 GROUP BY 1, 2
""", ("bars_h1",))
def _(spark, sf):
    return B.resample(V.bars(spark, sf), "4 hours")


@query("resample_weekly", """
SELECT symbol, time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-05') AS ts, first(open ORDER BY ts) AS open,
       max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume
FROM bars_h1 GROUP BY 1, 2
""", ("bars_h1",))
def _(spark, sf):
    return B.resample(V.bars(spark, sf), "7 days", start=B.WEEK_START)


@query("delta_divergence_1h", """
SELECT symbol, ts, close, cum_delta,
  CASE WHEN n >= 20 AND close <= lo AND NOT cum_delta <= clo THEN -1
       WHEN n >= 20 AND close >= hi AND NOT cum_delta >= chi THEN 1 ELSE 0 END AS divergence
FROM (SELECT *, count(*) OVER w AS n, max(close) OVER w AS hi, min(close) OVER w AS lo,
             max(cum_delta) OVER w AS chi, min(cum_delta) OVER w AS clo
      FROM delta_h1 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
""", ("delta_h1",))
def _(spark, sf):
    d = hourly_delta(spark, sf).withColumn("divergence", B.delta_divergence(20))
    return d.select("symbol", "ts", "close", "cum_delta", "divergence")


@query("open_imbalance", """
SELECT symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, sum(delta) AS open_delta, sum(volume) AS open_volume,
       first(open ORDER BY ts) AS open_first, last(close ORDER BY ts) AS open_close,
       max(ts) + INTERVAL '5 minutes' AS available_at,
       round(sum(delta) / nullif(sum(volume), 0), 6) AS open_delta_pct
FROM delta_m5 WHERE hour(ts) * 60 + minute(ts) >= 810 AND hour(ts) * 60 + minute(ts) < 840
GROUP BY 1, 2
""", ("delta_m5",))
def _(spark, sf):
    b = B.delta_bars(V.signed_prints(spark, sf), "5 minutes")
    return rounded(B.open_imbalance(b, 13, 30))
