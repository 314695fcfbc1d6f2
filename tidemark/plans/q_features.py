"""Quality reports, indicators and as-of joins."""

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.functions import scan
from tidemark.operators import asof, quality as Q
from tidemark.operators import quantiles
from tidemark.plans import shared_sql  # noqa: F401
from tidemark.plans.registry import cte, query, rounded
from tidemark.sources import views as V

W = "PARTITION BY symbol ORDER BY ts"

# ------------------------------------------------------------------ quality

cte("raw_bars", """
SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_orderkey AS seq, o_totalprice AS open,
       o_totalprice * (1 + (o_orderkey % 7 - 1) / 100.0::DOUBLE) AS high,
       o_totalprice * (1 - (o_custkey % 5 - 1) / 100.0::DOUBLE) AS low,
       CASE WHEN o_custkey % 97 = 0 THEN NULL ELSE o_totalprice * (1 + (o_custkey % 11 - 5) / 200.0::DOUBLE) END AS close,
       1.0::DOUBLE AS volume
FROM orders
""")


def raw_bars(spark, sf):
    """Unchecked bars as a vendor might deliver them: duplicate stamps, broken ranges, holes."""
    px, ck, ok = F.col("o_totalprice"), F.col("o_custkey"), F.col("o_orderkey")
    return V.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        ok.alias("seq"), px.alias("open"), (px * (1 + (ok % 7 - 1) / 100.0)).alias("high"),
        (px * (1 - (ck % 5 - 1) / 100.0)).alias("low"),
        F.when(ck % 97 != 0, px * (1 + (ck % 11 - 5) / 200.0)).alias("close"), F.lit(1.0).alias("volume"))


@query("validate_counts", """
SELECT symbol, count(*) AS rows, count(*) FILTER (close IS NULL) AS null_ohlc,
       count(*) FILTER (open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS nonpositive,
       count(*) FILTER (high < low) AS high_below_low,
       count(*) FILTER (open > high OR open < low OR close > high OR close < low) AS outside_range,
       count(*) - count(DISTINCT ts) AS duplicate_ts,
       count(*) FILTER (ts < before) AS unsorted
FROM (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY seq) AS before FROM raw_bars) GROUP BY symbol
""", ("raw_bars",))
def _(spark, sf):
    return Q.validate_counts(raw_bars(spark, sf), ingest="seq")


cte("gaps_h1", f"""
SELECT *, CASE WHEN isodow(gap_start) = 5 AND isodow(gap_end) IN (7, 1) THEN 'weekend'
               WHEN epoch(gap_end - gap_start) <= 7200 AND hour(gap_start) >= 20 THEN 'rollover' ELSE 'GAP' END AS kind
FROM (SELECT symbol, gap_start, gap_end, CAST(floor(epoch(gap_end - gap_start) / 3600) - 1 AS BIGINT) AS missing_bars
      FROM (SELECT symbol, lag(ts) OVER ({W}) AS gap_start, ts AS gap_end FROM bars_h1))
WHERE missing_bars >= 1
""", ("bars_h1",))


@query("gaps_classified", "SELECT * FROM gaps_h1", ("gaps_h1",))
def _(spark, sf):
    return Q.find_gaps(V.bars(spark, sf), "H1").withColumn("kind", Q.gap_kind())


@query("coverage_report", """
SELECT c.*, coalesce(g.gaps, 0) AS gaps, coalesce(g.unexplained, 0) AS unexplained,
       round(rows / (floor(epoch(last_ts - first_ts) / 3600) + 1), 6) AS density
FROM (SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS rows,
             CAST(floor(epoch(max(ts) - min(ts)) / 86400) AS BIGINT) AS span_days FROM bars_h1 GROUP BY symbol) c
LEFT JOIN (SELECT symbol, count(*) AS gaps, count(*) FILTER (kind = 'GAP') AS unexplained FROM gaps_h1 GROUP BY symbol) g
USING (symbol)
""", ("gaps_h1", "bars_h1"))
def _(spark, sf):
    return rounded(Q.store_report(V.bars(spark, sf), "H1"))


@query("worst_gaps", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY missing_bars DESC, gap_start) AS rank
FROM gaps_h1 WHERE kind = 'GAP') WHERE rank <= 3
""", ("gaps_h1",))
def _(spark, sf):
    return Q.worst_gaps(V.bars(spark, sf), "H1", 3)


@query("session_profile", """
WITH h AS (SELECT symbol, hour(ts) AS hr, count(*) AS n FROM bars_h1 GROUP BY 1, 2)
SELECT symbol, count(*) AS bars, CAST(min(hour(ts)) FILTER (isodow(ts) = 7) AS INTEGER) AS first_sunday_hour,
       CAST(max(hour(ts)) FILTER (isodow(ts) = 5) AS INTEGER) AS last_friday_hour,
       count(*) FILTER (isodow(ts) >= 6) AS weekend_bars,
       (SELECT CAST(first(hr ORDER BY n DESC, hr) AS INTEGER) FROM h WHERE h.symbol = b.symbol) AS busiest_hour
FROM bars_h1 b GROUP BY symbol
""", ("bars_h1",))
def _(spark, sf):
    return Q.session_profile(V.bars(spark, sf))


@query("sunday_fold", f"""
WITH s AS (SELECT *, isodow(ts) = 7 AND CAST(lead(ts) OVER ({W}) AS DATE) - CAST(ts AS DATE) = 1 AS stub FROM bars_d1),
p AS (SELECT *, coalesce(lag(stub) OVER ({W}), false) AS fold, lag(open) OVER ({W}) AS po, lag(high) OVER ({W}) AS ph,
             lag(low) OVER ({W}) AS pl, lag(volume) OVER ({W}) AS pv FROM s)
SELECT symbol, ts, CASE WHEN fold THEN po ELSE open END AS open,
       CASE WHEN fold THEN greatest(high, ph) ELSE high END AS high,
       CASE WHEN fold THEN least(low, pl) ELSE low END AS low, close,
       CASE WHEN fold THEN volume + pv ELSE volume END AS volume
FROM p WHERE NOT coalesce(stub, false)
""", ("bars_d1",))
def _(spark, sf):
    return Q.merge_sunday_stubs(V.bars(spark, sf, "1 day").drop("prints"))


@query("lookahead_audit", f"""
WITH e AS (SELECT b.symbol, b.ts, CASE WHEN b.rn >= 14 THEN y END AS v FROM rows_h1 b JOIN atr_h1_r a USING (symbol, rn))
SELECT count(*) AS rows_compared, CAST(0 AS BIGINT) AS mismatches FROM e WHERE ts <= TIMESTAMP '2024-01-16 00:00:00'
""", ("rows_h1", "atr_h1_r"))
def _(spark, sf):
    return Q.lookahead_audit(lambda d: I.with_atr(d), V.bars(spark, sf), datetime(2024, 1, 16), ["symbol", "ts"], "atr")


# --------------------------------------------------------------- indicators

@query("sma_vol_donchian", f"""
SELECT symbol, ts, round(CASE WHEN n20 THEN avg(close) OVER t END, 6) AS sma20,
       round(CASE WHEN count(d) OVER t >= 20 THEN stddev_samp(d) OVER t END, 6) AS price_vol20,
       round(CASE WHEN count(l) OVER t >= 20 THEN stddev_samp(l) OVER t * sqrt(252) END, 6) AS realized_vol20,
       CASE WHEN count(high) OVER p >= 20 THEN max(high) OVER p END AS upper,
       CASE WHEN count(low) OVER p >= 20 THEN min(low) OVER p END AS lower,
       round(close / nullif(lag(close, 5) OVER ({W}), 0) - 1, 6) AS ret5
FROM (SELECT *, row_number() OVER ({W}) >= 20 AS n20, close - lag(close) OVER ({W}) AS d,
             CASE WHEN close / nullif(lag(close) OVER ({W}), 0) > 0 THEN ln(close / nullif(lag(close) OVER ({W}), 0)) END AS l
      FROM bars_h1)
WINDOW t AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), p AS ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
""", ("bars_h1",))
def _(spark, sf):
    up, down = I.donchian(20)
    d = I.realized_vol(I.price_vol(V.bars(spark, sf), 20, "price_vol20"), 20, "realized_vol20")
    return rounded(d.select("symbol", "ts", I.sma("close", 20).alias("sma20"), "price_vol20", "realized_vol20",
                            up.alias("upper"), down.alias("lower"), I.rolling_return(5).alias("ret5")))


@query("ema_atr", """
SELECT b.symbol, b.ts, round(b.tr, 6) AS tr, round(b.atr, 6) AS atr,
       round(CASE WHEN b.rn >= 50 THEN e.y END, 6) AS ema50
FROM atr_h1 b JOIN ema50_h1 e ON e.symbol = b.symbol AND e.rn = b.rn
""", ("atr_h1", "ema50_h1"))
def _(spark, sf):
    d = V.bars(spark, sf).withColumn("tr", I.true_range())
    d = scan.ema(I.with_atr(d), "close", 50, "ema50")
    return rounded(d.select("symbol", "ts", "tr", "atr", "ema50"))


@query("rolling_percentile", f"""
SELECT a.symbol, a.ts, round((count(*) FILTER (b.close < a.close) + (count(*) FILTER (b.close = a.close) + 1) / 2.0) / 100, 6) AS pct
FROM rows_h1 a JOIN rows_h1 b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn - 99 AND a.rn
WHERE a.rn >= 100 GROUP BY a.symbol, a.ts
""", ("rows_h1",))
def _(spark, sf):
    d = V.bars(spark, sf).withColumn("pct", I.rolling_percentile("close", 100))
    return rounded(d.filter(F.col("pct").isNotNull()).select("symbol", "ts", "pct"))


cte("regime_sql", f"""
SELECT symbol, ts, rn, atr, close, open, high, low,
       CASE WHEN rn >= 33 THEN atr / nullif(avg(atr) OVER t20, 0) - 1 END AS vol_change,
       CASE WHEN rn >= 33 THEN atr / nullif(avg(atr) OVER t20, 0) END AS vol_ratio,
       CASE WHEN rn >= 21 THEN abs(close - lag(close, 20) OVER ({W})) / nullif(sum(step) OVER t20, 0) END AS efficiency,
       CASE WHEN rn >= 21 THEN stddev_samp(d) OVER t20 END / nullif(atr, 0) AS cc_vs_range,
       (close - lag(close, 5) OVER ({W})) / nullif(atr * sqrt(5), 0) AS mom_5,
       (close - lag(close, 20) OVER ({W})) / nullif(atr * sqrt(20), 0) AS mom_20,
       (close - lag(close, 60) OVER ({W})) / nullif(atr * sqrt(60), 0) AS mom_60
FROM (SELECT *, close - lag(close) OVER ({W}) AS d, abs(close - lag(close) OVER ({W})) AS step FROM atr_h1)
WINDOW t20 AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
""", ("atr_h1",))


@query("regime_features", """
WITH p AS (SELECT a.symbol, a.rn, (count(*) FILTER (b.atr < a.atr) + (count(*) FILTER (b.atr = a.atr) + 1) / 2.0) / 252 AS vol
  FROM atr_h1 a JOIN atr_h1 b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn - 251 AND a.rn WHERE a.rn >= 265 GROUP BY 1, 2)
SELECT r.symbol, r.ts, round(vol, 6) AS vol, round(vol_change, 6) AS vol_change, round(efficiency, 6) AS efficiency,
       round(CASE WHEN r.rn >= 20 THEN abs(close - y) / nullif(atr, 0) END, 6) AS trend
FROM regime_sql r JOIN ema20_h1 e ON e.symbol = r.symbol AND e.rn = r.rn
LEFT JOIN p ON p.symbol = r.symbol AND p.rn = r.rn
""", ("regime_sql", "ema20_h1", "atr_h1"))
def _(spark, sf):
    return rounded(I.regime_features(V.bars(spark, sf)).select("symbol", "ts", *I.REGIME_COLUMNS))


@query("meta_features", """
WITH p AS (SELECT a.symbol, a.rn, (count(*) FILTER (b.atr < a.atr) + (count(*) FILTER (b.atr = a.atr) + 1) / 2.0) / 252 AS atr_pct
  FROM atr_h1 a JOIN atr_h1 b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn - 251 AND a.rn WHERE a.rn >= 265 GROUP BY 1, 2)
SELECT r.symbol, r.ts, round(atr_pct, 6) AS atr_pct, round(vol_ratio, 6) AS vol_ratio, round(cc_vs_range, 6) AS cc_vs_range,
       round(mom_5, 6) AS mom_5, round(mom_20, 6) AS mom_20, round(mom_60, 6) AS mom_60,
       round(CASE WHEN r.rn >= 50 THEN (close - y) / nullif(atr, 0) END, 6) AS dist_ema_atr,
       round((high - low) / nullif(atr, 0), 6) AS range_ratio, round(efficiency, 6) AS efficiency,
       round(abs(close - open) / nullif(high - low, 0), 6) AS body_ratio, CAST(isodow(r.ts) - 1 AS INTEGER) AS dow
FROM regime_sql r JOIN ema50_h1 e ON e.symbol = r.symbol AND e.rn = r.rn
LEFT JOIN p ON p.symbol = r.symbol AND p.rn = r.rn
""", ("regime_sql", "ema50_h1", "atr_h1"))
def _(spark, sf):
    return rounded(I.meta_features(V.bars(spark, sf)).select("symbol", "ts", *I.META_COLUMNS))


@query("session_and_runway", f"""
SELECT symbol, ts, hour(ts) >= 7 AND hour(ts) < 20 AS day_session, hour(ts) >= 22 OR hour(ts) < 6 AS night_session,
  CAST(floor((CASE WHEN 72000 - s > 0 THEN 72000 - s ELSE 158400 - s END) / 3600.0) AS INTEGER) AS bars_to_flat,
  coalesce(date_trunc('month', lag(ts) OVER ({W})) <> date_trunc('month', ts), true) AS month_start
FROM (SELECT *, hour(ts) * 3600 + minute(ts) * 60 AS s FROM bars_h1)
""", ("bars_h1",))
def _(spark, sf):
    return V.bars(spark, sf).select(
        "symbol", "ts", I.session_mask(7, 20).alias("day_session"), I.session_mask(22, 6).alias("night_session"),
        I.bars_until(20, 60).alias("bars_to_flat"), I.month_start().alias("month_start"))


# -------------------------------------------------------------------- as-of

@query("asof_htf", """
SELECT l.symbol, l.ts, l.close, r.close AS h4_close, round(r.atr, 6) AS h4_atr
FROM bars_h1 l ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL '4 hours' AS available_at, close, atr FROM atr_h4) r
ON l.symbol = r.symbol AND l.ts >= r.available_at
""", ("bars_h1", "atr_h4"))
def _(spark, sf):
    h4 = I.with_atr(V.bars(spark, sf, "4 hours"))
    out = asof.align_higher_timeframe(V.bars(spark, sf), h4, "H4", ["close", "atr"])
    return rounded(out.select("symbol", "ts", "close", "h4_close", "h4_atr"))


@query("asof_prints_to_bars", """
SELECT p.symbol, p.seq, p.price, b.ts AS bar_ts, b.close AS bar_close
FROM prints p ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL '1 hour' AS available_at, ts, close FROM bars_h1) b
ON p.symbol = b.symbol AND p.ts >= b.available_at
""", ("prints", "bars_h1"))
def _(spark, sf):
    p = V.prints(spark, sf)
    b = V.bars(spark, sf).select("symbol", F.col("ts").alias("bar_ts"), F.col("close").alias("bar_close"),
                                 (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("available_at"))
    out = asof.asof_join(p, b, ["symbol"], "ts", "available_at")
    return out.select("symbol", "seq", "price", "bar_ts", "bar_close")


@query("exact_median_price", """
SELECT symbol, round(median(price), 6) AS median_price, round(quantile_cont(price, 0.95), 6) AS p95_price FROM prints GROUP BY symbol
""", ("prints",))
def _(spark, sf):
    p = V.prints(spark, sf)
    return rounded(quantiles.exact_median(p, ["symbol"], "price", "median_price")
                   .join(quantiles.exact_quantile(p, ["symbol"], "price", 0.95, "p95_price"), "symbol"))
