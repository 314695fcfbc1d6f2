"""Scalars, sizing, journal digests and the limit audit."""

from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.functions import scalars as X
from tidemark.operators import journal as J
from tidemark.operators import limits as L
from tidemark.operators import signals as R
from tidemark.operators import trades as T
from tidemark.plans.registry import cte, query, rounded
from tidemark.sources import views as V

# -------------------------------------------------------------------- scalars

cte("proposals", """
SELECT l_orderkey, l_linenumber, p_brand AS symbol, l_extendedprice * 10 AS equity, 0.001 * (1 + l_linenumber % 20) AS risk_fraction, l_quantity / 10 AS stop_distance,
  CASE WHEN l_returnflag = 'R' THEN 0.5 ELSE 1.0 END AS regime_scalar, 1 - l_discount AS confidence, 30.0::DOUBLE AS margin_volume
FROM lineitem JOIN part ON l_partkey = p_partkey
""")


def proposals(spark, sf):
    li, p = V.table(spark, sf, "lineitem"), V.table(spark, sf, "part").select("p_partkey", "p_brand")
    d = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("symbol"), (F.col("l_extendedprice") * 10).alias("equity"),
        (0.001 * (1 + F.col("l_linenumber") % 20)).alias("risk_fraction"), (F.col("l_quantity") / 10).alias("stop_distance"),
        F.when(F.col("l_returnflag") == "R", 0.5).otherwise(1.0).alias("regime_scalar"),
        (1 - F.col("l_discount")).alias("confidence"), F.lit(30.0).alias("margin_volume"))
    return d.join(V.specs(spark, sf), "symbol")


@query("position_sizing", """
WITH a AS (SELECT p.*, s.tick_value / s.tick_size AS vpu, equity * risk_fraction * regime_scalar * confidence AS budget, volume_min, volume_max, volume_step FROM proposals p JOIN specs s USING (symbol)),
b AS (SELECT *, round(floor(budget / (stop_distance * vpu) / volume_step + 1e-9) * volume_step, 8) AS raw FROM a),
c AS (SELECT *, CASE WHEN raw > volume_max THEN volume_max ELSE raw END AS v FROM b),
d AS (SELECT *, CASE WHEN raw < volume_min THEN 'below_minimum' WHEN v > margin_volume THEN 'capped_by_margin' WHEN raw > volume_max THEN 'capped_by_maximum' ELSE 'ok' END AS outcome,
  CASE WHEN raw < volume_min THEN 0 WHEN v > margin_volume THEN margin_volume ELSE v END AS sized FROM c)
SELECT symbol, outcome, count(*) AS n, round(sum(sized), 6) AS volume, round(sum(sized * stop_distance * vpu), 2) AS risk_cash, round(max(sized * stop_distance * vpu / equity), 6) AS worst FROM d GROUP BY ALL
""", ("proposals", "specs"))
def _(spark, sf):
    d = X.size_positions(proposals(spark, sf), "margin_volume")
    return rounded(d.groupBy("symbol", "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sized_volume").alias("volume"), F.sum("risk_cash_sized").alias("risk_cash"),
        F.max("risk_fraction_sized").alias("worst")), risk_cash=2)


cte("daily_stop", """
SELECT a.symbol, a.ts, 2 * a.atr AS stop_distance, 0.05::DOUBLE AS vpu FROM atr_d1 a WHERE a.atr IS NOT NULL
""", ("atr_d1",))


def daily_stop(spark, sf):
    d = I.with_atr(V.bars(spark, sf, "1 day")).filter(F.col("atr").isNotNull())
    return d.select("symbol", "ts", (F.col("atr") * 2).alias("stop_distance"), F.lit(0.01).alias("tick_size"),
                    F.lit(0.0005).alias("tick_value"), F.lit(1.0).alias("volume_min"), F.lit(1000.0).alias("volume_max"),
                    F.lit(1.0).alias("volume_step"))


@query("sizing_grid", """
SELECT symbol, ts, e AS equity, CASE WHEN v < 1 THEN 0 ELSE least(v, 1000) END AS contracts, round(stop_distance * vpu / 0.005, 6) AS min_equity FROM
(SELECT *, floor(e * 0.005 / (stop_distance * vpu) + 1e-9) AS v FROM daily_stop, (VALUES (500.0::DOUBLE), (5000.0::DOUBLE), (25000.0::DOUBLE), (100000.0::DOUBLE)) l(e))
""", ("daily_stop",))
def _(spark, sf):
    d = X.capital_ladder(daily_stop(spark, sf), [500, 5000, 25000, 100000], 0.005)
    return rounded(d.select("symbol", "ts", "equity", F.col("sized_volume").alias("contracts"), "min_equity"))


@query("viability", """
SELECT symbol, ts, round(stop_distance * vpu, 6) AS min_lot_risk, round(stop_distance * vpu / 1500, 6) AS min_lot_share,
  CASE WHEN floor(1500 * 0.005 / (stop_distance * vpu) + 1e-9) >= 1 THEN 'OK' ELSE 'TOO SMALL' END AS verdict FROM daily_stop
""", ("daily_stop",))
def _(spark, sf):
    d = X.viability(daily_stop(spark, sf), 1500, 0.005)
    return rounded(d.select("symbol", "ts", "min_lot_risk", "min_lot_share", "verdict"))


@query("default_stop", "SELECT symbol, round(arg_max(high - low, ts) * 2, 6) AS default_stop FROM bars_d1 GROUP BY symbol", ("bars_d1",))
def _(spark, sf):
    return rounded(X.default_stop(V.bars(spark, sf, "1 day")))


@query("spec_arithmetic", """
SELECT symbol, round(tick_value / tick_size, 6) AS value_per_unit, round(stops_level_points * point, 6) AS min_stop, round(7.654321::DOUBLE, 2) AS px,
  round(3 * 1.25 * tick_value / tick_size, 6) AS risk3, round(CASE WHEN swap_long = 0 OR swap_mode = 0 THEN 0 WHEN swap_mode = 1 THEN swap_long * point * tick_value / tick_size
   WHEN swap_mode BETWEEN 5 AND 8 THEN swap_long / 100 * 50.0 * contract_size / 360 ELSE swap_long END, 6) AS swap_long_night FROM specs
""", ("specs",))
def _(spark, sf):
    from tidemark.operators import costs as C
    return rounded(V.specs(spark, sf).select(
        "symbol", X.value_per_unit().alias("value_per_unit"), X.min_stop_distance().alias("min_stop"),
        X.normalize_price(F.lit(7.654321)).alias("px"), X.risk_for(F.lit(3.0), F.lit(1.25)).alias("risk3"),
        C.swap_rate(F.lit(True), F.lit(50.0), X.value_per_unit()).alias("swap_long_night")))


@query("server_clock", """
SELECT event_id, (ts - INTERVAL '7 hours') AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS utc, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' + INTERVAL '7 hours' AS server,
  CASE WHEN abs(d) <= 15 THEN 'verified' WHEN d > 30 THEN 'unverifiable' ELSE 'mismatch' END AS check
FROM (SELECT *, (epoch(TIMESTAMP '2024-01-15 12:00:00') - floor(epoch((ts - INTERVAL '7 hours') AT TIME ZONE 'America/New_York'))) / 60.0 AS d FROM events)
""")
def _(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.select("event_id", X.server_to_utc("ts").alias("utc"), X.utc_to_server("ts").alias("server"),
                    X.clock_check("ts", F.to_timestamp(F.lit("2024-01-15 12:00:00"))).alias("check"))


@query("identifiers", """
SELECT event_id, left(event_type, 12) || '#' || left(sha1(event_type || '|' || user_id || '|buy|' || strftime(ts, '%Y-%m-%d %H:%M:%S')), 10) AS client_id,
  event_type || substr('FGHJKMNQUVXZ', CAST(month(ts) AS INTEGER), 1) || CAST(year(ts) % 10 AS VARCHAR) AS code, event_type AS sleeve,
  CASE user_id % 5 WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'transient' ELSE 'terminal' END AS failure
FROM events
""")
def _(spark, sf):
    e = V.table(spark, sf, "events")
    kind, k = F.col("event_type"), F.col("user_id") % 5
    reason = (F.when(k == 0, "Market Closed").when(k == 1, "request timeout").when(k == 2, "Price changed, requote")
              .when(k == 3, "who knows").otherwise(None))
    return e.select("event_id", X.client_id(kind, F.col("user_id").cast("string"), F.lit("buy"),
                                            F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("client_id"),
                    X.contract_code(kind, F.year("ts"), F.month("ts")).alias("code"),
                    X.sleeve_of(F.concat(kind, F.lit("#"), F.col("user_id").cast("string"))).alias("sleeve"),
                    X.classify_failure(reason).alias("failure"))


@query("ml_confidence", """
SELECT event_id, round(CASE WHEN p < 0.55 THEN 0 ELSE least(greatest((p - 0.55) / 0.45, 0), 1) END, 6) AS confidence
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS p FROM events)
""")
def _(spark, sf):
    p = F.get_json_object("props", "$.k").cast("double") / 100
    return rounded(V.table(spark, sf, "events").select("event_id", R.probability_to_confidence(p, 0.55).alias("confidence")))


# -------------------------------------------------------------------- journal

cte("journal", """
SELECT ts, event_id AS seq, CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS runner,
 CASE event_type WHEN 'view' THEN 'heartbeat' WHEN 'click' THEN 'decision' WHEN 'purchase' THEN 'fill' WHEN 'error' THEN 'loop_error' ELSE 'roll' END AS event,
 CASE WHEN event_type = 'view' THEN 100000 + value * 10 END AS equity, CASE WHEN event_type = 'view' THEN k > 90 END AS halted, CASE WHEN event_type = 'view' THEN k END AS feed_age_s,
 CASE WHEN event_type = 'click' THEN k >= 50 END AS approved, CASE WHEN event_type = 'purchase' THEN CASE WHEN k > 20 THEN 'filled' ELSE 'refused' END END AS status,
 CASE WHEN event_type = 'purchase' THEN value / 1000 - 0.02 END AS slippage, CASE WHEN event_type = 'error' THEN 'err ' || user_id END AS error,
 's' || (user_id % 4) AS strategy, 'm' || (user_id % 7) AS symbol, CASE WHEN k % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, CAST(k AS INTEGER) AS k
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
""")


def journal(spark, sf):
    """An operations journal: event kinds, equity, decisions with their breaches, fills."""
    e = V.table(spark, sf, "events")
    kind, k, u = F.col("event_type"), F.get_json_object("props", "$.k").cast("double"), F.col("user_id")
    only = lambda t, c: F.when(kind == t, c)
    breaches = F.when((kind == "click") & (k < 30), F.array(
        F.struct(F.lit("daily_loss").alias("limit")), F.struct(F.concat(F.lit("limit_"), (u % 3).cast("string")).alias("limit"))))
    note = only("click", F.when(k < 40, F.lit("feed: stale")).otherwise(None))
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        F.when(u % 2 == 0, "alpha").otherwise("beta").alias("runner"),
        F.when(kind == "view", "heartbeat").when(kind == "click", "decision").when(kind == "purchase", "fill")
        .when(kind == "error", "loop_error").otherwise("roll").alias("event"),
        only("view", 100000 + F.col("value") * 10).alias("equity"), only("view", k > 90).alias("halted"),
        only("view", k).alias("feed_age_s"), only("click", k >= 50).alias("approved"),
        only("purchase", F.when(k > 20, "filled").otherwise("refused")).alias("status"),
        only("purchase", F.col("value") / 1000 - 0.02).alias("slippage"),
        only("error", F.concat(F.lit("err "), u.cast("string"))).alias("error"), F.lit(None).cast("string").alias("reason"),
        F.concat(F.lit("s"), (u % 4).cast("string")).alias("strategy"), F.concat(F.lit("m"), (u % 7).cast("string")).alias("symbol"),
        F.when(k % 2 == 0, "buy").otherwise("sell").alias("side"), breaches.alias("breaches"), note.alias("note"))


@query("journal_counts", "SELECT runner, event, count(*) AS n FROM journal GROUP BY ALL", ("journal",))
def _(spark, sf):
    return J.counts(journal(spark, sf), ["runner"])


@query("rejections_by_cause", """
WITH d AS (SELECT *, user_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE event_type = 'click'),
c AS (SELECT 'daily_loss' AS cause FROM d WHERE k < 30 UNION ALL SELECT 'limit_' || (user_id % 3) FROM d WHERE k < 30
 UNION ALL SELECT 'feed' FROM d WHERE k >= 30 AND k < 40 UNION ALL SELECT 'unknown' FROM d WHERE k >= 40 AND k < 50)
SELECT cause, count(*) AS n FROM c GROUP BY cause
""")
def _(spark, sf):
    return J.rejections_by_cause(journal(spark, sf).filter(F.col("event") == "decision"))


@query("heartbeat_gaps", """
SELECT runner, before, after, round(epoch(after - before) / 60, 9) AS minutes FROM
(SELECT runner, lag(ts) OVER (PARTITION BY runner ORDER BY ts, seq) AS before, ts AS after FROM journal WHERE event = 'heartbeat') WHERE epoch(after - before) > 7200
""", ("journal",))
def _(spark, sf):
    return rounded(J.heartbeat_gaps(journal(spark, sf).filter(F.col("event") == "heartbeat"), 7200, ["runner"]), 9)


@query("journal_digest", """
WITH w AS (SELECT * FROM journal WHERE ts >= (SELECT max(ts) FROM journal) - INTERVAL '96 hours')
SELECT count(*) AS events, count(*) FILTER (event = 'heartbeat') AS heartbeats, count(*) FILTER (halted) AS halted, min(ts) FILTER (event = 'heartbeat') AS first_beat,
 max(ts) FILTER (event = 'heartbeat') AS last_beat, round(arg_min(equity, ts), 6) AS equity_start, round(arg_max(equity, ts), 6) AS equity_end, round(min(equity), 6) AS equity_min,
 round(max(equity), 6) AS equity_max, max(feed_age_s) AS feed_age_max, count(*) FILTER (event = 'decision') AS decisions, count(*) FILTER (approved) AS approved,
 count(*) FILTER (event = 'fill') AS fill_attempts, count(*) FILTER (status = 'filled') AS filled, median(feed_age_s) AS feed_age_median,
 round(median(abs(slippage)) FILTER (status = 'filled'), 6) AS slippage_median FROM w
""", ("journal",))
def _(spark, sf):
    return rounded(J.digest(J.within(journal(spark, sf), 96)))


@query("approved_top", """
SELECT strategy, symbol, side, count(*) AS n FROM journal WHERE approved GROUP BY ALL ORDER BY n DESC, strategy, symbol, side LIMIT 8
""", ("journal",))
def _(spark, sf):
    return J.approved_by(journal(spark, sf))


@query("last_errors", """
SELECT event, count(*) AS n, last(coalesce(error, '') ORDER BY ts, seq) AS last FROM journal WHERE event IN ('loop_error', 'roll') GROUP BY event
""", ("journal",))
def _(spark, sf):
    return J.last_errors(journal(spark, sf), ["loop_error", "roll", "kill_engaged"])


@query("journal_freshness", """
SELECT runner, max(ts) AS last_beat, count(*) AS heartbeats, round(arg_max(equity, ts), 6) AS equity, arg_max(halted, ts) AS halted,
 round((epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(ts)))) / 60, 6) AS age_minutes, CASE WHEN (epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(ts)))) / 60 <= 30 THEN 'OK' ELSE 'FAIL' END AS status
FROM journal WHERE event = 'heartbeat' GROUP BY runner
""", ("journal",))
def _(spark, sf):
    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    return rounded(J.freshness(journal(spark, sf), now, 30, ["runner"]))


@query("runner_digest", """
WITH g AS (SELECT runner, epoch(ts - lag(ts) OVER (PARTITION BY runner ORDER BY ts, seq)) AS s FROM journal WHERE event = 'heartbeat'),
x AS (SELECT runner, count(*) AS gaps, max(s) / 60 AS longest FROM g WHERE s > 5400 GROUP BY runner)
SELECT runner, count(*) FILTER (event = 'heartbeat') AS heartbeats, count(*) FILTER (halted) AS halted, coalesce(any_value(gaps), 0) AS gaps, round(any_value(longest), 6) AS longest_gap,
  count(*) FILTER (event = 'decision') AS decisions, count(*) FILTER (status = 'filled') AS filled,
  round((arg_max(equity, ts) - arg_min(equity, ts)) / arg_min(equity, ts), 6) AS equity_change FROM journal LEFT JOIN x USING (runner) GROUP BY runner
""", ("journal",))
def _(spark, sf):
    return rounded(J.runner_digest(journal(spark, sf), 30))


# ---------------------------------------------------------------- limit audit

cte("audit_rows", """
WITH pos AS (SELECT c_custkey % 200 AS account, 'b' || (c_nationkey % 5) AS bucket, c_mktsegment AS sleeve, CASE WHEN c_custkey % 41 = 0 THEN 0 ELSE abs(c_acctbal) / 1e6 END AS r, c_custkey % 41 = 0 AS bare FROM customer),
t AS (SELECT account, sum(r) AS total, count(*) AS n, count(*) FILTER (bare) AS bare FROM pos GROUP BY 1), b AS (SELECT account, bucket, sum(r) AS br FROM pos GROUP BY ALL), s AS (SELECT account, sleeve, sum(r) AS sr FROM pos GROUP BY ALL)
SELECT o_orderkey AS id, o_custkey % 200 AS account, 50000 + o_custkey * 100.0 AS day_start, 50000 + o_custkey * 100.0 - o_totalprice / 100 + 2000 AS equity, 62000 + o_custkey * 100.0 AS high, o_totalprice / 500 AS risk_cash,
 o_totalprice / 5e7 AS rf, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 2e7 END AS trf, 1 + o_orderkey % 9 AS margin, o_orderkey % 13 AS feed, o_orderkey % 4 AS existing,
 1 + o_orderkey % 5 AS spread, 2.0 AS med, o_orderkey % 6 AS streak, o_orderkey % 48 AS hours, coalesce(t.total, 0) AS total, coalesce(t.n, 0) AS npos, coalesce(t.bare, 0) AS bare, coalesce(br, 0) AS br, coalesce(sr, 0) AS sr,
 CASE WHEN o_orderkey % 2 = 0 THEN 0.02 END AS cap
FROM (SELECT *, o_custkey % 200 AS account, 'b' || (o_orderkey % 5) AS bucket, CASE o_orderkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END AS sleeve FROM orders) o
LEFT JOIN t USING (account) LEFT JOIN b USING (account, bucket) LEFT JOIN s USING (account, sleeve)
""")


def audit_rows(spark, sf):
    """Snapshots with a proposal each, over positions held by the same accounts."""
    c, o = V.table(spark, sf, "customer"), V.table(spark, sf, "orders")
    ck = F.col("c_custkey")
    pos = c.select((ck % 200).alias("account"), F.concat(F.lit("b"), (F.col("c_nationkey") % 5).cast("string")).alias("bucket"),
                   F.col("c_mktsegment").alias("sleeve"), F.lit(1.0).alias("volume"), F.lit(1e6).alias("equity"),
                   F.lit(0.0).alias("entry_price"), F.when(ck % 41 != 0, F.abs("c_acctbal")).alias("stop_loss"), F.lit(1.0).alias("value_per_unit"))
    ok, cu, px = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    sleeves = F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    start = 50000 + cu * 100.0
    ts = F.col("o_orderdate").cast("timestamp")
    prop = o.select(
        ok.alias("id"), (cu % 200).alias("account"), F.concat(F.lit("b"), (ok % 5).cast("string")).alias("bucket"),
        F.element_at(sleeves, (ok % 5 + 1).cast("int")).alias("sleeve"), start.alias("day_start_equity"),
        (start - px / 100 + 2000).alias("equity"), (62000 + cu * 100.0).alias("high_water_equity"), (62000 + cu * 100.0).alias("starting_equity"),
        (px / 500).alias("risk_cash"), (px / 5e7).alias("risk_fraction"), F.when(ok % 3 == 0, px / 2e7).alias("total_risk_fraction"),
        (1 + ok % 9).cast("double").alias("margin_level"), (ok % 13).cast("double").alias("feed_age_seconds"), (ok % 4).cast("double").alias("existing_volume"),
        (1 + ok % 5).cast("double").alias("current_spread"), F.lit(2.0).alias("median_spread"), (ok % 6).alias("streak"), ts.alias("ts"),
        F.timestamp_micros(F.unix_micros(ts) - (ok % 48) * 3_600_000_000).alias("last_loss_ts"),
        F.when(ok % 2 == 0, 0.02).alias("sleeve_cap"))
    return L.with_open_risk(prop, pos)


_CHECKS = [
    ("daily_loss", "greatest((day_start - equity) / day_start, 0) + risk_cash / day_start >= 0.02",
     "CASE WHEN greatest((day_start - equity) / day_start, 0) >= 0.02 THEN greatest((day_start - equity) / day_start, 0) ELSE greatest((day_start - equity) / day_start, 0) + risk_cash / day_start END",
     "CASE WHEN greatest((day_start - equity) / day_start, 0) >= 0.04 THEN 0.04 ELSE 0.02 END",
     "CASE WHEN greatest((day_start - equity) / day_start, 0) >= 0.04 THEN 'FLATTEN' WHEN greatest((day_start - equity) / day_start, 0) >= 0.02 THEN 'HALT' ELSE 'REJECT' END"),
    ("max_drawdown", "greatest((high - equity) / high, 0) >= 0.1", "greatest((high - equity) / high, 0)",
     "CASE WHEN greatest((high - equity) / high, 0) >= 0.15 THEN 0.15 ELSE 0.1 END", "CASE WHEN greatest((high - equity) / high, 0) >= 0.15 THEN 'FLATTEN' ELSE 'HALT' END"),
    ("margin_level", "margin < 3", "margin", "3", "'REJECT'"), ("feed_heartbeat", "feed > 10", "feed", "10", "'HALT'"),
    ("risk_per_trade", "greatest(rf, coalesce(trf, 0)) > 0.005 + 1e-9", "greatest(rf, coalesce(trf, 0))", "0.005", "'REJECT'"),
    ("correlated_bucket", "br + rf > 0.012 + 1e-9", "br + rf", "0.012", "'REJECT'"),
    ("max_positions", "existing <= 0 AND npos >= 8", "npos", "8", "'REJECT'"), ("spread_guard", "spread / med > 2", "spread / med", "2", "'REJECT'"),
    ("consecutive_losses", "streak >= 4 AND hours < 24", "streak", "4", "'PAUSE'"),
    ("sleeve_budget", "coalesce(sr + rf > cap + 1e-9, false) OR total + rf > 0.04 + 1e-9", "CASE WHEN coalesce(sr + rf > cap + 1e-9, false) THEN sr + rf ELSE total + rf END",
     "CASE WHEN coalesce(sr + rf > cap + 1e-9, false) THEN cap ELSE 0.04 END", "'REJECT'"),
    ("unstopped_position", "bare > 0", "bare", "0", "'HALT'"),
]


@query("limit_audit", "\nUNION ALL\n".join(
    f"SELECT id, account, '{n}' AS \"limit\", {sev} AS severity, round(CAST({obs} AS DOUBLE), 11) AS observed, CAST({th} AS DOUBLE) AS threshold FROM audit_rows WHERE {cond}"
    for n, cond, obs, th, sev in _CHECKS), ("audit_rows",))
def _(spark, sf):
    checks = [L.daily_loss(0.02, 0.04), L.max_drawdown(0.10, 0.15, True), L.margin_level(3.0), L.feed_heartbeat(10.0),
              L.risk_per_trade(0.005), L.correlated_bucket(0.012), L.max_positions(8), L.spread_guard(2.0),
              L.consecutive_losses(4, 24.0), L.sleeve_budget(0.04), L.unstopped_position()]
    return rounded(L.audit(audit_rows(spark, sf), checks, ["id", "account"]), 11)


@query("sharpe_moments", """
SELECT strategy, count(ret) AS n, round(coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0), 6) AS sharpe FROM day_returns GROUP BY strategy
""", ("day_returns",))
def _(spark, sf):
    from tidemark.plans.q_stats import day_returns
    return rounded(T.sharpe_by(day_returns(spark, sf), ["strategy"]))
