"""Positioning, table merges, ingestion, volatility targeting and models."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.functions import scalars as X
from tidemark.operators import bars as B
from tidemark.operators import folds as FO
from tidemark.operators import labels as LB
from tidemark.operators import models as M
from tidemark.operators import overfit as O
from tidemark.operators import portfolio as P
from tidemark.operators import positioning as PO
from tidemark.operators import screen as S
from tidemark.operators import signals as R
from tidemark.operators import trades as T
from tidemark.operators import voltarget as VT
from tidemark.plans.registry import cte, query, rounded
from tidemark.plans.shared_sql import ewm_cte, norm_cdf_sql
from tidemark.session import ensure_checkpoint_dir, materialize
from tidemark.sources import bars as SB
from tidemark.sources import files as SF
from tidemark.sources import snapshots as SN
from tidemark.sources import views as V

# ---------------------------------------------------------------- positioning

cte("cot", """
SELECT n_name AS market, CAST(date_trunc('week', o_orderdate) AS DATE) + 1 AS as_of, sum(o_totalprice) AS oi,
 coalesce(sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 0) AS spec_long, coalesce(sum(o_totalprice) FILTER (o_orderpriority = '2-HIGH'), 0) AS spec_short,
 coalesce(sum(o_totalprice) FILTER (o_orderpriority = '3-MEDIUM'), 0) AS comm_long, coalesce(sum(o_totalprice) FILTER (o_orderpriority = '4-NOT SPECIFIED'), 0) AS comm_short,
 coalesce(sum(o_totalprice) FILTER (o_orderpriority = '5-LOW'), 0) AS small_long, 0.0::DOUBLE AS small_short
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2
""", materialized=True)


def orders_by_nation(spark, sf):
    o, c = V.table(spark, sf, "orders"), V.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"))


def with_nation_name(spark, sf, df, name):
    n = V.table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias(name))
    return df.join(n, F.col("c_nationkey") == F.col("n_nationkey")).drop("c_nationkey", "n_nationkey")


def cot(spark, sf):
    """Weekly positioning per nation: order value by priority class stands for trader class."""
    def of(p):
        return F.coalesce(F.sum(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice"))), F.lit(0.0))
    tuesday = F.date_add(F.date_trunc("week", "o_orderdate").cast("date"), 1)
    g = orders_by_nation(spark, sf).groupBy("c_nationkey", tuesday.alias("as_of")).agg(
        F.sum("o_totalprice").alias("oi"), of("1-URGENT").alias("spec_long"), of("2-HIGH").alias("spec_short"),
        of("3-MEDIUM").alias("comm_long"), of("4-NOT SPECIFIED").alias("comm_short"), of("5-LOW").alias("small_long"),
        F.lit(0.0).alias("small_short"))
    return with_nation_name(spark, sf, g, "market")


cte("cot_features", """
SELECT market, as_of, as_of + INTERVAL '3 days 21 hours' AS available_at, sn / nullif(oi, 0) AS spec_net_pct, cn / nullif(oi, 0) AS comm_net_pct, mn AS small_net,
 CASE WHEN count(*) OVER w >= 26 THEN (sn - min(sn) OVER w) / nullif(max(sn) OVER w - min(sn) OVER w, 0) END AS spec_net_index,
 CASE WHEN count(*) OVER w >= 26 THEN (cn - min(cn) OVER w) / nullif(max(cn) OVER w - min(cn) OVER w, 0) END AS comm_net_index,
 sn - lag(sn, 4) OVER (PARTITION BY market ORDER BY as_of) AS spec_net_chg4
FROM (SELECT *, spec_long - spec_short AS sn, comm_long - comm_short AS cn, small_long - small_short AS mn FROM cot)
WINDOW w AS (PARTITION BY market ORDER BY as_of ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)
""", ("cot",), materialized=True)


@query("cot_features", """
SELECT market, CAST(as_of AS VARCHAR) AS as_of, available_at, round(spec_net_pct, 6) AS spec_net_pct, round(comm_net_pct, 6) AS comm_net_pct, round(spec_net_index, 6) AS spec_net_index,
 round(comm_net_index, 6) AS comm_net_index, round(spec_net_chg4, 2) AS spec_net_chg4 FROM cot_features
""", ("cot_features",))
def _(spark, sf):
    f = PO.features(cot(spark, sf))
    return rounded(f.select("market", "as_of", "available_at", *PO.JOINED), spec_net_chg4=2)


cte("nation_bars", """
SELECT n_name AS symbol, o_orderdate AS ts, min(o_totalprice) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, avg(o_totalprice) AS close, count(*)::DOUBLE AS volume
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2
""", materialized=True)


def nation_bars(spark, sf):
    px = F.col("o_totalprice")
    g = orders_by_nation(spark, sf).groupBy("c_nationkey", F.col("o_orderdate").cast("timestamp").alias("ts")).agg(
        F.min(px).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.avg(px).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"))
    return with_nation_name(spark, sf, g, "symbol")


def positioned_bars(spark, sf):
    f = PO.features(cot(spark, sf)).withColumnRenamed("market", "symbol")
    return PO.join_to_bars(nation_bars(spark, sf), f, ["symbol"])


@query("cot_to_bars", """
SELECT b.symbol, b.ts, CAST(f.as_of AS VARCHAR) AS cot_as_of, round(f.spec_net_pct, 6) AS cot_spec_net_pct, round(f.spec_net_index, 6) AS cot_spec_net_index
FROM nation_bars b ASOF LEFT JOIN cot_features f ON f.market = b.symbol AND b.ts >= f.available_at
""", ("nation_bars", "cot_features"))
def _(spark, sf):
    d = positioned_bars(spark, sf)
    return rounded(d.select("symbol", "ts", "cot_as_of", "cot_spec_net_pct", "cot_spec_net_index"))


@query("positioning_screen")
def _(spark, sf):
    """Four constructions at two horizons per nation; rows only, its scoring is that of the screen."""
    d = S.score(materialize(positioned_bars(spark, sf)), S.POSITIONING, 8 * 25)
    return rounded(d)


@query("select_market", """
WITH n AS (SELECT DISTINCT p_name AS market FROM part), a AS (SELECT * FROM (VALUES ('BOLT', 0, 'BOLT - NONE'), ('BOLT', 1, 'old BOLT'), ('BOLT', 2, 'BOLT'), ('GEAR', 0, 'GEAR'), ('RED', 0, 'red'), ('NIL', 0, 'zzz')) v(code, rank, alias))
SELECT code, arg_min(market, (rank, length(market), market)) AS market FROM n JOIN a ON contains(lower(market), lower(alias)) GROUP BY code
""")
def _(spark, sf):
    p = V.table(spark, sf, "part").select(F.col("p_name").alias("market"))
    return PO.select_market(p, {"BOLT": ["BOLT - NONE", "old BOLT", "BOLT"], "GEAR": ["GEAR"], "RED": ["red"], "NIL": ["zzz"]})


@query("lagged_cross_asset", """
WITH d AS (SELECT symbol, ts, close FROM nation_bars), o AS (SELECT CAST(ts AS DATE) AS day, lag(r) OVER (ORDER BY ts) AS lagged FROM
 (SELECT ts, close / lag(close) OVER (ORDER BY ts) - 1 AS r FROM d WHERE symbol = 'NATION_1'))
SELECT symbol, ts, round(lagged, 6) AS lagged FROM d LEFT JOIN o ON o.day = CAST(ts AS DATE) WHERE symbol <> 'NATION_1'
""", ("nation_bars",))
def _(spark, sf):
    b = nation_bars(spark, sf)
    d = PO.lagged_cross_asset(b.filter(F.col("symbol") != "NATION_1"), b.filter(F.col("symbol") == "NATION_1"), "lagged")
    return rounded(d.select("symbol", "ts", "lagged"))


@query("clean_cot", """
SELECT trim(p_name) AS market, CAST(make_date(2020, CAST(1 + p_size % 12 AS INTEGER), 3) AS VARCHAR) AS as_of, count(*) AS n, count(CASE WHEN p_partkey % 5 > 0 THEN 1 END) AS readable FROM part WHERE p_partkey % 7 <> 0 GROUP BY 1, 2
""")
def _(spark, sf):
    """Report rows as text, some dates and numbers unreadable."""
    key, size = F.col("p_partkey"), F.col("p_size")
    day = F.when(key % 7 == 0, "n/a").otherwise(F.format_string("2020-%02d-03", (size % 12 + 1).cast("int")))
    num = F.when(key % 5 == 0, F.lit(".")).otherwise(F.concat(F.lit(" "), size.cast("string"), F.lit(" ")))
    raw = V.table(spark, sf, "part").select(F.concat(F.lit(" "), "p_name").alias("market"), day.alias("as_of"),
                                            *[num.alias(c) for c in SF.COT_NUMBERS])
    return SF.clean_cot(raw).groupBy("market", "as_of").agg(F.count(F.lit(1)).alias("n"), F.count("oi").alias("readable"))


# --------------------------------------------------------- merges and ingestion

@query("upsert_keep_last", """
SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY p DESC) AS k FROM
 (SELECT symbol, ts, close, 0 AS p FROM bars_h1 UNION ALL SELECT symbol, ts, close * 2, 1 FROM bars_h1 WHERE hour(ts) < 6 UNION ALL SELECT symbol, ts + INTERVAL '60 days', close, 1 FROM bars_h1 WHERE hour(ts) = 3)) WHERE k = 1
""", ("bars_h1",))
def _(spark, sf):
    b = V.bars(spark, sf).select("symbol", "ts", "close")
    fixed = b.filter(F.hour("ts") < 6).withColumn("close", F.col("close") * 2)
    later = b.filter(F.hour("ts") == 3).withColumn("ts", F.col("ts") + F.expr("INTERVAL 60 DAYS"))
    return SN.merge(b, fixed.unionByName(later), ["symbol", "ts"])


@query("store_roundtrip", """
SELECT symbol, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM bars_h4 WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY symbol
""", ("bars_h4",))
def _(spark, sf):
    """Written to the partitioned bar table and read back over a range."""
    from datetime import datetime
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}"
    SB.upsert_bars(spark, path, V.bars(spark, sf, "4 hours"), "H4", allow_nonpositive=True)
    d = SB.read_bars(spark, path, None, "H4", datetime(2024, 1, 10), datetime(2024, 1, 20, 12))
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("resume_points", """
SELECT symbol, max(ts) AS last_ts FROM bars_h4 GROUP BY symbol
""", ("bars_h4",))
def _(spark, sf):
    """Where a download of each symbol goes on, asked of the bar table."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}"
    bars = materialize(V.bars(spark, sf, "4 hours"))
    SB.upsert_bars(spark, path, bars.filter("ts < '2024-01-12'"), "H4", allow_nonpositive=True)
    SB.upsert_bars(spark, path, bars.filter("ts >= '2024-01-08'"), "H4", allow_nonpositive=True)
    return SB.last_timestamps(spark, path, "H4")


@query("cot_store", """
SELECT CASE WHEN market < 'J' THEN 'A-I' ELSE 'J-Z' END AS code, CAST(as_of AS VARCHAR) AS as_of, count(*) AS reports, round(sum(CASE WHEN market < 'J' AND month(as_of) = 6 THEN 2 ELSE 1 END * oi), 2) AS oi
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market < 'J', as_of ORDER BY market) AS k FROM cot) WHERE k = 1) GROUP BY ALL
""", ("cot",))
def _(spark, sf):
    """Reports of two groups of markets merged by date; a corrected copy of the Junes of one wins."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/cot-{uuid.uuid4().hex}"
    code = F.when(F.col("market") < "J", "A-I").otherwise("J-Z")
    first = cot(spark, sf).withColumn("code", code).groupBy("code", "as_of").agg(F.min_by(F.struct("market", *SF.COT_NUMBERS), "market").alias("r"))
    d = materialize(first.select("code", "as_of", "r.*"))
    for c in ("A-I", "J-Z"):
        SF.upsert_cot(spark, path, c, d.filter(F.col("code") == c))
    june = d.filter((F.col("code") == "A-I") & (F.month("as_of") == 6)).withColumn("oi", 2 * F.col("oi"))
    SF.upsert_cot(spark, path, "A-I", june)
    return rounded(SF.read_cot(spark, path).groupBy("code", F.col("as_of").cast("string").alias("as_of")).agg(
        F.count(F.lit(1)).alias("reports"), F.sum("oi").alias("oi")), 2)


@query("ingest_prints", """
SELECT contract, count(*) AS prints, count(*) FILTER (k >= 80) AS dropped, round(count(*) FILTER (k >= 80) / count(*), 6) AS dropped_share FROM
(SELECT event_type AS contract, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY contract
""")
def _(spark, sf):
    k = F.get_json_object("props", "$.k").cast("double")
    raw = V.table(spark, sf, "events").select(F.col("event_type").alias("contract"), F.col("value").alias("price"),
                                              F.when(k < 40, "A").when(k < 80, "B").otherwise("N").alias("aggressor"))
    return rounded(SF.ingest_prints(raw)[1])


@query("month_windows", """
WITH s AS (SELECT o_custkey AS id, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1),
m AS (SELECT id, a, b, CAST(unnest(generate_series(date_trunc('month', a), b, INTERVAL 1 MONTH)) AS DATE) AS m FROM s)
SELECT id, CAST(greatest(a, m) AS VARCHAR) AS from_day, CAST(least(b, last_day(m)) AS VARCHAR) AS to_day FROM m
""")
def _(spark, sf):
    s = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))
    return SF.month_windows(s).select("id", "from_day", "to_day")


@query("month_end_panel", "SELECT symbol, CAST(date_trunc('month', ts) AS DATE)::VARCHAR AS month, round(arg_max(close, ts), 6) AS level FROM nation_bars GROUP BY ALL", ("nation_bars",))
def _(spark, sf):
    return rounded(P.month_end_panel(nation_bars(spark, sf)))


@query("members", """
SELECT symbol, count(*) AS trades, symbol IN (SELECT symbol FROM trades GROUP BY symbol HAVING sum(net_pnl) > 0) AS researched FROM trades WHERE symbol IN (SELECT p_brand FROM part WHERE p_size > 49) GROUP BY symbol
""", ("trades",))
def _(spark, sf):
    t = T.derived(V.trades(spark, sf))
    universe = V.table(spark, sf, "part").filter(F.col("p_size") > 49).select(F.col("p_brand").alias("symbol")).distinct()
    g = t.join(universe, "symbol", "left_semi").groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"), F.sum("net_pnl").alias("p"))
    return g.select("symbol", "trades", (F.col("p") > 0).alias("researched"))


@query("measured_costs", """
SELECT symbol, round(m * 0.01, 6) AS spread, round(m * 0.01 / 2, 6) AS slippage, 2.0::DOUBLE AS spread_multiple_at_open FROM (SELECT p_brand AS symbol, floor(avg(p_size)) AS m FROM part GROUP BY 1)
""")
def _(spark, sf):
    s = V.table(spark, sf, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.floor(F.avg("p_size")).cast("double").alias("spread_pts"))
    s = s.withColumn("point", F.lit(0.01))
    return rounded(SF.measured_costs(s, s.select("symbol")))


# --------------------------------------------------------- volatility targeting

cte("brand_days", """
SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS day, avg(l_extendedprice / l_quantity / 0.97::DOUBLE) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
""", materialized=True)
cte("cash", """
SELECT symbol, day, (close - lag(close) OVER (PARTITION BY symbol ORDER BY day)) * vpu AS cash FROM brand_days JOIN (SELECT symbol, tick_value / tick_size AS vpu FROM specs) USING (symbol)
""", ("brand_days", "specs"), materialized=True)


def brand_days(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    p = V.table(spark, sf, "part").select("p_partkey", "p_brand")
    return (li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("day"))
            .agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity") / 0.97).alias("close")))


def cash(spark, sf, days=None):
    d = (brand_days(spark, sf) if days is None else days).withColumnRenamed("day", "ts")
    return X.cash_changes(d, V.specs(spark, sf)).withColumnRenamed("ts", "day")


@query("cash_changes", "SELECT symbol, CAST(day AS VARCHAR) AS day, round(cash, 4) AS cash FROM cash", ("cash",))
def _(spark, sf):
    return rounded(cash(spark, sf), 4)


cte("decisions", """
SELECT min(day) AS decision_day FROM brand_days GROUP BY date_trunc('month', day)
""", ("brand_days",), materialized=True)


def decisions(days):
    """First traded day of every month."""
    return days.groupBy(F.trunc("day", "MM").alias("m")).agg(F.min("day").alias("decision_day")).select("decision_day")


cte("recent", """
WITH c AS (SELECT day, row_number() OVER (ORDER BY day) AS r FROM (SELECT DISTINCT day FROM cash)), k AS (SELECT decision_day, r AS l FROM decisions JOIN c ON day = decision_day)
SELECT k.decision_day, c.day, count(*) OVER (PARTITION BY k.decision_day) AS n_days FROM k JOIN c ON c.r BETWEEN greatest(k.l - 125, 1) AND k.l
""", ("cash", "decisions"), materialized=True)
cte("filled", """
SELECT r.decision_day, r.day, s.symbol, coalesce(c.cash, 0) AS x, c.cash IS NOT NULL AS seen FROM recent r CROSS JOIN (SELECT DISTINCT symbol FROM cash) s LEFT JOIN cash c ON c.day = r.day AND c.symbol = s.symbol
""", ("recent", "cash"), materialized=True)


@query("shrunk_correlation", """
SELECT CAST(a.decision_day AS VARCHAR) AS decision_day, a.symbol AS a, b.symbol AS b, round(0.5 * coalesce(corr(a.x, b.x), 0), 6) + 0.0 AS rho FROM filled a JOIN filled b ON b.decision_day = a.decision_day AND b.day = a.day AND b.symbol > a.symbol
WHERE EXISTS (SELECT 1 FROM cash c WHERE c.day = a.day AND c.cash IS NOT NULL) GROUP BY ALL
""", ("filled", "cash"))
def _(spark, sf):
    days = materialize(brand_days(spark, sf))
    return rounded(VT.shrunk_correlation(VT.recent_changes(cash(spark, sf, days), decisions(days), 126)))


cte("legs", """
SELECT d.decision_day, s.symbol || '-' || d.decision_day AS leg, s.symbol, CASE WHEN code % 3 = 0 THEN -1 ELSE 1 END AS side, 40.0 + code AS stop_distance, tick_value / tick_size AS vpu,
 CASE WHEN code % 4 = 0 THEN 2.0 END AS held, 1e7::DOUBLE AS equity FROM decisions d JOIN (SELECT DISTINCT symbol, date_trunc('month', day) AS m FROM brand_days) t ON t.m = date_trunc('month', d.decision_day) JOIN (SELECT *, swap_mode AS code FROM specs) s ON s.symbol = t.symbol
""", ("decisions", "specs", "brand_days"))


def legs(spark, sf, days):
    """Every market that trades in a decision month is wanted then, some already held."""
    code, month = F.col("swap_mode"), F.trunc("decision_day", "MM").alias("m")
    active = days.select("symbol", F.trunc("day", "MM").alias("m")).distinct()
    grid = active.join(decisions(days).select("decision_day", month), "m").join(V.specs(spark, sf), "symbol")
    return grid.select("decision_day", F.concat("symbol", F.lit("-"), F.col("decision_day").cast("string")).alias("leg"), "symbol",
                       F.when(code % 3 == 0, -1).otherwise(1).alias("side"), (code + 40.0).alias("stop_distance"),
                       X.value_per_unit().alias("value_per_unit"), F.when(code % 4 == 0, 2.0).alias("held_contracts"), F.lit(1e7).alias("equity"))


@query("vol_target", """
WITH m AS (SELECT decision_day, symbol, CASE WHEN bool_or(seen) THEN stddev_samp(x) END AS sigma, count(*) FILTER (seen) AS history FROM filled GROUP BY ALL),
l AS (SELECT g.*, m.sigma, coalesce(m.history, 0) >= 63 AS ready FROM legs g LEFT JOIN m USING (decision_day, symbol)),
r0 AS (SELECT a.decision_day, a.symbol AS s1, b.symbol AS s2, corr(a.x, b.x) AS rr FROM filled a JOIN filled b ON b.decision_day = a.decision_day AND b.day = a.day GROUP BY ALL),
r AS (SELECT decision_day, s1, s2, CASE WHEN s1 = s2 THEN 1.0 ELSE 0.5 * coalesce(rr, 0) END AS rho FROM r0),
w AS (SELECT decision_day, symbol, CASE WHEN held IS NULL THEN side ELSE 0 END AS s, CASE WHEN held IS NOT NULL THEN side * held * sigma ELSE 0 END AS x FROM l WHERE ready),
q AS (SELECT r.decision_day, sum(u.s * v.s * rho) AS a, 2 * sum(u.s * v.x * rho) AS b, sum(u.x * v.x * rho) AS d FROM r JOIN w u ON u.decision_day = r.decision_day AND u.symbol = r.s1 JOIN w v ON v.decision_day = r.decision_day AND v.symbol = r.s2 GROUP BY 1),
c AS (SELECT l.*, CASE WHEN a > 0 AND b * b - 4 * a * (d - t) >= 0 THEN greatest((-b + sqrt(b * b - 4 * a * (d - t))) / (2 * a), 0) ELSE 0 END AS c FROM (SELECT *, pow(0.12 * equity / sqrt(252), 2) AS t FROM l) l LEFT JOIN q USING (decision_day) WHERE held IS NULL),
n AS (SELECT *, CASE WHEN ready AND c > 0 AND sigma > 0 THEN c / sigma ELSE 0 END AS n FROM c)
SELECT CAST(decision_day AS VARCHAR) AS decision_day, symbol, side, round(sigma, 6) AS sigma, round(c, 4) AS c, round(CASE WHEN n * stop_distance * vpu / equity > 0.01 THEN 0.01 * equity / (stop_distance * vpu) ELSE n END, 6) AS contracts,
 round(CASE WHEN ready THEN least(n * stop_distance * vpu / equity, 0.01) END, 6) AS risk_fraction, CASE WHEN NOT ready THEN 'default' WHEN n = 0 THEN 'at target' WHEN n * stop_distance * vpu / equity > 0.01 THEN 'capped' ELSE 'sized' END AS note FROM n
""", ("filled", "legs"))
def _(spark, sf):
    days = materialize(brand_days(spark, sf))
    return rounded(VT.allocate(legs(spark, sf, days), materialize(cash(spark, sf, days))).drop("leg"), c=4)


@query("realised_vol", """
SELECT sleeve, round(stddev_samp(ret) * sqrt(252), 9) AS vol FROM eq_ret GROUP BY sleeve
""", ("eq_ret",))
def _(spark, sf):
    r = T.equity_returns(T.daily_equity(T.derived(V.trades(spark, sf)), ["sleeve"], 1e9), ["sleeve"])
    return rounded(r.groupBy("sleeve").agg((F.stddev_samp("ret") * 252 ** 0.5).alias("vol")), 9)


cte("sleeve_mom", """
SELECT sleeve, n, sr, 1 - m3 / pow(sd, 3) * sr + (m4 / pow(sd, 4) - 1) / 4 * sr * sr AS v FROM (SELECT sleeve, count(ret) AS n, avg(ret) / stddev_samp(ret) AS sr, stddev_samp(ret) AS sd, avg(pow(ret - mu, 3)) AS m3, avg(pow(ret - mu, 4)) AS m4
 FROM (SELECT *, avg(ret) OVER (PARTITION BY sleeve) AS mu FROM eq_ret WHERE ret IS NOT NULL) GROUP BY sleeve)
""", ("eq_ret",))


@query("book_summary", f"""
WITH y AS (SELECT sleeve, year(ts) AS y, arg_max(equity, ts) - arg_min(equity, ts) AS p FROM equity GROUP BY ALL HAVING count(*) >= 200),
g AS (SELECT sleeve, count(*) FILTER (p > 0) AS positive_years, count(*) AS n_years FROM y GROUP BY sleeve),
f AS (SELECT sleeve, sum(costs) / abs(sum(gross_pnl)) AS friction_share, count(*) AS trades FROM trades GROUP BY sleeve)
SELECT sleeve, round(sr * sqrt(252), 6) AS net_sharpe, round({norm_cdf_sql('(sr * sqrt(n - 1) / sqrt(v))')}, 6) + 0.0 AS psr, round(max_drawdown, 9) AS max_drawdown, round(friction_share, 6) AS friction_share, trades, positive_years, n_years
FROM sleeve_mom JOIN dd USING (sleeve) JOIN f USING (sleeve) JOIN g USING (sleeve)
""", ("sleeve_mom", "dd", "trades", "equity"))
def _(spark, sf):
    t = T.derived(V.trades(spark, sf))
    eq = materialize(T.daily_equity(t, ["sleeve"], 1e9))
    m = O.probabilistic_sharpe(O.return_moments(T.equity_returns(eq, ["sleeve"]), ["sleeve"]))
    years = T.yearly_pnl(eq, ["sleeve"]).groupBy("sleeve").agg(
        F.sum(F.when(F.col("pnl") > 0, 1).otherwise(0)).alias("positive_years"), F.count(F.lit(1)).alias("n_years"))
    f = t.groupBy("sleeve").agg((F.sum("costs") / F.abs(F.sum("gross_pnl"))).alias("friction_share"), F.count(F.lit(1)).alias("trades"))
    d = m.join(T.drawdown(eq, ["sleeve"]), "sleeve").join(f, "sleeve").join(years, "sleeve")
    return rounded(d.select("sleeve", (F.col("sharpe") * 252 ** 0.5).alias("net_sharpe"), "psr", "max_drawdown", "friction_share",
                            "trades", "positive_years", "n_years"), max_drawdown=9)


# ---------------------------------------------------------------------- models

@query("regime_gmm")
def _(spark, sf):
    """Regimes of hourly bars; rows only, a fitted mixture."""
    f = materialize(I.regime_features(V.bars(spark, sf), rank=100).select("symbol", "ts", *I.REGIME_COLUMNS))
    d = M.fit_regimes(f).predict(f)
    return rounded(d.groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n"), F.avg(M.regime_scalar(F.col("regime"))).alias("scalar")))


def meta_dataset(spark, sf, lookback: int = 60):
    """Events of the trend rule with features, labels, weights, pooled over markets in time order."""
    bars = V.stored_bars(spark, sf)
    rule = R.trend(bars, lookback, 50, rank=100)
    feats = I.meta_features(bars, rank=100).select("symbol", "ts", *I.META_COLUMNS)
    ev = R.signal_events(rule, warmup=130).select("symbol", "i", "ts", "side", "stop_distance", F.col("forecast").alias("base_forecast"))
    lab = materialize(LB.triple_barrier(ev, LB.index_bars(bars), 2.0, 20, event_keys=("ts", "base_forecast")))
    t = F.unix_timestamp("ts") / 3600
    d = (LB.sample_weights(lab).join(feats, ["symbol", "ts"])
         .withColumn("t0", t.cast("long")).withColumn("t1", (t + F.col("t1") - F.col("entry_i") + 1).cast("long"))
         .withColumn("lookback", F.lit(float(lookback))))
    return d.dropna(subset=[*I.META_COLUMNS, "base_forecast"])


FEATURES = [*I.META_COLUMNS, "base_forecast", "lookback"]


@query("collect_events")
def _(spark, sf):
    """The pooled training table; rows only, its columns are checked one by one elsewhere."""
    d = meta_dataset(spark, sf).select("symbol", "ts", "side", "ret", "label", "weight", *FEATURES)
    return rounded(d)


@query("meta_gbt")
def _(spark, sf):
    """Calibrated trees on purged folds, scored out of fold; rows only, a fitted model."""
    d = materialize(meta_dataset(spark, sf))
    folds = materialize(FO.purged_kfold(d, [], ["t0", "symbol"], 3, 0.01))
    model = M.fit_meta(folds, FEATURES, weight="weight", max_iter=20)
    return rounded(M.evaluate(M.out_of_fold(folds, model)))


@query("ml_filter", """
SELECT symbol, ts, side, round(conf * conv, 6) AS ml_confidence FROM (SELECT symbol, ts, side, p, greatest(least(abs(forecast) / 2, 1), 0.25) AS conf, least(greatest((p - 0.5) / 0.5, 0), 1) AS conv
 FROM (SELECT *, (rn * 37 % 101) / 100.0 AS p FROM trend_events)) WHERE conv > 0 AND conf * conv > 0.05
""", ("trend_events",))
def _(spark, sf):
    from tidemark.plans.q_screen import trend_rule
    ev = R.signal_events(trend_rule(spark, sf), warmup=65)
    ev = ev.withColumn("p", ((F.col("i") + 1) * 37 % 101) / 100.0).withColumn("confidence", R.to_confidence(F.col("forecast")))
    return rounded(R.filter_by_model(ev, "p").select("symbol", "ts", "side", "ml_confidence"))


@query("pooled_order", """
SELECT row_number() OVER (ORDER BY ts, symbol, rn) AS position, symbol, ts FROM trend_events
""", ("trend_events",))
def _(spark, sf):
    from tidemark.plans.q_screen import trend_rule
    ev = R.signal_events(trend_rule(spark, sf), warmup=65).select("symbol", "ts", "i")
    return FO.positions(ev, [], ["ts", "symbol", "i"]).select(F.col("pos").alias("position"), "symbol", "ts")


@query("carry_rule", f"""
WITH r AS (SELECT symbol, month, rn, level, carry FROM (SELECT symbol, month, level, row_number() OVER (PARTITION BY symbol ORDER BY month) AS rn, CASE WHEN lag(level) OVER (PARTITION BY symbol ORDER BY month) > 0 THEN (lag(level) OVER (PARTITION BY symbol ORDER BY month) - level) / level END AS carry FROM panel)),
k AS (SELECT *, rn - 1 AS k FROM r WHERE carry IS NOT NULL), e AS (SELECT symbol, k, carry AS y FROM k WHERE k = 1 UNION ALL SELECT k.symbol, k.k, (1 - 2.0 / 6) * e.y + 2.0 / 6 * k.carry FROM e JOIN k ON k.symbol = e.symbol AND k.k = e.k + 1)
SELECT r.symbol, CAST(r.month AS VARCHAR) AS month, round(CASE WHEN e.k >= 5 THEN e.y END / nullif(CASE WHEN count(r.carry) OVER w >= 6 THEN stddev_samp(r.carry) OVER w END, 0), 6) AS forecast
FROM r LEFT JOIN e ON e.symbol = r.symbol AND e.k = r.rn - 1 WINDOW w AS (PARTITION BY r.symbol ORDER BY r.month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)
""", ("panel",))
def _(spark, sf):
    w = Window.partitionBy("symbol").orderBy("ts")
    p = V.panel(spark, sf).withColumnRenamed("month", "ts")
    prev = F.lag("level").over(w)
    d = p.withColumn("carry", F.when(prev > 0, (prev - F.col("level")) / F.col("level")))
    return rounded(R.carry_forecast(d, smooth=5, norm=12).select("symbol", F.col("ts").alias("month"), "forecast"))


cte("nation_rows", """
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) IS NULL AS is_last,
 coalesce(date_trunc('month', lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) <> date_trunc('month', ts), true) AS month_start,
 greatest(high - low, abs(high - lag(close) OVER (PARTITION BY symbol ORDER BY ts)), abs(low - lag(close) OVER (PARTITION BY symbol ORDER BY ts))) AS tr FROM nation_bars
""", ("nation_bars",), materialized=True)
ewm_cte("nation_atr", "nation_rows", "tr", "(1.0::DOUBLE / 14)")


@query("seasonality_rule", """
WITH m AS (SELECT symbol, year(ts) AS y, month(ts) AS mo, (arg_max(close, ts) - arg_min(close, ts)) / nullif(abs(arg_min(close, ts)), 0) AS ret FROM nation_bars GROUP BY ALL),
p AS (SELECT symbol, y, mo, CASE WHEN count(ret) OVER w >= 2 THEN avg(ret) OVER w END AS prior_mean FROM m WINDOW w AS (PARTITION BY symbol, mo ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT r.symbol, r.ts, CAST(sign(prior_mean) AS INTEGER) AS side, round(prior_mean, 6) AS prior_mean, round(a.y * 4, 4) AS stop_distance
FROM nation_rows r JOIN nation_atr a ON a.symbol = r.symbol AND a.rn = r.rn JOIN p ON p.symbol = r.symbol AND p.y = year(r.ts) AND p.mo = month(r.ts)
WHERE r.rn >= 14 AND a.y > 0 AND month_start AND prior_mean <> 0 AND r.rn - 1 >= 100 AND NOT is_last
""", ("nation_rows", "nation_atr", "nation_bars"))
def _(spark, sf):
    """Month-start entries by the sign of the same month in earlier years."""
    ev = R.signal_events(R.seasonality(nation_bars(spark, sf), min_years=2), warmup=100)
    return rounded(ev.select("symbol", "ts", "side", "prior_mean", "stop_distance"), stop_distance=4)


@query("buy_and_hold", """
SELECT symbol, ts, 1 AS side, round(atr * 10, 6) AS stop_distance FROM atr_h1 a WHERE atr > 0 AND rn - 1 >= 16 AND ts < (SELECT max(ts) FROM bars_h1 b WHERE b.symbol = a.symbol)
""", ("atr_h1", "bars_h1"))
def _(spark, sf):
    return rounded(R.signal_events(R.buy_and_hold(V.bars(spark, sf))).select("symbol", "ts", "side", "stop_distance"))


@query("union_resampled", """
SELECT 'H4' AS timeframe, symbol, count(*) AS bars, sum(volume) AS volume FROM bars_h4 GROUP BY symbol UNION ALL SELECT 'D1', symbol, count(*), sum(volume) FROM bars_d1 GROUP BY symbol
""", ("bars_h4", "bars_d1"))
def _(spark, sf):
    h1 = V.bars(spark, sf)
    both = [B.resample(h1, f).withColumn("timeframe", F.lit(t)) for t, f in (("H4", "4 hours"), ("D1", "1 day"))]
    return both[0].unionByName(both[1]).groupBy("timeframe", "symbol").agg(F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume"))
