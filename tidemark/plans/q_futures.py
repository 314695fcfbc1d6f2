"""Contract calendars, continuous series and roll costs."""

import uuid
from datetime import date, timedelta

from pyspark.sql import functions as F

from tidemark.operators import futures as FU
from tidemark.operators import trades as T
from tidemark.plans.registry import cte, query, rounded
from tidemark.session import ensure_checkpoint_dir, materialize
from tidemark.sources import files as SF
from tidemark.sources import views as V

LO, HI, FAR = "(SELECT lo FROM span)", "(SELECT hi FROM span)", "(SELECT far FROM span)"
#: Days beyond the last deal for which windows are kept, so that deals in the following contract find it.
AHEAD = 200
UNIVERSE = ["CL", "ES", "GC", "ZN", "ZC", "6E", "HE", "BZ"]

cte("roots", "SELECT * FROM (VALUES " + ", ".join(
    f"('{r}', {m}::DOUBLE, {t}::DOUBLE, {mo}, '{ru}', {rd}, {c}::DOUBLE, '{s}', {'NULL' if n is None else repr(n)}, {i})"
    for i, (r, m, t, mo, ru, rd, c, s, n) in enumerate(FU.ROOTS))
    + ") v(root, multiplier, tick_size, months, rule, roll_days, commission, sector, notice, ord)")
cte("span", f"""
SELECT least((SELECT CAST(min(l_shipdate) AS DATE) FROM lineitem), (SELECT CAST(min(o_orderdate) AS DATE) FROM orders)) AS lo,
 CAST(max(l_shipdate) AS DATE) AS hi, CAST(max(l_shipdate) AS DATE) + {AHEAD} AS far FROM lineitem
""", materialized=True)
cte("cal", f"""
SELECT d, bd, CAST(sum(bd) OVER (ORDER BY d) AS BIGINT) AS rk FROM (SELECT CAST(x AS DATE) AS d, CASE WHEN isodow(x) < 6 THEN 1 ELSE 0 END AS bd
 FROM (SELECT unnest(generate_series(CAST({LO} AS TIMESTAMP) - INTERVAL 3 YEAR, CAST({FAR} AS TIMESTAMP) + INTERVAL 4 YEAR, INTERVAL 1 DAY)) AS x))
""", ("span",), materialized=True)
cte("bdays", "SELECT d AS bday, rk FROM cal WHERE bd = 1", ("cal",), materialized=True)


def _nth(f, wd, n):
    return f"CAST({f} + ((({wd} - (isodow({f}) - 1)) % 7 + 7) % 7 + 7 * {n - 1}) * INTERVAL 1 DAY AS DATE)"


def _last(f, wd):
    return f"CAST(last_day({f}) - (((isodow(last_day({f})) - 1 - {wd}) % 7 + 7) % 7) * INTERVAL 1 DAY AS DATE)"


_P1, _P2, _N3 = "CAST(f - INTERVAL 1 MONTH AS DATE)", "CAST(f - INTERVAL 2 MONTH AS DATE)", "CAST(f + INTERVAL 3 MONTH AS DATE)"
cte("contracts0", f"""
SELECT root, yr AS year, mo AS month, f, rule, notice, roll_days, CASE rule WHEN 'third_friday' THEN {_nth('f', 4, 3)} WHEN 'fx' THEN {_nth('f', 2, 3)} WHEN 'crude' THEN {_P1} + 24
 WHEN 'natgas' THEN last_day({_P1}) WHEN 'refined' THEN last_day({_P1}) WHEN 'brent' THEN last_day({_P2}) WHEN 'grains' THEN f + 14 WHEN 'lean_hogs' THEN f - 1
 WHEN 'feeder' THEN {_last('f', 3)} WHEN 'last_friday' THEN {_last('f', 4)} WHEN 'nikkei' THEN {_nth('f', 4, 2)} WHEN 'sofr3' THEN {_nth(_N3, 2, 3)} ELSE last_day(f) END AS base,
 CASE rule WHEN 'metals' THEN -2 WHEN 'fx' THEN -2 WHEN 'crude' THEN -3 WHEN 'natgas' THEN -2 WHEN 'treasury' THEN -7 WHEN 'lean_hogs' THEN 10 WHEN 'nikkei' THEN -1 WHEN 'sofr3' THEN -1
  WHEN 'grains' THEN CASE WHEN isodow(f + 14) >= 6 THEN 0 ELSE -1 END ELSE 0 END AS off, rule IN ('third_friday', 'feeder', 'last_friday') AS exact
FROM (SELECT *, make_date(yr, mo, 1) AS f FROM (SELECT root, rule, notice, roll_days, unnest(months) AS mo FROM roots), (SELECT CAST(unnest(range(CAST(year({LO}) AS BIGINT) - 1, CAST(year({FAR}) AS BIGINT) + 2)) AS INTEGER) AS yr))
""", ("roots", "span"))
cte("contracts", f"""
SELECT root, year, month, last_trade, first_notice, least(last_trade, first_notice) AS anchor, r.bday AS roll_on,
 root || substr('FGHJKMNQUVXZ', month, 1) || CAST(year % 10 AS VARCHAR) AS contract
FROM (SELECT c.*, CASE WHEN exact THEN base ELSE b.bday END AS last_trade, CASE WHEN notice IS NOT NULL THEN n.bday END AS first_notice FROM contracts0 c
 JOIN cal k ON k.d = c.base JOIN bdays b ON b.rk = k.rk + c.off JOIN cal kn ON kn.d = last_day({_P1}) JOIN bdays n ON n.rk = kn.rk) x
JOIN cal a ON a.d = least(last_trade, first_notice) JOIN bdays r ON r.rk = a.rk - roll_days
WHERE last_trade BETWEEN {LO} - 400 AND {FAR} + 400
""", ("contracts0", "cal", "bdays", "span"), materialized=True)
cte("windows", f"""
SELECT *, row_number() OVER (PARTITION BY root ORDER BY year, month) AS window_no FROM (SELECT *, coalesce(prev, {LO}) AS active_from FROM
 (SELECT *, lag(roll_on) OVER (PARTITION BY root ORDER BY year, month) AS prev FROM contracts) WHERE roll_on >= {LO} AND (prev IS NULL OR prev <= {FAR}))
""", ("contracts", "span"), materialized=True)


def span(spark, sf):
    """First and last day of any deal or trade, and the day up to which windows are kept."""
    ship = V.table(spark, sf, "lineitem").agg(F.to_date(F.min("l_shipdate")), F.to_date(F.max("l_shipdate"))).first()
    entry = V.table(spark, sf, "orders").agg(F.to_date(F.min("o_orderdate"))).first()[0]
    return str(min(ship[0], entry)), str(ship[1]), str(ship[1] + timedelta(days=AHEAD))


def calendar(spark, sf):
    lo, _, far = span(spark, sf)
    return FU.contract_calendar(FU.roots(spark), lo, far)


def windows(spark, sf):
    lo, _, far = span(spark, sf)
    return materialize(FU.active_windows(FU.contract_calendar(FU.roots(spark), lo, far), lo, far))


cte("shipments", """
SELECT (['CL', 'ES', 'GC', 'ZN', 'ZC', '6E', 'HE', 'BZ'])[1 + CAST(l_partkey % 8 AS INTEGER)] AS root, CAST(l_shipdate AS DATE) AS day, l_linenumber % 2 AS far,
 100 + l_extendedprice / l_quantity / 97 + (l_linenumber % 2) * 0.5 AS px, l_quantity AS qty FROM lineitem
""")


def shipments(spark, sf):
    """Every line item as a deal in one of eight families, in the front or the following contract."""
    li = V.table(spark, sf, "lineitem")
    fam = F.element_at(F.array(*[F.lit(r) for r in UNIVERSE]), (F.col("l_partkey") % 8 + 1).cast("int"))
    far = F.col("l_linenumber") % 2
    return li.select(fam.alias("root"), F.to_date("l_shipdate").alias("day"), far.alias("far"),
                     (100 + F.col("l_extendedprice") / F.col("l_quantity") / 97 + far * 0.5).alias("px"), F.col("l_quantity").alias("qty"))


cte("contract_bars", """
SELECT s.root, t.year, t.month, s.day AS ts, min(px) AS open, max(px) AS high, min(px) AS low, avg(px) AS close, sum(qty) AS volume
FROM shipments s JOIN windows w ON w.root = s.root AND s.day >= w.active_from AND s.day < w.roll_on
JOIN windows t ON t.root = w.root AND t.window_no = w.window_no + s.far GROUP BY ALL
""", ("shipments", "windows"), materialized=True)


def contract_bars(spark, sf):
    """Daily bars per contract month: deals placed by the day's front contract."""
    w = windows(spark, sf)
    # deals are first reduced to one row per family, day and leg
    d = shipments(spark, sf).groupBy("root", "day", "far").agg(
        F.min("px").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.avg("px").alias("close"), F.sum("qty").alias("volume"))
    d = d.join(FU.front_by_day(w, span(spark, sf)[1]).select("root", "day", "window_no"), ["root", "day"])
    d = d.withColumn("window_no", F.col("window_no") + F.col("far"))
    return materialize(
        d.join(w.select("root", "window_no", "year", "month"), ["root", "window_no"])
        .select("root", "year", "month", F.col("day").cast("timestamp").alias("ts"), "open", "high", "low", "close", "volume"))


@query("contract_files", """
WITH d AS (SELECT *, isodow(ts) = 7 AND coalesce(date_diff('day', ts, lead(ts) OVER (PARTITION BY root, year, month ORDER BY ts)) = 1, false) AS stub FROM contract_bars)
SELECT CASE WHEN (year * 12 + month) % 9 = 0 THEN 'refused' ELSE 'accepted' END AS status, root, year, month, CAST(CAST(min(ts) FILTER (NOT stub) AS DATE) AS VARCHAR) AS first_day,
 CAST(CAST(max(ts) FILTER (NOT stub) AS DATE) AS VARCHAR) AS last_day, round(sum(volume), 4) AS volume FROM d GROUP BY ALL
""", ("contract_bars",))
def _(spark, sf):
    """Contract months written in one pass and read back by status; every ninth has crossed prices."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/contracts-{uuid.uuid4().hex}"
    crossed = (F.col("year") * 12 + F.col("month")) % 9 == 0
    SF.write_contracts(contract_bars(spark, sf).withColumn("high", F.when(crossed, F.col("low") - 1000).otherwise(F.col("high"))), path)
    both = [SF.read_contracts(spark, path, s).withColumn("status", F.lit(s)) for s in (SF.ACCEPTED, SF.REFUSED)]
    return rounded(both[0].unionByName(both[1]).groupBy("status", "root", "year", "month").agg(
        F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"), F.sum("volume").alias("volume")), 4)


@query("contract_calendar", """
SELECT c.root, year, month, contract, CAST(last_trade AS VARCHAR) AS last_trade, CAST(first_notice AS VARCHAR) AS first_notice, CAST(roll_on AS VARCHAR) AS roll_on, coalesce(d.deals, 0) AS deals
FROM contracts c LEFT JOIN (SELECT root, date_trunc('month', day) AS m, count(*) AS deals FROM shipments GROUP BY ALL) d ON d.root = c.root AND d.m = date_trunc('month', c.last_trade)
""", ("contracts", "shipments"))
def _(spark, sf):
    m = shipments(spark, sf).groupBy("root", F.trunc("day", "MM").alias("m")).agg(F.count(F.lit(1)).alias("deals"))
    c = calendar(spark, sf).withColumn("m", F.trunc("last_trade", "MM")).join(m, ["root", "m"], "left").fillna(0, ["deals"])
    return c.select("root", "year", "month", "contract", "last_trade", "first_notice", "roll_on", "deals")


cte("fronts", "SELECT s.root, s.day, w.contract, count(*) AS deals FROM shipments s JOIN windows w ON w.root = s.root AND s.day >= w.active_from AND s.day < w.roll_on GROUP BY ALL", ("shipments", "windows"))


@query("front_windows", """
SELECT root, contract, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, CAST(sum(deals) AS BIGINT) AS deals FROM fronts GROUP BY ALL
""", ("fronts",))
def _(spark, sf):
    d = shipments(spark, sf).groupBy("root", "day").agg(F.count(F.lit(1)).alias("deals"))
    f = d.join(FU.front_by_day(windows(spark, sf), span(spark, sf)[1]), ["root", "day"])
    n = f.groupBy("root", "contract").agg(F.sum("deals").alias("deals"))
    return FU.front_windows(f).join(n, ["root", "contract"])


@query("roll_gaps", """
WITH w AS (SELECT *, row_number() OVER o AS sn, lead(year) OVER o AS ny, lead(month) OVER o AS nm, lead(contract) OVER o AS nc FROM windows w
  WHERE EXISTS (SELECT 1 FROM contract_bars b WHERE b.root = w.root AND b.year = w.year AND b.month = w.month) WINDOW o AS (PARTITION BY root ORDER BY year, month)),
c AS (SELECT w.root, w.sn, f.ts, f.close AS fc, n.close AS ncl, row_number() OVER (PARTITION BY w.root, w.sn ORDER BY f.ts < w.roll_on DESC, f.ts DESC) AS k FROM w JOIN contract_bars f ON f.root = w.root AND f.year = w.year AND f.month = w.month
  JOIN contract_bars n ON n.root = w.root AND n.year = w.ny AND n.month = w.nm AND n.ts = f.ts)
SELECT w.root, CAST(w.roll_on AS VARCHAR) AS roll_on, w.contract AS from_contract, w.nc AS to_contract, round(coalesce(ncl - fc, 0), 6) AS gap,
 round(coalesce(fc, (SELECT arg_max(close, ts) FROM contract_bars f WHERE f.root = w.root AND f.year = w.year AND f.month = w.month)), 6) AS front_close,
 round(coalesce(ncl, (SELECT arg_min(close, ts) FROM contract_bars f WHERE f.root = w.root AND f.year = w.ny AND f.month = w.nm)), 6) AS next_close, c.k IS NOT NULL AS measured
FROM w LEFT JOIN c ON c.root = w.root AND c.sn = w.sn AND c.k = 1 WHERE w.ny IS NOT NULL
""", ("windows", "contract_bars"))
def roll_gaps(spark, sf):
    b = contract_bars(spark, sf)
    return rounded(FU.rolls(FU.tradeable_windows(windows(spark, sf), b), b).drop("seq_no"))


cte("live_windows", """
SELECT *, row_number() OVER o AS sn, lead(year) OVER o AS ny, lead(month) OVER o AS nm, lead(last_trade) OVER o AS nlt FROM windows w
WHERE EXISTS (SELECT 1 FROM contract_bars b WHERE b.root = w.root AND b.year = w.year AND b.month = w.month) WINDOW o AS (PARTITION BY root ORDER BY year, month)
""", ("windows", "contract_bars"), materialized=True)
cte("common_days", """
SELECT w.root, w.sn, f.ts, f.close AS fc, n.close AS ncl, row_number() OVER (PARTITION BY w.root, w.sn ORDER BY f.ts < w.roll_on DESC, f.ts DESC) AS k FROM live_windows w
JOIN contract_bars f ON f.root = w.root AND f.year = w.year AND f.month = w.month JOIN contract_bars n ON n.root = w.root AND n.year = w.ny AND n.month = w.nm AND n.ts = f.ts
""", ("live_windows", "contract_bars"), materialized=True)
cte("shifts", """
SELECT w.*, coalesce(c.ncl - c.fc, 0) AS gap, sum(CASE WHEN w.ny IS NULL THEN 0 ELSE coalesce(c.ncl - c.fc, 0) END) OVER (PARTITION BY w.root ORDER BY w.sn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shift
FROM live_windows w LEFT JOIN common_days c ON c.root = w.root AND c.sn = w.sn AND c.k = 1
""", ("live_windows", "common_days"), materialized=True)


@query("stitch", """
WITH p AS (SELECT b.*, w.sn, w.contract, w.shift, (b.close - c.ncl) / b.close * (365.0 / greatest(w.nlt - w.last_trade, 1)) AS y FROM contract_bars b JOIN shifts w ON w.root = b.root AND w.year = b.year AND w.month = b.month
  LEFT JOIN common_days c ON c.root = w.root AND c.sn = w.sn AND c.ts = b.ts WHERE b.ts >= w.active_from AND (b.ts < w.roll_on OR w.ny IS NULL))
SELECT root, CAST(ts AS TIMESTAMP) AS ts, contract, round(open + shift, 6) AS open, round(high + shift, 6) AS high, round(low + shift, 6) AS low, round(close + shift, 6) AS close, volume, round(close, 5) AS raw_close,
 round(last_value(y IGNORE NULLS) OVER (PARTITION BY root, sn ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS carry FROM p
""", ("contract_bars", "shifts", "common_days"))
def _(spark, sf):
    b = contract_bars(spark, sf)
    return rounded(FU.stitch(FU.tradeable_windows(windows(spark, sf), b), b), raw_close=5)


@query("annual_roll_drag", "SELECT root, round(sum(gap) / ((SELECT hi - lo FROM span) / 365.25), 6) AS drag, count(*) AS rolls FROM shifts WHERE ny IS NOT NULL GROUP BY root", ("shifts", "span"))
def _(spark, sf):
    b = contract_bars(spark, sf)
    lo, hi, _ = span(spark, sf)
    years = (date.fromisoformat(hi) - date.fromisoformat(lo)).days / 365.25
    return rounded(FU.annual_roll_drag(FU.rolls(FU.tradeable_windows(windows(spark, sf), b), b), years))


cte("fut_trades", """
SELECT (['CL', 'ES', 'GC', 'ZN', 'ZC', '6E', 'HE', 'BZ'])[1 + CAST(l_partkey % 8 AS INTEGER)] AS symbol, o_orderdate AS entry_ts, l_shipdate AS exit_ts, l_quantity AS volume,
 l_extendedprice * l_tax * 0.1 AS costs, l_extendedprice * (l_discount - 0.05) - l_extendedprice * l_tax * 0.1 AS net_pnl, l_extendedprice / l_quantity AS px
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate
""")


def fut_trades(spark, sf):
    li = V.table(spark, sf, "lineitem")
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    fam = F.element_at(F.array(*[F.lit(r) for r in UNIVERSE]), (F.col("l_partkey") % 8 + 1).cast("int"))
    px = F.col("l_extendedprice")
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).filter(F.col("l_shipdate") > F.col("o_orderdate"))
            .select(fam.alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("entry_ts"), F.col("l_shipdate").cast("timestamp").alias("exit_ts"),
                    F.col("l_quantity").alias("volume"), (px * F.col("l_tax") * 0.1).alias("costs"),
                    (px * (F.col("l_discount") - 0.05) - px * F.col("l_tax") * 0.1).alias("net_pnl"), (px / F.col("l_quantity")).alias("px")))


@query("roll_bill", """
WITH r AS (SELECT t.symbol, t.volume, t.costs, t.net_pnl, t.entry_ts, t.exit_ts, s.tick_size * s.multiplier AS tv, s.commission, s.sector FROM fut_trades t JOIN roots s ON s.root = t.symbol),
k AS (SELECT *, (SELECT count(*) FROM windows w WHERE w.root = r.symbol AND w.roll_on > r.entry_ts AND w.roll_on <= r.exit_ts) AS n FROM r)
SELECT symbol, sector, count(*) AS trades, CAST(sum(n) AS BIGINT) AS rolls_crossed, round(sum(n * (2 * commission * volume + 2 * tv * volume) * 2), 2) AS unpaid_roll_cost, round(sum(costs), 2) AS charged_costs, round(sum(net_pnl), 2) AS net_pnl FROM k GROUP BY ALL
""", ("fut_trades", "roots", "windows"))
def _(spark, sf):
    log = windows(spark, sf).select("root", "roll_on")
    return rounded(FU.roll_bill(fut_trades(spark, sf), log, FU.roots(spark)), 2)


@query("roll_rebase", """
WITH p AS (SELECT symbol, px, volume, entry_ts, exit_ts, s.tick_size * s.multiplier AS tv, s.commission FROM fut_trades JOIN roots s ON s.root = symbol),
g AS (SELECT root, roll_on, gap, EXISTS (SELECT 1 FROM common_days c WHERE c.root = x.root AND c.sn = x.sn) AS ok FROM shifts x WHERE ny IS NOT NULL),
k AS (SELECT p.*, coalesce((SELECT sum(gap) FROM g WHERE g.root = p.symbol AND g.roll_on > p.entry_ts AND g.roll_on <= p.exit_ts AND ok), 0) AS basis,
 (SELECT count(*) FROM g WHERE g.root = p.symbol AND g.roll_on > p.entry_ts AND g.roll_on <= p.exit_ts AND ok) AS n FROM p)
SELECT symbol, count(*) AS n, CAST(sum(n) AS BIGINT) AS rolls, round(avg(px + basis), 6) AS entry_price, round(avg(px * 0.9 + basis), 6) AS stop_loss, round(sum(n * (2 * commission + 2 * tv) * volume), 2) AS roll_cost FROM k GROUP BY symbol
""", ("fut_trades", "roots", "shifts", "common_days"))
def _(spark, sf):
    b = contract_bars(spark, sf)
    log = FU.rolls(FU.tradeable_windows(windows(spark, sf), b), b)
    pos = fut_trades(spark, sf).select("symbol", F.col("px").alias("entry_price"), (F.col("px") * 0.9).alias("stop_loss"), "volume",
                                       F.col("entry_ts").alias("opened_at"), F.col("exit_ts").alias("as_of"))
    d = FU.rebase_positions(pos, log, FU.roots(spark))
    return rounded(d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rolls").alias("rolls"), F.avg("entry_price").alias("entry_price"),
        F.avg("stop_loss").alias("stop_loss"), F.sum("roll_cost").alias("roll_cost")), roll_cost=2)


@query("missing_contracts", f"""
SELECT root, year, month FROM contracts c WHERE root IN ('CL', 'ES', 'GC', 'ZN', 'ZC', '6E', 'HE', 'BZ') AND last_trade BETWEEN {LO} AND {HI} + 400
 AND NOT EXISTS (SELECT 1 FROM contract_bars b WHERE b.root = c.root AND b.year = c.year AND b.month = c.month)
""", ("contracts", "contract_bars", "span"))
def _(spark, sf):
    cal = calendar(spark, sf).filter(F.col("root").isin(*UNIVERSE))
    return FU.missing_contracts(cal, contract_bars(spark, sf), *span(spark, sf)[:2])


@query("calendar_vs_exchange", """
WITH x AS (SELECT root, year, month, max(ts) AS expiration FROM contract_bars GROUP BY ALL)
SELECT c.root, count(*) AS contracts, round(avg(CASE WHEN a.rk = b.rk THEN 1.0 ELSE 0.0 END), 6) AS exact, max(abs(a.rk - b.rk)) AS worst_miss
FROM contracts c JOIN x USING (root, year, month) JOIN cal a ON a.d = c.last_trade JOIN cal b ON b.d = x.expiration GROUP BY c.root
""", ("contracts", "contract_bars", "cal"))
def _(spark, sf):
    d = contract_bars(spark, sf).groupBy("root", "year", "month").agg(F.to_date(F.max("ts")).alias("expiration"))
    return rounded(FU.calendar_vs_exchange(calendar(spark, sf), d))


@query("parse_contract_symbols", """
WITH r AS (SELECT o_orderkey AS seq, o_orderdate AS ts, (['F','G','H','J','K','M','N','Q','U','V','X','Z'])[1 + CAST(o_custkey % 12 AS INTEGER)] AS l, 1 + o_custkey % 12 AS month, o_orderkey % 10 AS d,
  CASE WHEN o_custkey % 7 = 0 THEN 'spread' WHEN o_custkey % 5 = 0 THEN 'two' ELSE 'one' END AS kind FROM orders),
y AS (SELECT *, CASE WHEN kind = 'two' THEN 2000 + d ELSE year(ts) + ((d - year(ts)) % 10 + 10) % 10 END AS ny FROM r WHERE kind <> 'spread'),
z AS (SELECT y.*, ny + CASE WHEN kind = 'one' AND c.last_trade + 7 < CAST(ts AS DATE) THEN 10 ELSE 0 END AS year FROM y LEFT JOIN contracts c ON c.root = 'CL' AND c.year = ny AND c.month = y.month)
SELECT CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, ts, min(seq) AS seq FROM z GROUP BY ALL
""", ("contracts",))
def _(spark, sf):
    ck, ok = F.col("o_custkey"), F.col("o_orderkey")
    letter = F.substr(F.lit(FU.MONTH_CODES), (ck % 12 + 1).cast("int"), F.lit(1))
    d = (ok % 10).cast("string")
    sym = (F.when(ck % 7 == 0, F.concat(F.lit("CL"), letter, d, F.lit("-CLZ9"))).when(ck % 5 == 0, F.concat(F.lit("CL"), letter, F.lit("0"), d))
           .otherwise(F.concat(F.lit("CL"), letter, d)))
    raw = V.table(spark, sf, "orders").select(sym.alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"), ok.alias("seq"))
    return FU.parse_contract_symbols(raw, "CL", calendar(spark, sf)).select("year", "month", "ts", "seq")


@query("micro_to_parent", """
WITH m AS (SELECT (['MES','ES','MGC','SIL','ZN','XX','MBT','CL','MCL','QQ'])[1 + CAST(l_suppkey % 10 AS INTEGER)] AS market, l_extendedprice AS px FROM lineitem),
p AS (SELECT market, px, CASE market WHEN 'MES' THEN 'ES' WHEN 'MGC' THEN 'GC' WHEN 'SIL' THEN 'SI' WHEN 'MBT' THEN 'BTC' WHEN 'MCL' THEN 'CL' WHEN 'XX' THEN NULL WHEN 'QQ' THEN NULL ELSE market END AS parent FROM m)
SELECT parent, min(px) AS first_px, arg_min(market, px) AS market FROM p WHERE parent IS NOT NULL GROUP BY parent UNION ALL SELECT DISTINCT NULL, NULL, market FROM p WHERE parent IS NULL
""")
def _(spark, sf):
    names = F.array(*[F.lit(x) for x in ("MES", "ES", "MGC", "SIL", "ZN", "XX", "MBT", "CL", "MCL", "QQ")])
    m = V.table(spark, sf, "lineitem").select(F.element_at(names, (F.col("l_suppkey") % 10 + 1).cast("int")).alias("market"),
                                              F.col("l_extendedprice").alias("first_px"))
    known, unknown = FU.to_parent(m, FU.roots(spark), "first_px")
    return known.unionByName(unknown, allowMissingColumns=True).select("parent", "first_px", "market")
