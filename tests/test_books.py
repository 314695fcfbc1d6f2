import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as X
from tidemark.operators import costs as C
from tidemark.operators import futures as FU
from tidemark.operators import journal as J
from tidemark.operators import limits as L
from tidemark.operators import positioning as PO
from tidemark.operators import trades as T
from tidemark.operators import voltarget as VT

TRADE = ("symbol string, sleeve string, side int, volume double, entry_ts timestamp, exit_ts timestamp, entry_price double, "
         "gross_pnl double, costs double, risk_cash double")


def trades(spark, nets):
    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([("A", "s", 1, 1.0, t0 + timedelta(days=i), t0 + timedelta(days=i + 1), 10.0, n + 1.0, 1.0, 10.0)
                                  for i, n in enumerate(nets)], TRADE)


def test_metrics_on_a_known_series(spark):
    m = T.metrics(trades(spark, [10.0, -5.0, 20.0, -5.0]), ["sleeve"], 100.0).first()
    assert (m["trades"], m["win_rate"], m["payoff"], m["profit_factor"]) == (4, 0.5, 3.0, 3.0)
    assert m["total_return"] == pytest.approx(0.2) and m["max_drawdown"] == pytest.approx(5 / 110)
    assert m["expectancy_r"] == pytest.approx(0.5) and m["max_dd_days"] == 1.0


def test_attribution_reconciles_and_keeps_zero_rows(spark):
    w = spark.createDataFrame([("s", 1.0), ("idle", 3.0)], "sleeve string, w double")
    r = {x["sleeve"]: x for x in T.attribution(trades(spark, [4.0, 6.0]), w).collect()}
    assert r["s"]["net_pnl"] == 10.0 and r["s"]["share"] == 1.0 and r["s"]["weight"] == 0.25
    assert r["idle"]["trades"] == 0 and r["idle"]["net_pnl"] == 0.0


def test_consecutive_losses_order_the_trades_once(spark):
    n = 600
    rows = spark.range(n).select(
        (F.col("id") % 2).alias("sleeve"), F.timestamp_seconds(F.col("id") * 40_000).alias("exit_ts"), F.timestamp_seconds(F.lit(0)).alias("entry_ts"),
        F.when(F.xxhash64("id") % 5 == 0, 1.0).when(F.col("id") == 590, None).otherwise(-1.0).alias("gross_pnl"), F.lit(0.0).alias("costs"), F.lit(1.0).alias("risk_cash"), "id")
    out = T.consecutive_losses(rows, ["sleeve"], ["exit_ts", "id"])
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: (r.streak, r.last_loss_ts) for r in out.collect()}
    streak, last = {0: 0, 1: 0}, {0: None, 1: None}
    for r in rows.orderBy("id").collect():
        won = r.gross_pnl is not None and r.gross_pnl >= 0
        streak[r.sleeve] = 0 if won else streak[r.sleeve] + 1
        last[r.sleeve] = r.exit_ts if r.gross_pnl is not None and r.gross_pnl < 0 else last[r.sleeve]
        assert got[r.id] == (streak[r.sleeve], last[r.sleeve])
    assert len(got) == n


def test_streaks(spark):
    d = T.consecutive_losses(trades(spark, [-1.0, -1.0, 2.0, -1.0, -1.0, -1.0]), ["sleeve"]).orderBy("exit_ts").collect()
    assert [r["streak"] for r in d] == [1, 2, 0, 1, 2, 3]


def test_excursions_see_the_middle_of_a_long_holding(spark):
    first = date(1990, 1, 1)
    bars = [("A", first + timedelta(days=i), 140.0 if i == 5000 else 100.0, 99.0 if i != 7000 else 91.0) for i in range(10_000)]
    t = spark.createDataFrame([("A", "s", 1, 1.0, datetime(1990, 1, 1), datetime(1990, 1, 1) + timedelta(days=9_999), 100.0, 0.0, 0.0, 1.0)], TRADE)
    r = T.excursions(t, spark.createDataFrame(bars, "symbol string, day date, high double, low double")).first()
    assert (r["mfe"], r["mae"]) == (40.0, -9.0)


def test_excursions_equal_a_scan(spark):
    import random
    rnd = random.Random(0)
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(90) if i % 7 != 3]
    bars = [("A", d, 100 + rnd.random() * 10, 90 + rnd.random() * 10) for d in days]
    rows = []
    for _ in range(40):
        a = rnd.randrange(0, 80)
        rows.append(("A", "s", rnd.choice([1, -1]), 2.0, datetime(2024, 1, 1) + timedelta(days=a),
                     datetime(2024, 1, 1) + timedelta(days=a + rnd.randrange(1, 40)), 97.0 + a / 1000, 0.0, 0.0, 5.0))
    t = spark.createDataFrame(rows, TRADE)
    got = {(r["entry_ts"], r["exit_ts"], r["side"]): (r["mfe"], r["mae"]) for r in T.excursions(
        t, spark.createDataFrame(bars, "symbol string, day date, high double, low double")).collect()}
    for r in rows:
        held = [(h, l) for _, d, h, l in bars if r[4].date() <= d <= r[5].date()]
        hi, lo = max(h for h, _ in held), min(l for _, l in held)
        up, dn = (hi - r[6]) * 2 / 5, (lo - r[6]) * 2 / 5
        best, worst = (up, dn) if r[2] > 0 else (-dn, -up)
        assert got[(r[4], r[5], r[2])] == (pytest.approx(max(best, 0)), pytest.approx(min(worst, 0)))


def test_histogram_of_equal_values(spark):
    h = T.r_histogram(trades(spark, [5.0, 5.0]), ["sleeve"], 4).collect()
    assert sum(r["n"] for r in h) == 2


# ------------------------------------------------------------------------ costs

@pytest.mark.parametrize("entry,exit,nights", [
    ("2024-01-02 10:00:00", "2024-01-02 20:59:59", 0), ("2024-01-02 10:00:00", "2024-01-02 21:00:00", 1),
    ("2024-01-02 21:00:00", "2024-01-02 23:00:00", 0), ("2024-01-02 20:00:00", "2024-01-04 20:00:00", 4),
    ("2024-01-01 00:00:00", "2024-01-15 00:00:00", 18)])
def test_swap_nights(spark, entry, exit, nights):
    d = spark.createDataFrame([(datetime.fromisoformat(entry), datetime.fromisoformat(exit))], "a timestamp, b timestamp")
    assert d.select(C.swap_nights("a", "b", F.lit(2))).first()[0] == nights


def test_unknown_symbol_never_trades_for_free(spark):
    dim = spark.createDataFrame([("A", 0.1)], "symbol string, spread double")
    ok = spark.createDataFrame([("A",)], "symbol string")
    assert C.with_specs(ok, dim).count() == 1
    with pytest.raises(Exception, match="no cost model for ZZ"):
        C.with_specs(ok.unionByName(spark.createDataFrame([("ZZ",)], "symbol string")), dim).collect()


def test_zero_slippage_is_refused(spark):
    f = spark.createDataFrame([("A", 0.2, 0.0), ("A", 0.2, 0.0), ("B", 0.2, 0.1), ("B", 0.2, 0.1)], "symbol string, spread double, slippage double")
    q = spark.createDataFrame([("C", 0.1)] * 40, "symbol string, spread double")
    b = spark.createDataFrame([(s, 0.5, 0.25) for s in "ABCD"], "symbol string, spread double, slippage double")
    r = {x["symbol"]: x for x in C.calibrate(f, q, b).collect()}
    assert (r["A"]["slippage"], r["A"]["note"]) == (0.25, "slippage is zero")
    assert r["B"]["slippage"] == 0.1 and r["B"]["slippage_calibrated"]
    assert r["C"]["spread"] == 0.1 and not r["C"]["slippage_calibrated"]
    assert r["D"]["note"] == "never measured"


def test_sizing_outcomes(spark):
    spec = dict(tick_value=1.0, tick_size=0.1, volume_min=1.0, volume_max=50.0, volume_step=1.0)
    d = spark.createDataFrame([(1e5, 0.01, 10.0, 100.0), (1e3, 0.01, 10.0, 100.0), (1e7, 0.01, 10.0, 100.0), (1e5, 0.01, 10.0, 5.0), (1e5, 1.5, 10.0, 5.0)],
                              "equity double, risk_fraction double, stop_distance double, cap double")
    for k, v in spec.items():
        d = d.withColumn(k, F.lit(v))
    r = X.size_positions(d, "cap").collect()
    assert [x["outcome"] for x in r] == ["ok", "below_minimum", "capped_by_maximum", "capped_by_margin", "invalid"]
    assert [x["sized_volume"] for x in r] == [10.0, 0.0, 50.0, 5.0, 0.0]


def test_client_id_is_deterministic(spark):
    d = spark.createDataFrame([("averylongstrategyname", "A", "buy", "t")], "a string, b string, c string, d string")
    i = d.select(X.client_id("a", "b", "c", "d")).first()[0]
    assert i.startswith("averylongstr#") and len(i) == 23


# ---------------------------------------------------------------------- futures

@pytest.fixture(scope="module")
def calendar(spark):
    return FU.contract_calendar(FU.roots(spark), "2024-01-01", "2026-12-31").cache()


@pytest.mark.parametrize("root,y,m,last", [
    ("ES", 2025, 12, "2025-12-19"), ("GC", 2025, 12, "2025-12-29"), ("6E", 2025, 12, "2025-12-15"), ("CL", 2025, 12, "2025-11-20"),
    ("NG", 2025, 12, "2025-11-26"), ("RB", 2025, 12, "2025-11-28"), ("ZN", 2025, 12, "2025-12-22"), ("ZF", 2025, 12, "2025-12-31"),
    ("ZC", 2025, 12, "2025-12-12"), ("ZC", 2025, 3, "2025-03-14"), ("HE", 2025, 12, "2025-12-12"), ("GF", 2025, 11, "2025-11-27"),
    ("BZ", 2025, 12, "2025-10-31"), ("NKD", 2025, 12, "2025-12-11"), ("SR3", 2025, 12, "2026-03-17"), ("BTC", 2025, 12, "2025-12-26")])
def test_expiry_rules(calendar, root, y, m, last):
    r = calendar.filter((F.col("root") == root) & (F.col("year") == y) & (F.col("month") == m)).first()
    assert str(r["last_trade"]) == last


def test_first_notice_moves_the_roll(calendar):
    r = calendar.filter("root = 'GC' AND year = 2025 AND month = 12").first()
    assert str(r["first_notice"]) == "2025-11-28" and str(r["roll_on"]) == "2025-11-21" and r["contract"] == "GCZ5"


def test_windows_are_contiguous(calendar):
    w = FU.active_windows(calendar, "2024-01-01", "2026-12-31").filter("root = 'ZS'").orderBy("window_no").collect()
    assert all(a["roll_on"] == b["active_from"] for a, b in zip(w, w[1:]))


def two_contracts(spark, basis=5.0):
    w = spark.createDataFrame([("X", 2024, 3, "XH4", date(2024, 1, 1), date(2024, 1, 11), date(2024, 1, 15)),
                               ("X", 2024, 6, "XM4", date(2024, 1, 11), date(2024, 2, 11), date(2024, 4, 15))],
                              "root string, year int, month int, contract string, active_from date, roll_on date, last_trade date")
    rows = []
    for i in range(20):
        ts = datetime(2024, 1, 1) + timedelta(days=i)
        for m, b in ((3, 0.0), (6, basis)):
            c = 100.0 + i + b
            rows.append(("X", 2024, m, ts, c, c + 1, c - 1, c, 1.0))
    return w, spark.createDataFrame(rows, "root string, year int, month int, ts timestamp, open double, high double, low double, close double, volume double")


def test_stitch_removes_the_gap_and_reads_carry(spark):
    w, bars = two_contracts(spark)
    win = FU.tradeable_windows(w, bars)
    roll = FU.rolls(win, bars).first()
    assert (roll["gap"], roll["measured"], roll["from_contract"], roll["to_contract"]) == (5.0, True, "XH4", "XM4")
    s = FU.stitch(win, bars).orderBy("ts").collect()
    assert [b["close"] - a["close"] for a, b in zip(s, s[1:])] == [1.0] * 19
    assert s[0]["raw_close"] == 100.0 and s[0]["close"] == 105.0
    assert s[0]["carry"] == pytest.approx(-5 / 100 * 365 / 91) and s[-1]["carry"] is None


def test_unmeasured_roll_has_no_gap(spark):
    w, bars = two_contracts(spark)
    apart = bars.filter(((F.col("month") == 3) & (F.col("ts") < "2024-01-11")) | ((F.col("month") == 6) & (F.col("ts") >= "2024-01-11")))
    r = FU.rolls(FU.tradeable_windows(w, apart), apart).first()
    assert (r["gap"], r["measured"], r["front_close"], r["next_close"]) == (0.0, False, 109.0, 115.0)


def test_rolls_strictly_after_entry_and_up_to_exit(spark):
    log = spark.createDataFrame([("ES", date(2024, 3, 10)), ("ES", date(2024, 6, 10))], "root string, roll_on date")
    t = spark.createDataFrame([("ES", datetime(2024, 3, 10), datetime(2024, 6, 10), 2.0, 1.0, 5.0), ("ES", datetime(2024, 3, 9), datetime(2024, 6, 9), 2.0, 1.0, 5.0)],
                              "symbol string, entry_ts timestamp, exit_ts timestamp, volume double, costs double, net_pnl double")
    assert [r["rolls"] for r in FU.rolls_in_holding(t, log).collect()] == [1, 1]
    bill = FU.roll_bill(t, log, FU.roots(spark)).first()
    assert bill["unpaid_roll_cost"] == pytest.approx(2 * (2 * 2.5 * 2 + 2 * 12.5 * 2) * 2)


def test_symbols_resolve_their_decade(spark, calendar):
    rows = [("CLM4", "2024-03-01", 1), ("CLF4", "2024-03-01", 2), ("CLM26", "2024-03-01", 3), ("CLM4-CLN4", "2024-03-01", 4),
            ("CLM4", "2024-03-01", 5), ("CL C50", "2024-03-01", 6)]
    raw = spark.createDataFrame([(s, datetime.fromisoformat(t), n) for s, t, n in rows], "symbol string, ts timestamp, seq int")
    got = {(r["year"], r["month"], r["seq"]) for r in FU.parse_contract_symbols(raw, "CL", calendar).collect()}
    assert got == {(2024, 6, 1), (2034, 1, 2), (2026, 6, 3)}


# ------------------------------------------------------------- positioning, book

def test_reports_join_when_published(spark):
    rows = [("m", date(2024, 1, 2) + timedelta(weeks=i), 100.0, 60.0 + i, 10.0, 5.0, 5.0, 1.0, 1.0) for i in range(3)]
    f = PO.features(spark.createDataFrame(rows, "market string, as_of date, oi double, spec_long double, spec_short double, comm_long double, comm_short double, small_long double, small_short double"), 2)
    stamps = [datetime(2024, 1, 5, 20), datetime(2024, 1, 5, 21), datetime(2024, 1, 12, 20, 59), datetime(2024, 1, 30)]
    bars = spark.createDataFrame([("m", t) for t in stamps], "market string, ts timestamp")
    got = [r["cot_as_of"] for r in PO.join_to_bars(bars, f, ["market"]).orderBy("ts").collect()]
    assert got == [None, date(2024, 1, 2), date(2024, 1, 2), date(2024, 1, 16)]


def test_one_market_gets_the_whole_budget(spark):
    import random
    rnd = random.Random(1)
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(100)]
    cash = spark.createDataFrame([("A", d, rnd.gauss(0, 100)) for d in days], "symbol string, day date, cash double")
    leg = spark.createDataFrame([(days[-1], "l", "A", 1, 10.0, 1.0, None, 1e6)], "decision_day date, leg string, symbol string, side int, stop_distance double, value_per_unit double, held_contracts double, equity double")
    r = VT.allocate(leg, cash, max_risk=1.0).first()
    assert r["contracts"] * r["sigma"] == pytest.approx(0.12 * 1e6 / 252 ** 0.5)
    young = VT.allocate(leg, cash.filter("day > '2024-03-20'")).first()
    assert young["note"] == "default" and young["contracts"] == 0.0


# -------------------------------------------------------------- journal, limits

def test_each_limit_breaches_once(spark):
    cols = dict(day_start_equity=100.0, equity=93.0, high_water_equity=120.0, starting_equity=100.0, risk_cash=1.0, risk_fraction=0.02,
                total_risk_fraction=0.0, margin_level=1.0, feed_age_seconds=60.0, bucket_open_risk=0.05, existing_volume=0.0, open_positions=9.0,
                current_spread=3.0, median_spread=1.0, streak=5.0, sleeve_open_risk=0.05, total_open_risk=0.05, sleeve_cap=0.01, unstopped=1.0)
    d = spark.range(1)
    for k, v in cols.items():
        d = d.withColumn(k, F.lit(v))
    d = d.withColumn("killed", F.lit(True)).withColumn("ts", F.lit(datetime(2024, 1, 2))).withColumn("last_loss_ts", F.lit(datetime(2024, 1, 1, 12)))
    checks = [L.kill_switch(), L.daily_loss(0.03, 0.05), L.max_drawdown(0.1, 0.2, True), L.margin_level(), L.feed_heartbeat(), L.risk_per_trade(0.01),
              L.correlated_bucket(0.06), L.max_positions(5), L.spread_guard(), L.consecutive_losses(3), L.sleeve_budget(0.1), L.unstopped_position()]
    hits = {r["limit"]: r["severity"] for r in L.audit(d, checks, ["id"]).collect()}
    assert len(hits) == 12 and hits["daily_loss"] == "FLATTEN" and hits["consecutive_losses"] == "PAUSE"
    calm = d.withColumn("last_loss_ts", F.lit(datetime(2023, 12, 30))).withColumn("existing_volume", F.lit(1.0))
    quiet = {r["limit"] for r in L.audit(calm, checks, ["id"]).collect()}
    assert {"consecutive_losses", "max_positions"} & quiet == set()


def test_journal_round_trip_and_truncated_tail(spark, tmp_path):
    from tidemark.sources import files as SF
    t0 = datetime(2024, 1, 1)
    lines = [dict(ts=(t0 + timedelta(minutes=m)).isoformat(), event="heartbeat", equity=1e5 - i, halted=i == 0, feed_age_s=5.0 if i else 900.0)
             for i, m in enumerate((0, 1, 2, 22, 23, 24))]
    lines += [dict(ts=t0.isoformat(), event="decision", approved=False, note="risk limit", symbol="E",
                   breaches=[dict(limit="SpreadGuard", severity="reject", message="", observed=3.0, threshold=2.0)]),
              dict(ts=t0.isoformat(), event="decision", approved=True, note="", breaches=[], symbol="X", strategy="m", side="SELL"),
              dict(ts=t0.isoformat(), event="fill", status="filled", slippage=-0.1, ticket=1)]
    p = tmp_path / "j.jsonl"
    p.write_text("\n".join(json.dumps(x) for x in lines) + '\n\n{"ts": "2024-01-0')
    j = SF.read_journal(spark, str(p)).withColumn("seq", F.monotonically_increasing_id())
    assert j.count() == 9 and SF.read_journal(spark, str(p), "heartbeat", 2).count() == 2
    d = J.digest(j).first()
    assert (d["heartbeats"], d["halted"], d["decisions"], d["approved"], d["filled"]) == (6, 1, 2, 1, 1)
    assert d["feed_age_median"] == 5.0 and d["feed_age_max"] == 900.0 and d["slippage_median"] == 0.1
    gaps = J.heartbeat_gaps(j.filter("event = 'heartbeat'"), 300).collect()
    assert [round(g["minutes"]) for g in gaps] == [20]
    assert {r["cause"]: r["n"] for r in J.rejections_by_cause(j.filter("event = 'decision'")).collect()} == {"SpreadGuard": 1}
    SF.write_journal(j.select("ts", "event", F.lit(float("nan")).alias("equity")), str(tmp_path / "out"))
    back = SF.read_journal(spark, str(tmp_path / "out"))
    assert back.count() == 9 and back.filter("equity IS NOT NULL").count() == 0


def test_clock_anchor_follows_new_york(spark):
    d = spark.createDataFrame([(datetime(2024, 1, 15, 12),), (datetime(2024, 7, 15, 12),)], "s timestamp")
    r = [x[0] for x in d.select(X.server_to_utc("s")).collect()]
    assert [t.hour for t in r] == [10, 9]
    assert [x[0].hour for x in d.select(X.utc_to_server(X.server_to_utc("s"))).collect()] == [12, 12]
