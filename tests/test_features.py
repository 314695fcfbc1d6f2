from datetime import datetime, timedelta

import pandas as pd
import pytest
from helpers import close_bars, col, walk_bars
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.functions import scan
from tidemark.operators import asof, bars as B, quality as Q


@pytest.fixture(scope="module")
def walk(spark):
    return walk_bars(spark, 700).cache()


@pytest.mark.parametrize("span", [2, 20, 300])
def test_ema_matches_recursion(spark, walk, span):
    x = pd.Series(col(walk, "close"))
    want = x.ewm(span=span, adjust=False, min_periods=span).mean()
    got = pd.Series(col(scan.ema(walk, "close", span, "e"), "e"), dtype="float64")
    pd.testing.assert_series_equal(got, want, check_names=False, rtol=1e-9)


def test_ema_with_leading_nulls(spark, walk):
    d = walk.withColumn("x", F.when(F.col("volume") >= 140, F.col("close")))
    x = pd.Series(col(d, "x"), dtype="float64")
    got = pd.Series(col(scan.ema(d, "x", 10, "e"), "e"), dtype="float64")
    pd.testing.assert_series_equal(got, x.ewm(span=10, adjust=False, min_periods=10).mean(), check_names=False, rtol=1e-9)


def test_atr_and_true_range(spark):
    d = I.with_atr(close_bars(spark, [1.0, 1.1, 1.05, 1.2]), 2).withColumn("tr", I.true_range())
    tr = col(d, "tr")
    assert tr[0] == pytest.approx(0.004)
    assert tr[1] == pytest.approx(0.104)
    assert col(d, "atr")[0] is None and col(d, "atr")[1] == pytest.approx((tr[0] + tr[1]) / 2)


def test_rolling_percentile_ties(spark):
    d = close_bars(spark, [1.0, 2.0, 2.0, 2.0]).withColumn("p", I.rolling_percentile("close", 4))
    assert col(d, "p") == [None, None, None, pytest.approx((1 + 2) / 4)]


def test_donchian_excludes_the_current_bar(spark):
    up, down = I.donchian(3)
    d = close_bars(spark, [1, 2, 3, 10, 4]).withColumn("u", up).withColumn("d", down)
    assert col(d, "u")[:3] == [None] * 3
    assert col(d, "u")[3] == pytest.approx(3.002)
    assert col(d, "u")[4] == pytest.approx(10.002)


OPS = {
    "atr": lambda d: I.with_atr(d), "ema": lambda d: scan.ema(d, "close", 30, "ema"),
    "trend": lambda d: I.regime_features(d, rank=60), "mom_20": lambda d: I.meta_features(d, rank=60),
    "forecast": lambda d: I.with_forecast(d, 40)}


@pytest.mark.parametrize("name", list(OPS))
def test_features_do_not_look_ahead(walk, name):
    r = Q.lookahead_audit(OPS[name], walk, datetime(2022, 10, 1), ["symbol", "ts"], name).first()
    assert r["rows_compared"] > 200 and r["mismatches"] == 0


def test_audit_catches_a_leak(walk):
    leak = lambda d: d.withColumn("x", F.max("close").over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("symbol")))
    cut = datetime(2022, 3, 1)
    assert Q.lookahead_audit(leak, walk, cut, ["symbol", "ts"], "x").first()["mismatches"] > 0


def test_features_are_shift_invariant(walk):
    moved = walk
    for c in ("open", "high", "low", "close"):
        moved = moved.withColumn(c, F.col(c) - 50.0)
    for c in ("vol_change", "efficiency", "trend"):
        a, b = (pd.Series(col(I.regime_features(d, rank=60), c), dtype="float64") for d in (walk, moved))
        pd.testing.assert_series_equal(a, b, rtol=1e-6)


def test_htf_marker_is_never_early(spark):
    t0 = datetime(2026, 1, 5)
    ex = spark.createDataFrame([("A", t0 + timedelta(minutes=15 * i), float(i)) for i in range(96)], "symbol string, ts timestamp, close double")
    htf = spark.createDataFrame([("A", t0 + timedelta(hours=4 * i), float(i)) for i in range(6)], "symbol string, ts timestamp, marker double")
    got = col(asof.align_higher_timeframe(ex, htf, "H4", ["marker"]), "h4_marker")
    want = [None if i * 15 < 240 else float(i * 15 // 240 - 1) for i in range(96)]
    assert got == want
    with pytest.raises(KeyError):
        asof.align_higher_timeframe(ex, htf, "H4", ["nope"])


def test_session_mask_and_runway(spark):
    t = [datetime(2026, 1, 5, h, m) for h, m in ((6, 0), (7, 0), (19, 45), (20, 0), (23, 0))]
    d = spark.createDataFrame([(x,) for x in t], "ts timestamp").select(
        "ts", I.session_mask(7, 20).alias("a"), I.session_mask(22, 6).alias("b"), I.bars_until(20, 15).alias("n"))
    assert col(d, "a") == [False, True, True, False, False]
    assert col(d, "b") == [False, False, False, False, True]
    assert col(d, "n") == [56, 52, 1, 96, 84]


# -------------------------------------------------------------------- prints

def print_frame(spark, n=60):
    t0 = datetime(2026, 1, 5, 13, 30)
    rows = [("ES", t0 + timedelta(seconds=30 * i), i, 6000 + 0.25 * (i // 10), 2.0, 1 if i < n // 2 else -1) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, price double, size double, side int")


def test_delta_bars_and_opening_window(spark):
    d = B.delta_bars(print_frame(spark), "5 minutes")
    assert col(d, "delta") == [20.0, 20.0, 20.0, -20.0, -20.0, -20.0]
    assert sum(col(d, "volume")) == 120.0 and col(d, "cum_delta")[-1] == 0.0
    o = B.open_imbalance(d, 13, 30, 15).first()
    assert o["open_delta"] == 60.0 and o["available_at"] == datetime(2026, 1, 5, 13, 45)


def test_tick_rule(spark):
    px = [1.0, 1.1, 1.1, 1.0, 1.0, 1.2]
    d = spark.createDataFrame([("A", datetime(2026, 1, 5, 0, i), i, p, 1.0) for i, p in enumerate(px)],
                              "symbol string, ts timestamp, seq long, price double, size double")
    assert col(B.infer_side(d), "side") == [0, 1, 1, -1, -1, 1]


def test_spread_is_recovered_and_thin_data_refused(spark):
    from tidemark.operators import flow
    rows = [("A", datetime(2026, 1, 5) + timedelta(seconds=i), i, 100 + (0.25 if i % 2 else 0.0), 1.0, 1 if i % 2 else -1) for i in range(60)]
    d = spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, price double, size double, side int")
    assert flow.measured_spread(d, 1.0, 30).first()["spread"] == 0.25
    assert flow.measured_spread(d, 1.0, 1000).first()["spread"] is None
    assert flow.measured_spread(d, 0.5, 0).first()["crossings"] == 0


@pytest.mark.parametrize("limit", [4_000_000, 400, 0])
def test_tick_rule_over_many_chunks(spark, monkeypatch, limit):
    import random

    from tidemark.functions import chunks
    monkeypatch.setattr(chunks, "CELL_ROWS", limit)
    rnd = random.Random(11)
    px, rows = 100.0, []
    for i in range(2000):
        px += rnd.choice([0, 0, 0, 0, 0.25, -0.25]) if i > 300 else 0.0
        rows.append(("A" if i % 5 else "B", datetime(2026, 1, 5) + timedelta(seconds=i // 2), i, px, 1.0))
    d = spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, price double, size double")
    got = {r["seq"]: (r["side"], r["prev_price"], r["prev_side"]) for r in B.infer_side(d, with_previous=True).collect()}
    for s in "AB":
        side, prev = 0, None
        for sym, _, i, p, _ in rows:
            if sym != s:
                continue
            was = side
            side = side if prev is None or p == prev else (1 if p > prev else -1)
            assert got[i] == (side, prev, None if prev is None else was)
            prev = p


# ------------------------------------------------------------------- quality

def test_gaps(spark):
    ts = [datetime(2026, 1, 7, 10), datetime(2026, 1, 7, 14), datetime(2026, 1, 9, 20), datetime(2026, 1, 11, 22),
          datetime(2026, 1, 12, 20), datetime(2026, 1, 12, 22)]
    d = spark.createDataFrame([("A", t) for t in ts], "symbol string, ts timestamp")
    g = Q.find_gaps(d, "H1").withColumn("kind", Q.gap_kind()).orderBy("gap_start").collect()
    assert [(r["missing_bars"], r["kind"]) for r in g] == [(3, "GAP"), (53, "GAP"), (49, "weekend"), (21, "GAP"), (1, "rollover")]


def test_validation_counts_and_refusal(spark):
    good = close_bars(spark, [1.0, 1.1, 1.2])
    Q.require_valid(good)
    bad = good.unionByName(good.limit(1)).withColumn("low", F.lit(5.0))
    r = Q.validate_counts(bad).first()
    assert r["duplicate_ts"] == 1 and r["high_below_low"] == 4
    with pytest.raises(Q.DataError):
        Q.require_valid(bad)
    below = good.select("symbol", "ts", *[(F.col(c) - 3).alias(c) for c in ("open", "high", "low", "close")], "volume")
    with pytest.raises(Q.DataError):
        Q.require_valid(below)
    Q.require_valid(below, allow_nonpositive=True)
    with pytest.raises(Q.DataError):
        Q.validate_counts(good.drop("low"))


def test_sunday_folds_into_monday_only(spark):
    days = [datetime(2026, 1, 9), datetime(2026, 1, 11), datetime(2026, 1, 12), datetime(2026, 1, 18)]
    rows = [("A", t, float(i + 1), 10.0 - i, 0.5 - i, float(i + 2), 5.0) for i, t in enumerate(days)]
    d = Q.merge_sunday_stubs(spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double"))
    out = d.orderBy("ts").collect()
    assert [r["ts"].day for r in out] == [9, 12, 18]
    assert (out[1]["open"], out[1]["high"], out[1]["low"], out[1]["close"], out[1]["volume"]) == (2.0, 9.0, -1.5, 4.0, 10.0)
