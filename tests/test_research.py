import math
import random
from datetime import datetime, timedelta

import pytest
from helpers import close_bars, col, walk_bars
from pyspark.sql import functions as F

from tidemark.functions.distributions import norm_cdf, norm_ppf, t_two_sided
from tidemark.operators import folds as FO
from tidemark.operators import labels as LB
from tidemark.operators import overfit as O
from tidemark.operators import passage as PA
from tidemark.operators import portfolio as P
from tidemark.operators import resample as RS
from tidemark.operators import screen as S
from tidemark.operators import signals as R


def test_distribution_functions(spark):
    d = spark.createDataFrame([(0.0, 0.975, 2.228138852, 10.0), (1.959963985, 0.5, 12.706204736, 1.0)], "z double, p double, t double, df double")
    r = d.select(norm_cdf("z").alias("c"), norm_ppf("p").alias("q"), t_two_sided("t", "df").alias("s")).collect()
    assert r[0]["c"] == 0.5 and r[1]["c"] == pytest.approx(0.975)
    assert r[0]["q"] == pytest.approx(1.959963985) and r[1]["q"] == pytest.approx(0.0)
    assert r[0]["s"] == pytest.approx(0.05) and r[1]["s"] == pytest.approx(0.05)


@pytest.mark.parametrize("h", [1, 2, 24, 300])
def test_greedy_thinning_matches_a_loop(spark, h):
    rnd = random.Random(h)
    rows, want = [], set()
    for k in ("a", "b"):
        ids = sorted(rnd.sample(range(3000), 400)) if k == "a" else list(range(1000))
        last = -10 ** 9
        for i in ids:
            rows.append((k, i, h))
            if i - last >= h:
                want.add((k, i))
                last = i
    d = spark.createDataFrame(rows, "k string, idx int, horizon int")
    assert {(r["k"], r["idx"]) for r in S.nonoverlap(d, ["k"]).collect()} == want


def test_streak_fade_and_weekday(spark):
    b = S.prepare(close_bars(spark, [1, 2, 3, 4, 3, 2, 1, 2]))
    assert col(b.withColumn("s", S.streak_fade(3)()), "s") == [0, 0, 0, -1, 0, 0, 1, 0]
    assert col(b.withColumn("s", S.weekday(0)()), "s") == [1, 0, 0, 0, 0, 0, 0, 1]  # 2024-01-01 was a Monday


def test_screen_counts_trials_and_finds_a_planted_effect(spark):
    rnd = random.Random(8)
    px, closes = 100.0, []
    for i in range(2200):
        px += rnd.gauss(0, 0.3) + (0.6 if (datetime(2024, 1, 1) + timedelta(days=i)).weekday() == 1 else -0.1)
        closes.append(px)
    s = S.run_screen(close_bars(spark, closes), S.DAILY, 300)
    rows = {r["hypothesis"]: r for r in s.collect()}
    assert rows["monday_long"]["verdict"] == "SURVIVES" and rows["monday_long"]["rank"] == 1
    assert {r["trials"] for r in rows.values()} == {len(S.DAILY)}


def test_seasonal_mean_reads_earlier_years_only(spark):
    rows = []
    for y in range(2010, 2018):
        for m in range(1, 13):
            rows.append(("A", datetime(y, m, 1), 100.0))
            rows.append(("A", datetime(y, m, 25), 110.0 if m == 3 else 99.0))
    d = spark.createDataFrame(rows, "symbol string, ts timestamp, close double")
    p = R.prior_period_mean(d, F.month("ts"), F.year("ts"), 5).filter("period = 3").orderBy("cycle").collect()
    assert [r["prior_mean"] for r in p[:5]] == [None] * 5
    assert p[5]["prior_mean"] == pytest.approx(0.1) and p[5]["prior_n"] == 5


def test_trend_needs_momentum_and_ema(spark):
    up = R.signal_events(R.trend(close_bars(spark, [1 + 0.01 * i for i in range(120)]), 20, 20, veto=None))
    assert {r["side"] for r in up.collect()} == {1} and up.count() == 120 - 25 - 1


def test_confidence_ladders(spark):
    d = spark.createDataFrame([(None,), (0.0,), (0.1,), (-1.0,), (5.0,)], "f double")
    assert [r[0] for r in d.select(R.to_confidence(F.col("f"))).collect()] == [0.0, 0.0, 0.25, 0.5, 1.0]
    assert [r[0] for r in d.select(R.probability_to_confidence(F.abs("f"), 0.5)).collect()][3:] == [1.0, 1.0]


# ---------------------------------------------------------------------- labels

def _label(spark, closes, hi, lo, side=1, stop=1.0, max_bars=3):
    rows = [("A", datetime(2024, 1, 1) + timedelta(days=i), float(o), float(h), float(l), float(c), 1.0)
            for i, (o, h, l, c) in enumerate(zip(closes, hi, lo, closes))]
    bars = LB.index_bars(spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double"))
    ev = spark.createDataFrame([("A", 0, side, stop)], "symbol string, i int, side int, stop_distance double")
    return LB.triple_barrier(ev, bars, 2.0, max_bars).collect()


def test_barriers(spark):
    c = [10, 10, 10, 10, 10, 10]
    assert _label(spark, c, [10, 10, 12, 10, 10, 10], [10] * 6)[0].asDict()["touched"] == "target"
    both = _label(spark, c, [10, 12, 10, 10, 10, 10], [10, 9, 10, 10, 10, 10])[0]
    assert (both["touched"], both["t1"], both["ret"], both["label"]) == ("stop", 1, -1.0, 0)
    late = _label(spark, c, [10] * 6, [10] * 6)[0]
    assert (late["touched"], late["t1"], late["ret"]) == ("time", 4, 0.0)
    short = _label(spark, c, [10] * 6, [10, 10, 8, 10, 10, 10], side=-1)[0]
    assert (short["touched"], short["ret"], short["label"]) == ("target", 2.0, 1)
    assert _label(spark, c, [10] * 6, [10] * 6, stop=0.0) == []


@pytest.mark.parametrize("max_bars", [1, 7, 8, 20, 1000])
def test_barriers_against_bar_by_bar(spark, max_bars):
    rnd = random.Random(max_bars)
    bars, px = [], 100.0
    for i in range(1500):
        o, px = px, max(px + rnd.gauss(0, 1), 20)
        bars.append(("A", i, o, max(o, px) + rnd.random(), min(o, px) - rnd.random(), px))
    bars += [("B", 0, 5.0, 5.0, 5.0, 5.0)]
    ev = [("A", rnd.randrange(-1, 1500), rnd.choice([1, -1]), rnd.choice([0.5, 3.0, 15.0, 80.0])) for _ in range(400)] + [("B", 0, 1, 1.0), ("B", -1, 1, 1.0)]
    ev = list(dict.fromkeys(ev))
    want = {}
    for s, i, side, stop in ev:
        path = [b for b in bars if b[0] == s and i + 1 <= b[1] <= i + 1 + max_bars]
        if not path or path[0][1] != i + 1:
            continue
        entry = path[0][2]
        lo, hi = entry - stop * side, entry + 2 * stop * side
        for _, t, _, high, low, close in path:
            if (low <= lo) if side > 0 else (high >= lo):
                want[s, i, side, stop] = (t, "stop", lo)
                break
            if (high >= hi) if side > 0 else (low <= hi):
                want[s, i, side, stop] = (t, "target", hi)
                break
        else:
            want[s, i, side, stop] = (t, "time", close)
    b = spark.createDataFrame(bars, "symbol string, idx int, open double, high double, low double, close double")
    e = spark.createDataFrame(ev, "symbol string, i int, side int, stop_distance double")
    d = LB.triple_barrier(e, b, 2.0, max_bars)
    got = {(r["symbol"], r["i"], r["side"], r["stop_distance"]): (r["t1"], r["touched"], r["exit"]) for r in d.collect()}
    assert got == want
    assert {"stop", "target", "time"} <= {v[1] for v in want.values()} or max_bars == 1000


def test_barriers_do_not_widen_bars_with_the_holding_time(spark):
    b = spark.createDataFrame([("A", i, 1.0, 1.0, 1.0, 1.0) for i in range(3000)], "symbol string, idx int, open double, high double, low double, close double")
    p = LB.pages(b, 1024).selectExpr("sum(size(_open)) n", "max(size(_low)) levels").first()
    assert p["n"] <= 2 * 3000 and p["levels"] == 12


def test_overlap_weights(spark):
    d = spark.createDataFrame([("A", 0, 9), ("A", 5, 14), ("A", 30, 39)], "symbol string, entry_i int, t1 int")
    w = {r["entry_i"]: r["weight"] for r in LB.sample_weights(d).collect()}
    assert w[0] == pytest.approx(w[5]) and w[30] / w[0] == pytest.approx(1 / 0.75)
    assert sum(w.values()) == pytest.approx(3.0)


@pytest.fixture(scope="module")
def spans(spark):
    return spark.createDataFrame([(i, i + 7) for i in range(200)], "t0 long, t1 long").cache()


def test_purged_folds_never_overlap(spans):
    f = FO.purged_kfold(spans, [], ["t0"], 5, 0.02).collect()
    for k in range(5):
        test = [r for r in f if r["fold"] == k and r["role"] == "test"]
        lo, hi = min(r["t0"] for r in test), max(r["t1"] for r in test)
        train = [r for r in f if r["fold"] == k and r["role"] == "train"]
        assert len(test) == 40 and train and all(r["t1"] < lo or r["t0"] > hi + 4 for r in train)
    rep = FO.leakage_report(FO.purged_kfold(spans, [], ["t0"], 5, 0.02), []).first()
    assert rep["leaks"] == 2 * 4 * 7 and rep["mean_naive"] == 160


def test_combinatorial_paths(spans):
    f = FO.combinatorial(spans, [], ["t0"], 6, 2, 0.0)
    per = f.groupBy("path").agg(F.sum(F.when(F.col("role") == "test", 1).otherwise(0)).alias("n")).collect()
    assert len(per) == 15 and {r["n"] for r in per} <= {66, 67, 68}


# ------------------------------------------------------------------ statistics

def _returns(spark, configs, n=400, edge=None, seed=0):
    rnd = random.Random(seed)
    rows = [(c, t, rnd.gauss(edge if c == 0 and edge else 0.0, 0.01)) for c in range(configs) for t in range(n)]
    return spark.createDataFrame(rows, "config int, t int, ret double")


def test_psr_is_half_at_its_own_sharpe(spark):
    m = O.return_moments(_returns(spark, 1), ["config"])
    assert O.probabilistic_sharpe(m, F.col("sharpe")).first()["psr"] == pytest.approx(0.5)
    none = spark.createDataFrame([(0, i, -0.01 if i % 2 else 0.005) for i in range(50)], "config int, t int, ret double")
    assert math.isinf(O.min_track_record(O.return_moments(none, ["config"])).first()["min_track_record"])


def test_more_trials_lower_the_deflated_sharpe(spark):
    m = O.return_moments(_returns(spark, 20, edge=0.002), ["config"])
    few, many = (O.deflated_sharpe(m, m, n).filter("config = 0").first()["dsr"] for n in (2, 5000))
    assert 0 < many < few < 1


def test_overfitting_probability(spark):
    noise = O.pbo(O.pbo_splits(_returns(spark, 12, seed=3))).first()
    edge = O.pbo(O.pbo_splits(_returns(spark, 12, edge=0.004, seed=3))).first()
    assert noise["splits"] == 70 and 0.1 < noise["pbo"] < 0.95 and edge["pbo"] < 0.05
    with pytest.raises(ValueError):
        O.pbo_splits(noise and _returns(spark, 2), 5)


RULES = PA.Rules(50_000, 3_000, 2_000, True, 1_000, 0.5, 2, 40)


def _simulate(path, k):
    """Day-by-day evaluation of one path, for comparison."""
    eq, high, best = RULES.account, RULES.account, 0.0
    for day, r in enumerate(path[:RULES.max_days], 1):
        before, eq = eq, eq * (1 + k * r)
        if before - eq >= RULES.daily_limit:
            return "daily_limit", day
        if eq <= high - RULES.max_loss:
            return "max_loss", day
        high, best = max(high, eq), max(best, eq - before)
        won = eq - RULES.account
        if won >= RULES.target and day >= RULES.min_days and best <= RULES.consistency * won:
            return "pass", day
    return "timeout", min(len(path), RULES.max_days)


def test_every_start_matches_a_day_loop(spark):
    rnd = random.Random(2)
    rets = [rnd.gauss(0.0008, 0.008) for _ in range(150)]
    d = PA.with_period(spark.createDataFrame([("b", i, r) for i, r in enumerate(rets)], "book string, d int, ret double"), ["book"], ["d"])
    w = PA.walk(PA.every_start(d, ["book"], RULES), ["book"], RULES, [0.5, 1.0, 2.0])
    got = {(r["k"], r["path"]): (r["outcome"], r["days"]) for r in w.collect()}
    want = {(k, s): _simulate(rets[s:], k) for k in (0.5, 1.0, 2.0) for s in range(148)}
    assert got == want and len({o for o, _ in got.values()}) >= 3


def test_survival_locks_the_floor(spark):
    up_down = [0.02, 0.021, 0.0, -0.05] + [0.0] * 20
    d = spark.createDataFrame([("b", 0, i + 1, r) for i, r in enumerate(up_down)], "book string, path int, day int, ret double")
    rules = PA.Rules(50_000, 3_000, 2_000, True, None, None, 0, 24)
    r = PA.survival(d, ["book"], rules, [1.0], 24).first()
    assert r["p_alive"] == 0.0 and r["median_days_alive"] == 4.0


def test_bootstrap_paths_are_blocks(spark):
    d = PA.with_period(spark.createDataFrame([("b", i, float(i)) for i in range(100)], "book string, d int, ret double"), ["book"], ["d"])
    p = PA.block_paths(d, ["book"], 10, 50, 20).orderBy("path", "day").collect()
    assert len(p) == 500
    for a, b in zip(p, p[1:]):
        if a["path"] == b["path"] and a["day"] % 20:
            assert b["ret"] == a["ret"] + 1


def test_monte_carlo_segments_agree_with_one_pass(spark, monkeypatch):
    rnd = random.Random(5)
    d = PA.with_period(spark.createDataFrame([("b", i, rnd.gauss(0.001, 0.02)) for i in range(300)], "book string, d int, ret double"), ["book"], ["d"])
    whole = PA.monte_carlo(d, ["book"], 40).first().asDict()
    monkeypatch.setattr(PA, "SEGMENT", 17)
    assert PA.monte_carlo(d, ["book"], 40).first().asDict() == pytest.approx(whole)


# ------------------------------------------------------------------ portfolios

def test_momentum_book_and_turnover(spark):
    rows = [(f"s{j}", datetime(2020 + i // 12, i % 12 + 1, 1).date(), 100.0 * (1 + 0.01 * (j - 5)) ** i) for j in range(10) for i in range(18)]
    panel = spark.createDataFrame(rows, "symbol string, month date, level double")
    out = P.xs_momentum(panel, [3], 2).orderBy("month").collect()
    assert all(r["ret"] == pytest.approx(0.08) for r in out)
    assert [r["turnover"] for r in out] == [1.0] + [0.0] * (len(out) - 1)


def test_panel_fill_and_drop(spark):
    days = [datetime(2024, 1, 1) + timedelta(days=i) for i in range(40)]
    rows = [("full", t, 1.0 + i) for i, t in enumerate(days)] + [("hole", t, 2.0) for i, t in enumerate(days) if i not in (5, 6)]
    rows += [("short", t, 3.0) for t in days[:10]]
    p = P.load_panel(spark.createDataFrame(rows, "symbol string, ts timestamp, close double"))
    assert {r["symbol"] for r in p.select("symbol").distinct().collect()} == {"full", "hole"}
    assert p.count() == 80


def test_value_book_is_neutral(spark):
    w = P.value_weights(spark.createDataFrame(
        [(f"s{j:02d}", datetime(2010 + i // 12, i % 12 + 1, 1).date(), 50 + j + 3 * math.sin(i * (j + 1))) for j in range(12) for i in range(80)],
        "symbol string, month date, level double"))
    g = w.groupBy("month").agg(F.sum("weight").alias("net"), F.sum(F.abs("weight")).alias("gross")).filter("gross > 0").collect()
    assert g and all(r["net"] == pytest.approx(0) and r["gross"] == pytest.approx(1) for r in g)


def test_walk_is_deterministic(spark):
    a, b = (col(walk_bars(spark, 5), "close") for _ in range(2))
    assert a == b


@pytest.mark.parametrize("trailing, daily, consistency", [(True, 1_000, 0.5), (False, None, None), (True, None, 0.3)])
def test_resampled_walk_equals_day_by_day(spark, trailing, daily, consistency):
    """Block summaries lose no event: against a plain loop over the same draws."""
    import hashlib

    rnd = random.Random(12)
    rets = [rnd.gauss(0.001, 0.012) for _ in range(90)] + [-1.5]
    rules = PA.Rules(50_000, 3_000, 2_000, trailing, daily, consistency, 2, 47)
    d = PA.with_period(spark.createDataFrame([("b", i, r) for i, r in enumerate(rets)], "book string, d int, ret double"), ["book"], ["d"])
    levels = [2.0, 1.0, 0.25, 0.05]
    paths = [sum((rets[s: s + 20] for s in (int(hashlib.md5(f"b:{p}:{b}".encode()).hexdigest()[:15], 16) % 71 for b in range(3))), [])[:47] for p in range(60)]

    def outcome(path, k):
        equity = high = 50_000.0
        best = 0.0
        for day, r in enumerate(path, 1):
            before, equity = equity, equity * max(1 + k * r, 0)
            if daily is not None and before - equity >= daily:
                return "daily_limit", day
            if equity <= (high - 2_000 if trailing else 48_000):
                return "max_loss", day
            high, best, profit = max(high, equity), max(best, equity - before), equity - 50_000
            if profit >= 3_000 and day >= 2 and (consistency is None or best <= consistency * profit):
                return "pass", day
        return "timeout", 47

    got = {(r["k"], r["path"]): (r["outcome"], r["days"]) for r in RS.walk(d, ["book"], rules, levels, 60).collect()}
    want = {(k, p): outcome(path, k) for k in levels for p, path in enumerate(paths)}
    assert got == want and len({o for o, _ in want.values()}) >= 3

    alive = pays = 0
    for path in paths:
        equity = high = 50_000.0
        died, wins = None, 0
        for day, r in enumerate(path, 1):
            before, equity = equity, equity * max(1 + r, 0)
            if died is None and equity <= ((50_000 if high >= 52_000 else high - 2_000) if trailing else 48_000):
                died = day
            wins += equity - before >= 150
            high = max(high, equity)
        alive += died is None
        pays += died is None and wins >= 5
    r = RS.survival(d, ["book"], rules, [1.0], 60, 47).first()
    assert (r["paths"], r["p_alive"], r["p_payable"]) == (60, pytest.approx(alive / 60), pytest.approx(pays / 60))


def test_a_sixth_configuration_is_aligned_too(spark):
    rnd = random.Random(8)
    rows = [(f"c{c}", d, rnd.gauss(0, 1)) for c in range(6) for d in range(40) if not (c == 5 and d % 4 == 0)] + [("c5", 0, None)]
    a = O.aligned(spark.createDataFrame(rows, "config string, t int, ret double"), "config", "t", "ret")
    assert {r["count"] for r in a.groupBy("t").count().collect()} == {6} and a.select("t").distinct().count() == 30
    assert O.pbo_splits(a, 4).count() == 6
