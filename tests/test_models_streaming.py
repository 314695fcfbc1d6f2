import random
from datetime import datetime, timedelta

import pytest
from helpers import walk_bars
from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.operators import folds as FO
from tidemark.operators import models as M
from tidemark.streaming import jobs, ordered


def test_regimes_name_every_complete_row(spark):
    f = I.regime_features(walk_bars(spark, 500), rank=60).select("ts", *I.REGIME_COLUMNS)
    p = M.fit_regimes(f, max_iter=20).predict(f)
    assert p.count() == 500
    assert p.filter("regime = 'unknown'").count() == f.count() - f.dropna().count()
    with pytest.raises(ValueError):
        M.fit_regimes(f.limit(100))


def test_meta_model_learns_and_refuses(spark):
    rnd = random.Random(0)
    rows = [(i, i + 2, x := rnd.random(), int(rnd.random() < (0.85 if x > 0.5 else 0.15))) for i in range(500)]
    d = spark.createDataFrame(rows, "t0 long, t1 long, x double, label int")
    folds = FO.purged_kfold(d, [], ["t0"], 3, 0.01).cache()
    m = M.fit_meta(folds, ["x"], max_iter=5)
    r = M.evaluate(M.out_of_fold(folds, m)).first()
    assert r["n"] == 500 and r["auc"] > 0.75 and r["brier"] < r["brier_base"]
    assert 0 <= m.probability(d).agg(F.min("p")).first()[0] <= 1
    with pytest.raises(ValueError, match="purged"):
        M.fit_meta(d, ["x"])
    with pytest.raises(ValueError, match="minimum"):
        M.fit_meta(folds.filter("t0 < 60"), ["x"])
    with pytest.raises(ValueError, match="one class"):
        M.fit_meta(folds.withColumn("label", F.lit(1)), ["x"])


def test_meta_model_finds_no_skill_in_noise(spark):
    rnd = random.Random(3)
    rows = [(i, i + 2, rnd.random(), rnd.randrange(2)) for i in range(900)]
    folds = FO.purged_kfold(spark.createDataFrame(rows, "t0 long, t1 long, x double, label int"), [], ["t0"], 3, 0.01).cache()
    r = M.evaluate(M.out_of_fold(folds, M.fit_meta(folds, ["x"], max_iter=5))).first()
    assert r["brier"] >= r["brier_base"] and abs(r["auc"] - 0.5) < 0.06


def test_stream_bars_drop_late_prints_and_keep_open_bars_back(spark, tmp_path):
    t0 = datetime(2026, 1, 5)
    schema = "symbol string, ts timestamp, seq long, price double, size double, side int"
    for n, mins in enumerate([(0, 1, 6, 30), (31,), (2, 60)]):  # minute 2 is late by then
        d = spark.createDataFrame([("A", t0 + timedelta(minutes=m), 10 * n + i, 1.0 + m, 1.0, 1) for i, m in enumerate(mins)], schema)
        d.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.drain(jobs.delta_bars(s, "5 minutes", "10 minutes")).orderBy("ts").collect()
    assert [(r["ts"].minute, r["prints"]) for r in out] == [(0, 2), (5, 1), (30, 2)]


BOOK = "account string, seq long, ts timestamp, equity double, pnl double"


def batches(spark, path, rows_of_each, schema):
    """One file, and with it one micro-batch, per list of rows."""
    for rows in rows_of_each:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_open_windows_are_added_at_the_end(spark, tmp_path):
    t0 = datetime(2026, 1, 5)
    rows = [[("A", t0 + timedelta(minutes=m), m, 1.0 + m, 2.0, 1 if m % 2 else -1) for m in part] for part in [(0, 1, 6, 30), (31, 25), (62, 64)]]
    s = batches(spark, str(tmp_path / "in"), rows, "symbol string, ts timestamp, seq long, price double, size double, side int")
    job = jobs.delta_windows(s, "5 minutes", "10 minutes")
    r = {x["ts"].hour * 60 + x["ts"].minute: x for x in jobs.complete(job).collect()}
    assert {k: (x["open"], x["high"], x["low"], x["close"], x["volume"], x["prints"], x["delta"]) for k, x in r.items()} == {
        0: (1, 2, 1, 2, 4, 2, 0), 5: (7, 7, 7, 7, 2, 1, -2), 25: (26, 26, 26, 26, 2, 1, 2), 30: (31, 32, 31, 32, 4, 2, 0), 60: (63, 65, 63, 65, 4, 2, -4)}
    seen = []
    jobs.complete(jobs.delta_windows(s, "5 minutes", "10 minutes"), batch=lambda d, i: seen.append((i, d.count())))
    assert seen[-1] == (-1, 1) and sum(n for _, n in seen) == 5


def test_open_sessions_and_means_are_added_at_the_end(spark, tmp_path):
    t0 = datetime(2026, 1, 5)
    rows = [[("r", "heartbeat", t0 + timedelta(minutes=m), float(m)) for m in part] for part in [(0, 5, 30), (32, 50)]]
    s = batches(spark, str(tmp_path / "j"), rows, "runner string, event string, ts timestamp, feed_age_s double")
    r = jobs.complete(jobs.heartbeat_sessions(s, "10 minutes", "5 minutes")).orderBy("first_beat").collect()
    assert [(x["first_beat"].minute, x["last_beat"].minute, x["beats"], x["feed_age_max"]) for x in r] == [(0, 5, 2, 5.0), (30, 32, 2, 32.0), (50, 50, 1, 50.0)]
    q = [[("A", t0 + timedelta(minutes=m), t0 + timedelta(minutes=m, seconds=age), sp, 0.5) for m, age, sp in part]
         for part in [[(0, 1, 1.0), (1, 1, 3.0), (2, 900, 50.0)], [(61, 0, 4.0), (62, 0, None)]]]
    s = batches(spark, str(tmp_path / "q"), q, "symbol string, ts timestamp, ingest_ts timestamp, spread double, point double")
    r = jobs.complete(jobs.quote_profile(s, 60, "10 minutes")).orderBy("ts").collect()
    assert [(x["samples"], x["mean_spread"], x["max_spread"], x["mean_points"]) for x in r] == [(2, 2.0, 3.0, 4.0), (2, 4.0, 4.0, 8.0)]


def test_a_late_row_of_a_later_batch_counts_in_its_place(spark, tmp_path):
    t0 = datetime(2026, 1, 5, 22)
    rnd = random.Random(4)
    rows = [(a, 100 * k + i, t0 + timedelta(minutes=13 * i), 100.0 + rnd.randrange(60), float(rnd.randrange(-2, 2))) for k, a in enumerate("ab") for i in range(40)]
    # rows of one hour come in any order, over several batches
    shuffled = sorted(rows, key=lambda r: (r[2] - t0).total_seconds() + rnd.random() * 3000)
    parts = [shuffled[i: i + 16] for i in range(0, len(shuffled), 16)]
    s = batches(spark, str(tmp_path / "in"), parts, BOOK)
    got = {x["seq"]: tuple(x)[2:] for x in jobs.complete(ordered.session_book(s, 95.0, "1 hour", width=600_000)).collect()}
    want = {}
    for a in "ab":
        day, opened, high, streak = None, 0, 95.0, 0
        for _, seq, ts, equity, pnl in sorted((r for r in rows if r[0] == a), key=lambda r: r[2:0:-1]):
            if ts.date() != day:
                day, opened = ts.date(), equity
            high, streak = max(high, equity), streak + 1 if pnl < 0 else 0
            want[seq] = (equity, opened, high, streak)
    assert got == want


def test_allocator_keeps_its_window_between_buckets(spark, tmp_path):
    t0 = datetime(2026, 1, 5)
    rnd = random.Random(6)
    closes = [100 + rnd.random() for _ in range(30)]
    rows = [("A", t0 + timedelta(hours=i), c, 2.0) for i, c in enumerate(closes)]
    order = [*rows[:8], rows[9], rows[8], *rows[10:]]
    s = batches(spark, str(tmp_path / "in"), [order[:9], order[9:20], order[20:]], "symbol string, ts timestamp, close double, value_per_unit double")
    r = jobs.complete(ordered.allocator_feed(s, 7, "3 hours", width=7_200_000)).orderBy("ts").collect()
    change = [2 * (b - a) for a, b in zip(closes, closes[1:])]
    assert [x["cash"] for x in r] == pytest.approx(change)
    assert [x["history"] for x in r] == [min(i + 1, 7) for i in range(29)]
    assert r[0]["sigma"] is None
    import statistics
    assert [x["sigma"] for x in r[1:]] == pytest.approx([statistics.stdev(change[max(0, i - 6): i + 1]) for i in range(1, 29)])


def test_silent_feeds_alert_and_alert_again(spark, tmp_path):
    t0 = datetime(2026, 1, 5)
    at = {"A": [0, 10, 20, 95, 100, 400], "B": [0, 5, 200, 400], "C": [1]}
    rows = sorted((t0 + timedelta(minutes=m), k) for k, ms in at.items() for m in ms)
    parts = [[(k, t) for t, k in rows[i: i + 3]] for i in range(0, len(rows), 3)]
    s = batches(spark, str(tmp_path / "in"), parts, "symbol string, ts timestamp")
    job = ordered.feed_silence(s, 30 * 60, 45 * 60, "10 minutes", forget_seconds=150 * 60, width=600_000)
    got = sorted((x["symbol"], x["status"], (x["silent_from"] - t0).seconds // 60, (x["noted_at"] - t0).seconds // 60, x["seconds"]) for x in jobs.complete(job).collect())
    want = []
    for k, ms in at.items():
        for a, b in zip(ms, [*ms[1:], None]):
            end = a + 150 if b is None else min(b, a + 150)
            due = [x for x in range(a + 30, end, 45) if b is not None or (x // 10 + 1) * 10 <= 390]
            want += [(k, "silent", a, x, 60.0 * (x - a)) for x in due]
            if due and b is not None and b < a + 150:
                want.append((k, "returned", a, b, 60.0 * (b - a)))
    assert got == sorted(want)
    with pytest.raises(ValueError):
        ordered.feed_silence(s, 0, 1, "1 minute")


def test_a_feed_that_stops_alerts_while_it_is_silent(spark, tmp_path):
    """The clock alone raises the alerts: no row arrives while they are given."""
    import time

    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda *names: spark.createDataFrame([(n,) for n in names], "symbol string").coalesce(1).write.mode("append").parquet(path)
    put("A", "B")
    watch = ordered.feed_watch(spark.readStream.schema("symbol string").parquet(path), 1.0, 4.0)
    q = (watch.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="300 milliseconds")
         .format("parquet").option("path", out).start())
    try:
        read = lambda: spark.read.schema(watch.schema).parquet(out).collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
        until = time.time() + 90
        count = lambda name, status: sum(r["symbol"] == name and r["status"] == status for r in read())
        while time.time() < until and count("B", "silent") < 2:
            time.sleep(0.5)
        put("A")
        while time.time() < until and count("A", "returned") < 1:
            time.sleep(0.5)
    finally:
        q.stop()
    r = read()
    silent = sorted(x["noted_at"] for x in r if x["symbol"] == "B" and x["status"] == "silent")
    assert len(silent) >= 2 and all((b - a).total_seconds() >= 3.9 for a, b in zip(silent, silent[1:]))
    assert count("A", "returned") == 1 and count("B", "returned") == 0
    assert all(x["seconds"] >= 1.0 for x in r)
