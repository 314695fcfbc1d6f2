"""Chunked running functions must equal plain windows, also when one key holds most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import chunks
from tidemark.operators import quantiles
from tidemark.operators.asof import asof_join


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.8 else f"k{rnd.randrange(4)}", i, rnd.choice([None, 1.0, -1.0, rnd.random() * 50]))
            for i in range(3000)]
    return spark.createDataFrame(rows, "k string, i long, v double").repartition(5).cache()


@pytest.mark.parametrize("name", ["lag", "last", "sum", "max", "row_number"])
def test_running_functions(skewed, name):
    w = Window.partitionBy("k").orderBy("i")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    want = {"lag": F.lag("v").over(w), "last": F.last("v", True).over(run), "sum": F.sum(F.coalesce("v", F.lit(0.0))).over(run),
            "max": F.max("v").over(run), "row_number": F.row_number().over(w)}[name]
    c = chunks.ordered_chunks(skewed, ["k"], ["i"], parts=7)
    fn = {"lag": lambda: chunks.running_lag(c, ["k"], ["i"], "v", "got"),
          "last": lambda: chunks.running_last(c, ["k"], ["i"], "v", "got"),
          "sum": lambda: chunks.running_sum(c, ["k"], ["i"], F.coalesce("v", F.lit(0.0)), "got"),
          "max": lambda: chunks.running_max(c, ["k"], ["i"], "v", "got"),
          "row_number": lambda: chunks.running_row_number(c, ["k"], ["i"], "got")}[name]()
    got = {r["i"]: r["got"] for r in fn.collect()}
    exp = {r["i"]: r["x"] for r in skewed.withColumn("x", want).collect()}
    assert len(got) == len(exp)
    for i, x in exp.items():
        assert got[i] == (pytest.approx(x) if isinstance(x, float) else x)


def test_hot_key_is_split(skewed):
    c = chunks.ordered_chunks(skewed, ["k"], ["i"], parts=8)
    sizes = [r["count"] for r in c.groupBy("_chunk").count().collect()]
    assert max(sizes) < 0.3 * skewed.count()


def test_array_split_blocks(spark):
    d = spark.range(1, 11).select(chunks.array_split_id(F.col("id"), F.lit(10), 4).alias("b"))
    assert [r["b"] for r in d.collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_exact_quantile(skewed, q):
    got = {r["k"]: r["x"] for r in quantiles.exact_quantile(skewed, ["k"], "v", q, "x").collect()}
    want = {r["k"]: r["x"] for r in skewed.groupBy("k").agg(F.percentile("v", q).alias("x")).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_exact_median_over_magnitudes(spark):
    vals = [-1e12, -3.5, -1e-9, 0.0, 1e-9, 2.25, 7e7, 8e7]
    d = spark.createDataFrame([(v,) for v in vals], "v double")
    assert quantiles.exact_median(d, [], "v", "m").first()["m"] == pytest.approx(5e-10)


@pytest.mark.parametrize("bounded", [True, False])
def test_asof_matches_search(spark, bounded):
    rnd = random.Random(3)
    left = [("a" if rnd.random() < 0.9 else "b", i, rnd.randrange(1000)) for i in range(400)]
    right = [(k, t, None if t % 5 == 0 else float(t)) for k in "ab" for t in sorted(rnd.sample(range(1000), 60))]
    l = spark.createDataFrame(left, "k string, id int, t int")
    r = spark.createDataFrame(right, "k string, rt int, v double")
    got = {x["id"]: (x["rt"], x["v"]) for x in asof_join(l, r, ["k"], "t", "rt", bounded).collect()}
    for k, i, t in left:
        past = [(rt, v) for kk, rt, v in right if kk == k and rt <= t]
        assert got[i] == (max(past) if past else (None, None))


def test_time_order_is_cut_at_the_clock_and_bursts_by_range(spark, monkeypatch):
    from datetime import datetime, timedelta
    rows = [("a", datetime(2024, 1, 1) + timedelta(minutes=7 * i), i, float(i % 13)) for i in range(800)] + [("a", None, -1, 5.0)]
    d = spark.createDataFrame(rows, "k string, ts timestamp, seq int, v double")
    want = {}
    top = None
    for k, ts, seq, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or datetime.min, r[2])):
        top = v if top is None else max(top, v)
        want[seq] = top
    for limit, n_chunks in ((4_000_000, 5), (100, 95), (0, None)):
        monkeypatch.setattr(chunks, "CELL_ROWS", limit)
        c, fixed = chunks.cut(d, ["k"], ["ts", "seq"])
        assert fixed == (n_chunks is not None)
        c = chunks.ordered_chunks(d, ["k"], ["ts", "seq"])
        if fixed:
            assert c.select("_chunk").distinct().count() == n_chunks
        got = {r["seq"]: r["m"] for r in chunks.running_max(c, ["k"], ["ts", "seq"], "v", "m").collect()}
        assert got == want


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("kind", ["sum", "max", "last"])
def test_prefix_tree(spark, keys, kind):
    """Chunk numbers far apart, negative ones and ones that share a run at every level."""
    rnd = random.Random(7)
    rows = [(f"k{i % 3}" if keys else "k", at, rnd.choice([None, 1, 5, -3, 8]))
            for i, at in enumerate({rnd.choice([-(1 << 50), 0, 4090, 1 << 24, (1 << 36) + 4000]) + rnd.randrange(9000) for _ in range(900)})]
    rows = list({(k, at): (k, at, v) for k, at, v in rows}.values())
    got = {(r["k"], r["at"]): r["before"] for r in chunks._exclusive(spark.createDataFrame(rows, "k string, at long, v long"), keys, "at", "v", kind, "before").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        seen = []
        for _, at, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            want[k, at] = ({"sum": sum, "max": max, "last": lambda x: x[-1]}[kind](seen)) if seen else None
            seen += [v] if v is not None else []
    assert got == want


def test_positions_without_keys_need_no_window_over_all_rows(spark, monkeypatch):
    """Forced cells of one second: as many chunk summaries as there are seconds with rows."""
    from datetime import datetime, timedelta

    from tidemark.operators import folds

    monkeypatch.setattr(chunks, "CELL_SECONDS", (1,))
    t0 = datetime(2026, 1, 1)
    rows = [(t0 + timedelta(seconds=37 * i % 9001), i) for i in range(2000)]
    obs = spark.createDataFrame(rows, "ts timestamp, id long").withColumn("t0", F.unix_timestamp("ts")).withColumn("t1", F.col("t0") + 40)
    pos = folds.positions(obs, [], ["ts", "id"])
    assert [(r["id"], r["pos"], r["n_obs"]) for r in pos.orderBy("pos").collect()] == [(i, n + 1, 2000) for n, (_, i) in enumerate(sorted(rows))]
    f = folds.purged_kfold(obs, [], ["ts", "id"], 4, 0.0).filter("role = 'test'").groupBy("fold").count().collect()
    assert {r["fold"]: r["count"] for r in f} == dict.fromkeys(range(4), 500)
    assert folds.combinatorial(obs, [], ["ts", "id"], 4, 2).filter("role = 'test'").count() == 6 * 1000
    # the only window without a partition stands over runs of runs of chunks
    plan = pos._jdf.queryExecution().optimizedPlan().toString()
    loose = [line for line in plan.splitlines() if "Window [" in line and line.rstrip().endswith("ASC NULLS FIRST]") and "], [" not in line]
    assert all("_chunk__" in line for line in loose)
