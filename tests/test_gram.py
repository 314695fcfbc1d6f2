"""Pair moments against plain enumeration, and correlations over members that are found."""

import itertools
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import gram
from tidemark.operators import trades as T
from tidemark.operators import voltarget as VT

VALUE = "g string, period long, member string, value double"


@pytest.fixture(scope="module")
def table():
    rnd = random.Random(9)
    return [(g, p, f"m{m}", rnd.choice([None, 0.0, rnd.gauss(100, 3)])) for g in "xy" for p in range(40) for m in range(11) if rnd.random() < 0.8] + [("x", 0, "late", 4.0), ("y", 1, "never", None)]


@pytest.mark.parametrize("tile, slab, every", [(256, 1024, False), (3, 7, False), (3, 7, True)])
def test_pair_moments(spark, table, tile, slab, every):
    got = {(r["g"], r["a"], r["b"]): r for r in gram.pair_moments(spark.createDataFrame(table, VALUE), ("g",), every, tile, slab).collect()}
    at = {(g, m, p): v for g, p, m, v in table if v is not None}
    members, want = sorted({r[2] for r in table}), {}
    for g in "xy":
        for a, b in itertools.combinations(members, 2):
            both = [(at[g, a, p], at[g, b, p]) for p in range(40) if (g, a, p) in at and (g, b, p) in at]
            if both or every:
                want[g, a, b] = [len(both), sum(x for x, _ in both), sum(y for _, y in both), sum(x * x for x, _ in both), sum(y * y for _, y in both), sum(x * y for x, y in both)]
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert [got[k][m] for m in gram.MOMENTS] == pytest.approx(v)


def test_moments_without_groups_and_without_rows(spark, table):
    d = spark.createDataFrame([r for r in table if r[0] == "x"], VALUE)
    one = {(r["a"], r["b"]): r["sxy"] for r in gram.pair_moments(d.drop("g"), every_pair=True).collect()}
    two = {(r["a"], r["b"]): r["sxy"] for r in gram.pair_moments(d, ("g",), tile=2, slab=5, every_pair=True).collect()}
    assert one == pytest.approx(two) and len(one) == 12 * 11 // 2
    assert gram.pair_moments(d.limit(0), ("g",)).count() == 0
    single = gram.pair_moments(d.filter("member = 'm1'"), ("g",))
    assert single.count() == 0


def test_correlation_keeps_its_digits_on_a_high_level(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(200, 3)) + 1e7
    rows = [("x", i, f"m{j}", float(x[i, j])) for i in range(200) for j in range(3)]
    d = gram.pair_moments(gram.centred(spark.createDataFrame(rows, VALUE).drop("g"))).withColumn("rho", gram.correlation())
    want = np.corrcoef(x.T)
    for r in d.collect():
        assert r["rho"] == pytest.approx(want[int(r["a"][1]), int(r["b"][1])], abs=1e-9)


def test_a_new_sleeve_and_a_new_market_appear(spark):
    rnd = random.Random(3)
    weeks = [date(2024, 1, 1) + timedelta(weeks=i) for i in range(30)]
    eq = spark.createDataFrame([(s, w, 100 + rnd.random()) for s in ("A", "N", "R", "Z") for w in weeks], "sleeve string, ts date, equity double")
    c = T.pairwise_correlation(T.sleeve_changes(eq, F.col("ts"), "sleeve"), "sleeve")
    assert sorted((r["a"], r["b"]) for r in c.collect()) == list(itertools.combinations("ANRZ", 2))
    r = T.diversification_ratio(c).first()
    assert r["ratio"] == pytest.approx((4 / (1 + 3 * r["mean_rho"])) ** 0.5)
    assert T.diversification_ratio(c.limit(0)).first()["ratio"] is None
    names = [f"Brand#{i}" for i in range(26)]
    day = date(2024, 6, 1)
    recent = spark.createDataFrame([(day, day - timedelta(days=i), n, rnd.gauss(0, 1) if n != names[7] else None) for i in range(20) for n in names],
                                   "decision_day date, day date, symbol string, cash double")
    got = {(r["a"], r["b"]): r["rho"] for r in VT.shrunk_correlation(recent).collect()}
    assert len(got) == 26 * 25 // 2 and all(v == 0 for k, v in got.items() if names[7] in k)


def test_plan_does_not_grow_with_the_number_of_pairs(spark):
    size = lambda n: len(gram.pair_moments(spark.range(n * 4).selectExpr("id % 4 AS period", "concat('m', id % {}) AS member".format(n), "1.0 AS value"))
                         ._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(46) - size(5)) < 200
