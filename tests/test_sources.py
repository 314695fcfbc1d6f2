import json
from datetime import datetime

import pytest
from helpers import close_bars
from pyspark.sql import functions as F

from tidemark.operators.quality import DataError
from tidemark.sources import bars as SB
from tidemark.sources import files as SF


def test_upsert_is_idempotent_and_incoming_wins(spark, tmp_path):
    path = str(tmp_path / "bars")
    b = close_bars(spark, [1 + 0.01 * (i % 3) for i in range(400)])
    assert SB.upsert_bars(spark, path, b, "D1") == 400
    assert SB.upsert_bars(spark, path, b, "D1") == 0
    fix = b.filter("ts >= '2025-01-01'").withColumn("close", F.col("high"))
    more = close_bars(spark, [2.0, 2.1], "B")
    assert SB.upsert_bars(spark, path, fix.unionByName(more), "D1") == 2
    d = SB.read_bars(spark, path, "A", "D1")
    assert d.count() == 400 and d.filter("close = high").count() == fix.count()
    assert SB.last_timestamp(spark, path, "A", "D1") == b.agg(F.max("ts")).first()[0]
    assert SB.last_timestamp(spark, path, "Z", "D1") is None
    part = SB.read_bars(spark, path, "A", "D1", datetime(2024, 12, 30), datetime(2025, 1, 2))
    assert part.count() == 4
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "year" in plan.split("PartitionFilters")[1].split("]")[0]
    with pytest.raises(DataError):
        SB.upsert_bars(spark, path, b, "M7")


def test_missing_store_reads_empty(spark, tmp_path):
    assert SB.read_bars(spark, str(tmp_path / "none")).count() == 0


def test_cot_csv(spark, tmp_path):
    p = tmp_path / "c.csv"
    head = ",".join(f'"{c} "' for c in SF.COT_COLUMNS) + ',"Extra"'
    p.write_text(head + '\n"GOLD - COMMODITY EXCHANGE INC. ","2024-01-02",500,300,80,1,2,3,4,x\n"GOLD SPREAD","bad",1,1,1,1,1,1,1,x\n"ES","2024-01-09",.,2,3,4,5,6,7,x\n')
    r = SF.read_cot_csv(spark, str(p)).orderBy("as_of").collect()
    assert len(r) == 2 and r[0]["market"] == "GOLD - COMMODITY EXCHANGE INC." and r[0]["spec_long"] == 300.0 and r[1]["oi"] is None
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(DataError):
        SF.read_cot_csv(spark, str(bad))
    store = str(tmp_path / "cot")
    d = SF.read_cot_csv(spark, str(p))
    SF.upsert_cot(spark, store, "GC", d.limit(1))
    SF.upsert_cot(spark, store, "ES", d)
    SF.upsert_cot(spark, store, "ES", d.withColumn("oi", F.lit(9.0)))
    assert SF.read_cot(spark, store).count() == 3 and {x["oi"] for x in SF.read_cot(spark, store, "ES").collect()} == {9.0}


def test_specs_and_fills_json(spark, tmp_path):
    s = tmp_path / "specs.json"
    s.write_text(json.dumps({"EURUSD": {"digits": 5, "point": 1e-5, "spread_pts": 2.0}, "GBPUSD": {"digits": 5, "point": 1e-5, "spread_pts": None}}, indent=1))
    specs = SF.read_specs(spark, str(s))
    costs = SF.measured_costs(specs).collect()
    assert len(costs) == 1 and costs[0]["spread"] == pytest.approx(2e-5) and costs[0]["slippage"] == pytest.approx(1e-5)
    with pytest.raises(Exception, match="no measured spread for GBPUSD"):
        SF.measured_costs(specs, specs.select("symbol")).collect()
    f = tmp_path / "fills.json"
    f.write_text(json.dumps({"A": [{"leg": "in", "spread": 0.1, "slippage": 0.02, "ts": "2024-01-01T00:00:00"}, {"leg": "out", "spread": 0.2, "slippage": None, "ts": ""}]}))
    fills = SF.read_fills(spark, str(f))
    assert fills.count() == 2 and fills.filter("ts IS NULL").count() == 1
    SF.append_fills(fills, str(tmp_path / "log"))
    SF.append_fills(fills, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_spread_samples_skip_bad_lines(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    p.write_text('{"ts":"2024-01-01T00:00:00","symbol":"A","bid":1.0,"ask":1.1,"spread":0.1}\n{"ts": oops\n')
    assert SF.read_spread_samples(spark, str(p)).count() == 1


def test_verdicts(spark, tmp_path):
    (tmp_path / "010.json").write_text(json.dumps({"passed": False, "book": {"net_sharpe": 0.28, "max_drawdown": 0.3}, "verdict": [{"test": "1", "pass": True, "detail": "x"}, {"test": "2", "pass": False, "detail": "y"}]}, indent=1))
    (tmp_path / "015a.json").write_text(json.dumps({"passed": False, "net_sharpe": -0.35, "max_drawdown": 0.5}))
    r = SF.read_verdicts(spark, str(tmp_path)).orderBy("run", "test").collect()
    assert [(x["run"], x["net_sharpe"], x["test"], x["pass"]) for x in r] == [("010", 0.28, "1", True), ("010", 0.28, "2", False), ("015a", -0.35, None, None)]


def test_contract_tables_quarantine_bad_months(spark, tmp_path):
    rows = [("CL", 2024, m, datetime(2024, 1, d), -37.0, -36.0, -38.0 if m == 5 else -30.0, -37.0, 1.0) for m in (5, 6) for d in (2, 3)]
    b = spark.createDataFrame(rows, "root string, year int, month int, ts timestamp, open double, high double, low double, close double, volume double")
    path = str(tmp_path / "contracts")
    SF.write_contracts(b, path)
    assert {r["month"] for r in SF.read_contracts(spark, path).collect()} == {5}
    assert {r["month"] for r in SF.read_contracts(spark, path, SF.REFUSED).collect()} == {6}
    assert SF.read_expiries(spark, path, "MCL", {"MCL": "CL"}).count() == 2
    SF.write_contracts(b.where("month = 6"), path)  # replaced as a whole; none of it is accepted
    assert SF.read_contracts(spark, path).count() == 0 and SF.read_contracts(spark, path, SF.REFUSED).count() == 2
    SF.write_contracts(b.where("false"), path)
    assert SF.read_contracts(spark, path).count() == 0 == SF.read_contracts(spark, path, SF.REFUSED).count()
    one = str(tmp_path / "files" / "NG" / "202405.parquet")
    b.filter("month = 5").drop("root", "year", "month").write.parquet(str(tmp_path / "stage"))
    import glob, os, shutil
    os.makedirs(os.path.dirname(one))
    shutil.copy([g for g in glob.glob(str(tmp_path / "stage" / "*.parquet"))][0], one)
    assert SF.read_expiry_files(spark, str(tmp_path / "files" / "*")).select("root", "year", "month").first() == ("NG", 2024, 5)


def test_prints_keep_only_known_aggressors(spark, tmp_path):
    raw = spark.createDataFrame([("ESZ5", datetime(2024, 1, 1), i, 1.0, 1.0, a) for i, a in enumerate(["A", "B", "N", None])],
                                "contract string, ts timestamp, seq long, price double, size double, aggressor string")
    kept, dropped = SF.ingest_prints(raw)
    assert [r["side"] for r in kept.orderBy("seq").collect()] == [1, -1] and dropped.first()["dropped_share"] == 0.5
    SF.write_prints(kept, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_trade_and_equity_sinks(spark, tmp_path):
    SF.write_trades(close_bars(spark, [1, 2]), str(tmp_path / "t"))
    SF.write_equity(close_bars(spark, [1, 2]).select(F.lit("b").alias("book_id"), "ts", F.col("close").alias("equity")), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 and spark.read.parquet(str(tmp_path / "e")).columns == ["ts", "equity", "book_id"]


def rows_of(spark, path):
    return sorted(tuple(r) for r in SB.read_bars(spark, path).select("symbol", "ts", "close").collect())


def test_a_job_that_dies_leaves_the_old_table(spark, tmp_path, monkeypatch):
    """Killed while files are written, or after that and before the manifest is swapped."""
    path = str(tmp_path / "bars")
    b = close_bars(spark, [1.0 + i for i in range(30)])
    SB.upsert_bars(spark, path, b, "D1")
    old = rows_of(spark, path)
    change = b.withColumn("close", F.lit(1.5)).withColumn("open", F.lit(1.5)).withColumn("low", F.lit(1.0)).withColumn("high", F.lit(99.0))

    from tidemark.sources import snapshots as SN
    real = SN.merge
    dies = F.udf(lambda x: 1 / 0, "double")
    monkeypatch.setattr(SN, "merge", lambda *a: real(*a).withColumn("close", F.when(F.col("ts") > "2024-01-20", dies("close")).otherwise(F.col("close"))))
    with pytest.raises(Exception, match="division by zero"):
        SB.upsert_bars(spark, path, change, "D1")
    assert rows_of(spark, path) == old
    monkeypatch.setattr(SN, "merge", real)

    def killed(*a):
        raise KeyboardInterrupt

    swap = SN.swap
    monkeypatch.setattr(SN, "swap", killed)
    with pytest.raises(KeyboardInterrupt):
        SB.upsert_bars(spark, path, change, "D1")
    assert rows_of(spark, path) == old and SN.versions(spark, path) == [1]
    monkeypatch.setattr(SN, "swap", swap)

    assert SB.upsert_bars(spark, path, change.limit(5), "D1") == 0
    new = rows_of(spark, path)
    assert new != old and len(new) == 30 and SN.versions(spark, path) == [1, 2]
    assert SN.read(spark, path, SB.schemas.BARS, 1).count() == 30
    writes = len(list((tmp_path / "bars").glob("write=*")))
    gone = SN.vacuum(spark, path)
    assert len(list((tmp_path / "bars").glob("write=*"))) < writes and len(gone) >= 3
    assert rows_of(spark, path) == new and SN.versions(spark, path) == [2]
    with pytest.raises(DataError):
        SN.read(spark, path, SB.schemas.BARS, 1)


def test_two_writers_of_one_version(spark, tmp_path):
    from tidemark.sources import snapshots as SN

    path = str(tmp_path / "t")
    SN.swap(spark, path, {}, 1)
    with pytest.raises(DataError, match="another job"):
        SN.swap(spark, path, {"a=1": "x"}, 1)
    assert SN.manifest(spark, path) == {}


def test_an_upsert_reads_its_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def touch(x):
        seen.add(1)
        return x

    b = close_bars(spark, [1.0 + i for i in range(20)]).withColumn("volume", F.udf(touch, "double")("volume"))
    SB.upsert_bars(spark, str(tmp_path / "b"), b, "D1")
    assert seen.value == 20


def test_streamed_journal_sets_cut_lines_aside(spark, tmp_path):
    from tidemark.streaming import jobs
    folder = tmp_path / "journal"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"ts":"2024-01-01T01:00:00Z","event":"heartbeat","equity":1.5}\n\n{"ts":"2024-01-01T02:00')
    (folder / "b.jsonl").write_text('{"ts":"2024-01-01T03:00:00Z","event":"fill"}\n{"equity":2.0}\n   \n[1, 2]\n')
    for files in (1, 8):
        good, bad = SF.split_records(jobs.drain(jobs.journal_source(spark, str(folder), files)))
        assert {(r.event, r.equity) for r in good.collect()} == {("heartbeat", 1.5), ("fill", None)}
        assert {r.line for r in bad.collect()} == {'{"ts":"2024-01-01T02:00', '{"equity":2.0}', "[1, 2]"}
    assert SF.read_journal(spark, str(folder)).count() == 2
    assert SF.read_journal(spark, str(folder), limit=1).first().event == "fill"
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "a.jsonl").write_text("")
    assert SF.read_journal(spark, str(empty)).count() == 0


def test_quantiles_of_many_columns_share_their_pass(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tidemark.operators import quantiles as Q
    d = spark.range(3000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 > 0, F.sin("id") * F.exp(F.col("id") % 11)).alias("x"),
                                 F.when(F.col("id") % 3 != 2, (F.col("id") * 37 % 101).cast("double")).alias("y")).cache()
    wanted = {"x50": ("x", 0.5), "x95": (F.col("x"), 0.95), "y10": ("y", 0.1), "high": (F.when(F.col("y") > 50, F.col("y")), 0.5)}
    pdf = d.toPandas()
    for keys, groups in ((["k"], dict(list(pdf.groupby("k")))), ([], {None: pdf})):
        got = {r["k"] if keys else None: r for r in Q.exact_quantiles(d, keys, wanted).collect()}
        assert set(got) == set(groups)
        for key, g in groups.items():
            high = g.y.where(g.y > 50)
            for out, (col, q) in {"x50": (g.x, 0.5), "x95": (g.x, 0.95), "y10": (g.y, 0.1), "high": (high, 0.5)}.items():
                if col.notna().any():
                    assert np.isclose(got[key][out], col.quantile(q))
                else:
                    assert got[key][out] is None
    exchanges = lambda q: q._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(Q.exact_quantiles(d, ["k"], wanted)) * 2 < len(wanted) * exchanges(Q.exact_quantile(d, ["k"], "x", 0.5, "x50"))
    assert Q.exact_quantiles(d.where("false"), [], wanted).collect()[0]["x50"] is None
