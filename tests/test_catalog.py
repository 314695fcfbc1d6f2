"""Every registered query against its SQL at the smallest size, and the shape of key plans."""

import sys

import duckdb
import pytest

sys.path.insert(0, "tools")
import __spark_entry__ as E  # noqa: E402
from tools.check import TABLES, rows_of  # noqa: E402

FAST = """delta_bars_1h flow_imbalance_1h open_imbalance validate_counts ema_atr asof_htf asof_prints_to_bars exact_median_price
screen_scores decompose_arms trend_events triple_barrier sample_weights purged_kfold psr pbo first_passage trade_metrics
consecutive_losses excursions swap_nights portfolio_stats limit_audit journal_digest stitch roll_bill vol_target
upsert_keep_last stream_delta_bars""".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, sf, con, name):
    df = E.queries()[name](spark, sf)
    cur = con.execute(E.oracle_sql()[name])
    want, cols = cur.fetchall(), [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, want)


def test_entry_and_registry(spark):
    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_used(spark, sf):
    p = plan(E.queries()["resample_4h"](spark, sf))
    read = [line for line in p.splitlines() if "ReadSchema" in line]
    assert read and all("user_id" not in line for line in read)


@pytest.mark.parametrize("name", ["trade_metrics", "limit_audit", "screen_scores", "excursions", "pbo", "vol_target", "decompose_arms"])
def test_no_product_joins(spark, sf, name):
    p = plan(E.queries()[name](spark, sf))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_contract_bars_hold_every_deal(spark, sf):
    from pyspark.sql import functions as F

    from tidemark.plans import q_futures

    want = spark.read.parquet(f"{sf}/lineitem.parquet").agg(F.sum("l_quantity")).first()[0]
    assert q_futures.contract_bars(spark, sf).agg(F.sum("volume")).first()[0] == want
