"""Market-shaped views over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prints(spark, sf_dir) -> DataFrame:
    """Trade prints: one per event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"))


def signed_prints(spark, sf_dir, with_previous: bool = False) -> DataFrame:
    return B.infer_side(prints(spark, sf_dir), with_previous=with_previous)


def bars(spark, sf_dir, freq: str = "1 hour") -> DataFrame:
    return B.ohlcv(prints(spark, sf_dir), freq)


def stored_bars(spark, sf_dir, freq: str = "1 hour") -> DataFrame:
    """The bar table as a job that reads it several times finds it: already built."""
    return materialize(bars(spark, sf_dir, freq))


def trades(spark, sf_dir) -> DataFrame:
    """One trade per line item that ships after its order date."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    px = F.col("l_extendedprice")
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .filter(F.col("l_shipdate") > F.col("o_orderdate"))
            .join(p, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("p_brand").alias("symbol"), F.col("l_returnflag").alias("sleeve"),
                F.col("o_orderpriority").alias("strategy"),
                F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("side"),
                F.col("l_quantity").alias("volume"),
                F.col("o_orderdate").cast("timestamp").alias("entry_ts"),
                F.col("l_shipdate").cast("timestamp").alias("exit_ts"),
                (px / F.col("l_quantity")).alias("entry_price"),
                (px * (F.col("l_discount") - 0.05)).alias("gross_pnl"),
                (px * F.col("l_tax") * 0.1).alias("costs"),
                (px * 0.02).alias("risk_cash")))


def panel(spark, sf_dir) -> DataFrame:
    """Monthly level per nation (long form)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    per_key = (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
               .groupBy("c_nationkey", F.trunc("o_orderdate", "MM").alias("month"))
               .agg(F.sum("o_totalprice").alias("level")))
    return (per_key.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("n_name").alias("symbol"), "month", "level"))


def specs(spark, sf_dir) -> DataFrame:
    """Contract constants and costs per traded symbol (brand), taken from the part table."""
    code = F.substring("symbol", -1, 1).cast("int")
    return (table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("symbol"))
            .agg(F.avg("p_size").alias("_size"), F.avg("p_retailprice").alias("_px"))
            .select("symbol", F.lit(2).alias("digits"), F.lit(0.01).alias("point"), F.lit(0.01).alias("tick_size"),
                    (F.floor("_size") / 100.0).alias("tick_value"), F.lit(1.0).alias("volume_min"),
                    F.lit(40.0).alias("volume_max"), F.lit(1.0).alias("volume_step"), F.lit(100.0).alias("contract_size"),
                    F.lit(5).alias("stops_level_points"), (code * -0.5).alias("swap_long"), (code * 0.25).alias("swap_short"),
                    code.alias("swap_mode"), F.when(code % 2 == 0, 2).otherwise(4).alias("swap_triple_weekday"),
                    (F.floor("_px") / 1000.0).alias("spread"), (F.floor("_px") / 2000.0).alias("slippage"),
                    F.lit(0.75).alias("commission"), F.lit(2.0).alias("spread_multiple_at_open")))


def daily_prices(spark, sf_dir) -> DataFrame:
    """Daily high and low unit price per brand."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    return (li.join(p, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("day"))
            .agg(F.max(px).alias("high"), F.min(px).alias("low")))


def snapshots(spark, sf_dir, start: float = 100_000.0) -> DataFrame:
    """Account equity snapshots: every event moves its account's equity."""
    from tidemark.functions import chunks
    order = ["ts", "seq"]
    p = prints(spark, sf_dir).withColumn("pnl", (F.col("price") - 45.0) * F.col("size"))
    c = chunks.ordered_chunks(p, ["symbol"], order)
    c = chunks.running_sum(c, ["symbol"], order, "pnl", "_run")
    return c.select(F.col("symbol").alias("account"), "ts", "seq", "pnl",
                    F.round(F.col("_run") + start, 6).alias("equity"))
