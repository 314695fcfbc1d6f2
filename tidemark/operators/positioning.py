"""Weekly positioning reports: features, market selection, joins at publication time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join

#: A Tuesday report is public from Friday 21:00 UTC.
RELEASE_LAG = "INTERVAL 3 DAYS 21 HOURS"

# Name fragments that identify each market, in order of preference.
MARKET_ALIASES = {
    "GC": ["GOLD - COMMODITY EXCHANGE"],
    "ES": ["E-MINI S&P 500 - CHICAGO MERCANTILE", "E-MINI S&P 500 STOCK INDEX"],
    "NQ": ["NASDAQ-100 STOCK INDEX (MINI)", "NASDAQ-100 CONSOLIDATED", "E-MINI NASDAQ-100", "NASDAQ MINI",
           "MICRO E-MINI NASDAQ-100"],
    "6E": ["EURO FX - CHICAGO MERCANTILE"],
    "CL": ["CRUDE OIL, LIGHT SWEET - NEW YORK MERCANTILE", "WTI-PHYSICAL", "CRUDE OIL, LIGHT SWEET"],
    "ZN": ["10-YEAR U.S. TREASURY NOTES", "UST 10Y NOTE"],
}


def select_market(rows: DataFrame, aliases: dict[str, list[str]], name: str = "market") -> DataFrame:
    """The exact name each code refers to: first alias that matches, then the shortest name.

    The aliases are a fixed short list carried as a literal, tested against the distinct names."""
    pairs = F.array(*[F.struct(F.lit(code).alias("code"), F.lit(i).alias("rank"), F.lit(a.lower()).alias("alias"))
                      for code, names in aliases.items() for i, a in enumerate(names)])
    hit = F.filter(pairs, lambda p: F.contains(F.lower(F.col(name)), p["alias"]))
    d = rows.select(name).distinct().withColumn("_h", F.explode(hit))
    return d.groupBy(F.col("_h.code").alias("code")).agg(
        F.min_by(name, F.struct(F.col("_h.rank").alias("r"), F.length(name).alias("l"), F.col(name).alias("n"))).alias(name))


def features(reports: DataFrame, weeks: int = 52, keys=("market",)) -> DataFrame:
    """Net positions, their share of open interest, place in the trailing range, four-week
    change, and when the report became public. One row per market and week."""
    w = Window.partitionBy(*keys).orderBy("as_of")
    tail = w.rowsBetween(-(weeks - 1), 0)
    d = reports
    for who in ("spec", "comm", "small"):
        d = d.withColumn(f"{who}_net", F.col(f"{who}_long") - F.col(f"{who}_short"))
    for who in ("spec", "comm"):
        net = F.col(f"{who}_net")
        lo, hi = F.min(net).over(tail), F.max(net).over(tail)
        seen = F.count(net).over(tail) >= weeks // 2
        d = (d.withColumn(f"{who}_net_pct", F.try_divide(net, F.col("oi")))
              .withColumn(f"{who}_net_index", F.when(seen, F.try_divide(net - lo, hi - lo))))
    return (d.withColumn("spec_net_chg4", F.col("spec_net") - F.lag("spec_net", 4).over(w))
            .withColumn("available_at", F.col("as_of").cast("timestamp") + F.expr(RELEASE_LAG)))


JOINED = ["spec_net_pct", "comm_net_pct", "spec_net_index", "comm_net_index", "spec_net_chg4"]


def join_to_bars(bars: DataFrame, feats: DataFrame, by: list[str], columns: list[str] | None = None) -> DataFrame:
    """The newest report already published at each bar."""
    columns = columns or JOINED
    right = feats.select(*by, "available_at", F.col("as_of").alias("cot_as_of"), *[F.col(c).alias(f"cot_{c}") for c in columns])
    return asof_join(bars, right, by, "ts", "available_at", calendar_bounded=True).drop("available_at")


def lagged_cross_asset(target: DataFrame, other: DataFrame, out: str) -> DataFrame:
    """The other asset's return of its previous day, known today, matched on the date."""
    w = Window.partitionBy(F.lit(1)).orderBy("_d")  # one daily series
    o = other.select(F.to_date("ts").alias("_d"), "close")
    o = o.withColumn("_r", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1.0)
    o = o.select("_d", F.lag("_r").over(w).alias(out))
    return target.withColumn("_d", F.to_date("ts")).join(o, "_d", "left").drop("_d")
