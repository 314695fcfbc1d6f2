"""Futures contracts: calendar, front month, symbol parsing, continuous series, roll costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as K
from tidemark.functions.scalars import MONTH_CODES, contract_code

EVERY_MONTH = list(range(1, 13))
# Contract families. root, multiplier, tick, months, expiry rule, roll days before
# the anchor, commission per side, sector, first-notice rule.
ROOTS = [
    ("ES", 50, 0.25, [3, 6, 9, 12], "third_friday", 5, 2.5, "us_indices", None),
    ("NQ", 20, 0.25, [3, 6, 9, 12], "third_friday", 5, 2.5, "us_indices", None),
    ("YM", 5, 1, [3, 6, 9, 12], "third_friday", 5, 2.5, "us_indices", None),
    ("RTY", 50, 0.1, [3, 6, 9, 12], "third_friday", 5, 2.5, "us_indices", None),
    ("ZT", 2000, 0.00390625, [3, 6, 9, 12], "last_busday", 3, 1.5, "rates", "prior_month_end"),
    ("ZF", 1000, 0.0078125, [3, 6, 9, 12], "last_busday", 3, 1.5, "rates", "prior_month_end"),
    ("ZN", 1000, 0.015625, [3, 6, 9, 12], "treasury", 3, 1.5, "rates", "prior_month_end"),
    ("ZB", 1000, 0.03125, [3, 6, 9, 12], "treasury", 3, 1.5, "rates", "prior_month_end"),
    ("UB", 1000, 0.03125, [3, 6, 9, 12], "treasury", 3, 1.5, "rates", "prior_month_end"),
    ("6E", 125000, 0.00005, [3, 6, 9, 12], "fx", 5, 2.5, "usd_majors", None),
    ("6J", 12500000, 0.0000005, [3, 6, 9, 12], "fx", 5, 2.5, "usd_majors", None),
    ("6B", 62500, 0.0001, [3, 6, 9, 12], "fx", 5, 2.5, "usd_majors", None),
    ("6A", 100000, 0.00005, [3, 6, 9, 12], "fx", 5, 2.5, "usd_majors", None),
    ("6C", 100000, 0.00005, [3, 6, 9, 12], "fx", 5, 2.5, "usd_majors", None),
    ("6S", 125000, 0.0001, [3, 6, 9, 12], "fx", 5, 2.5, "usd_majors", None),
    ("6N", 100000, 0.00005, [3, 6, 9, 12], "fx", 5, 2.5, "usd_majors", None),
    ("GC", 100, 0.1, [2, 4, 6, 8, 10, 12], "metals", 5, 2.5, "metals", "prior_month_end"),
    ("SI", 5000, 0.005, [3, 5, 7, 9, 12], "metals", 5, 2.5, "metals", "prior_month_end"),
    ("HG", 25000, 0.0005, [3, 5, 7, 9, 12], "metals", 5, 2.5, "metals", "prior_month_end"),
    ("PL", 50, 0.1, [1, 4, 7, 10], "metals", 5, 2.5, "metals", "prior_month_end"),
    ("CL", 1000, 0.01, EVERY_MONTH, "crude", 5, 2.5, "energy", None),
    ("NG", 10000, 0.001, EVERY_MONTH, "natgas", 5, 2.5, "energy", None),
    ("RB", 42000, 0.0001, EVERY_MONTH, "refined", 5, 2.5, "energy", None),
    ("HO", 42000, 0.0001, EVERY_MONTH, "refined", 5, 2.5, "energy", None),
    ("ZC", 50, 0.25, [3, 5, 7, 9, 12], "grains", 5, 2.5, "grains", "prior_month_end"),
    ("ZS", 50, 0.25, [1, 3, 5, 7, 8, 9, 11], "grains", 5, 2.5, "grains", "prior_month_end"),
    ("ZW", 50, 0.25, [3, 5, 7, 9, 12], "grains", 5, 2.5, "grains", "prior_month_end"),
    ("KE", 50, 0.25, [3, 5, 7, 9, 12], "grains", 5, 2.5, "grains", "prior_month_end"),
    ("ZM", 100, 0.1, [1, 3, 5, 7, 8, 9, 10, 12], "grains", 5, 2.5, "grains", "prior_month_end"),
    ("ZL", 600, 0.01, [1, 3, 5, 7, 8, 9, 10, 12], "grains", 5, 2.5, "grains", "prior_month_end"),
    ("LE", 400, 0.025, [2, 4, 6, 8, 10, 12], "last_busday", 5, 2.5, "meats", "prior_month_end"),
    ("HE", 400, 0.025, [2, 4, 5, 6, 7, 8, 10, 12], "lean_hogs", 5, 2.5, "meats", None),
    ("GF", 500, 0.025, [1, 3, 4, 5, 8, 9, 10, 11], "feeder", 5, 2.5, "meats", None),
    ("BZ", 1000, 0.01, EVERY_MONTH, "brent", 5, 2.5, "energy", None),
    ("PA", 100, 0.5, [3, 6, 9, 12], "metals", 5, 2.5, "metals", "prior_month_end"),
    ("6M", 500000, 0.00001, [3, 6, 9, 12], "fx", 5, 2.5, "em_fx", None),
    ("6Z", 500000, 0.000025, [3, 6, 9, 12], "fx", 5, 2.5, "em_fx", None),
    ("6L", 100000, 0.00005, EVERY_MONTH, "refined", 5, 2.5, "em_fx", None),
    ("NKD", 5, 5, [3, 6, 9, 12], "nikkei", 5, 2.5, "asia_indices", None),
    ("EMD", 100, 0.1, [3, 6, 9, 12], "third_friday", 5, 2.5, "us_indices", None),
    ("ZO", 50, 0.25, [3, 5, 7, 9, 12], "grains", 5, 2.5, "grains", "prior_month_end"),
    ("ZR", 2000, 0.005, [1, 3, 5, 7, 9, 11], "grains", 5, 2.5, "grains", "prior_month_end"),
    ("SR3", 2500, 0.0025, [3, 6, 9, 12], "sofr3", 5, 1.5, "rates", None),
    ("ZQ", 4167, 0.0025, EVERY_MONTH, "last_busday", 5, 1.5, "rates", None),
    ("TN", 1000, 0.015625, [3, 6, 9, 12], "treasury", 3, 1.5, "rates", "prior_month_end"),
    ("BTC", 5, 5, EVERY_MONTH, "last_friday", 5, 2.5, "crypto", None),
    ("MES", 5, 0.25, [3, 6, 9, 12], "third_friday", 5, 0.85, "us_indices", None),
    ("MNQ", 2, 0.25, [3, 6, 9, 12], "third_friday", 5, 0.85, "us_indices", None),
    ("MYM", 0.5, 1, [3, 6, 9, 12], "third_friday", 5, 0.85, "us_indices", None),
    ("M2K", 5, 0.1, [3, 6, 9, 12], "third_friday", 5, 0.85, "us_indices", None),
    ("MGC", 10, 0.1, [2, 4, 6, 8, 10, 12], "metals", 7, 1, "metals", "prior_month_end"),
    ("SIL", 1000, 0.005, [3, 5, 7, 9, 12], "metals", 7, 1, "metals", "prior_month_end"),
    ("MHG", 2500, 0.0005, [3, 5, 7, 9, 12], "metals", 7, 1, "metals", "prior_month_end"),
    ("M6E", 12500, 0.0001, [3, 6, 9, 12], "fx", 5, 0.85, "usd_majors", None),
    ("M6A", 10000, 0.0001, [3, 6, 9, 12], "fx", 5, 0.85, "usd_majors", None),
    ("M6B", 6250, 0.0001, [3, 6, 9, 12], "fx", 5, 0.85, "usd_majors", None),
    ("MCL", 100, 0.01, EVERY_MONTH, "crude", 5, 1, "energy", None),
    ("MBT", 0.1, 5, EVERY_MONTH, "last_friday", 5, 1, "crypto", None),
]

# Micro contract and the full-size root whose history it shares.
MICRO_PARENT = {"MES": "ES", "MNQ": "NQ", "MYM": "YM", "M2K": "RTY", "MGC": "GC", "SIL": "SI", "MHG": "HG",
                "M6E": "6E", "M6A": "6A", "M6B": "6B", "MCL": "CL", "MBT": "BTC"}

ROOT_SCHEMA = ("root string, multiplier double, tick_size double, months array<int>, expiry_rule string, "
               "roll_days int, commission double, sector string, notice_rule string, parent string")


def roots(spark: SparkSession) -> DataFrame:
    """The contract-family dimension: a fixed, short table."""
    rows = [(root, float(multiplier), float(tick), months, rule, roll, float(commission), sector, notice, MICRO_PARENT.get(root, root))
            for root, multiplier, tick, months, rule, roll, commission, sector, notice in ROOTS]
    return spark.createDataFrame(rows, ROOT_SCHEMA)


def contract_calendar(root_dim: DataFrame, start: str, end: str) -> DataFrame:
    """Every listed contract around [start, end]: last trade, first notice, anchor, roll date."""
    lo, hi = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    years = F.explode(F.sequence(F.year(lo) - 1, F.year(hi) + 1))
    d = root_dim.withColumn("year", years).withColumn("month", F.explode("months"))
    d = K.with_expiry(d).withColumn("anchor", F.least("last_trade", "first_notice"))
    d = d.withColumn("_rank", K.rank(F.col("anchor")) - F.col("roll_days")).withColumn("roll_on", K.from_rank(F.col("_rank")))
    near = (F.col("last_trade") >= F.date_sub(lo, 400)) & (F.col("last_trade") <= F.date_add(hi, 400))
    return d.filter(near).select("root", "year", "month", "last_trade", "first_notice", "anchor", "roll_on",
                                 contract_code("root", "year", "month").alias("contract"))


def active_windows(calendar: DataFrame, start: str, end: str) -> DataFrame:
    """Contiguous windows of the contracts active in [start, end], numbered per root."""
    lo, hi = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    w = Window.partitionBy("root").orderBy("year", "month")
    d = calendar.withColumn("_prev", F.lag("roll_on").over(w))
    d = d.withColumn("active_from", F.coalesce("_prev", lo))
    # the first contract whose roll lies beyond the end is the last one kept
    d = d.filter((F.col("roll_on") >= lo) & (F.col("_prev").isNull() | (F.col("_prev") <= hi)))
    return d.withColumn("window_no", F.row_number().over(w)).drop("_prev")


def front_by_day(windows: DataFrame, end: str) -> DataFrame:
    """One row per root and day: the contract to trade. On the roll date it is already the next."""
    last = F.least(F.date_sub("roll_on", 1), F.to_date(F.lit(end)))
    d = windows.filter(F.col("active_from") <= last)
    return d.select("root", "window_no", "contract", "year", "month",
                    F.explode(F.sequence("active_from", last)).alias("day"))


def front_windows(days: DataFrame) -> DataFrame:
    """First and last calendar day each contract was the front month."""
    return days.groupBy("root", "contract").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def parse_contract_symbols(raw: DataFrame, root: str, calendar: DataFrame, slack_days: int = 7) -> DataFrame:
    """Split a family download into contract months: spreads and options go, the month letter is
    read, a one-digit year is the first that still trades on the row's day."""
    pattern = f"^{root}([{MONTH_CODES}])([0-9]{{1,2}})$"
    d = raw.filter(F.col("symbol").rlike(pattern))
    digits = F.regexp_extract("symbol", pattern, 2)
    day = F.to_date("ts")
    near = F.year(day) + F.pmod(digits.cast("int") - F.year(day), F.lit(10))
    d = (d.withColumn("month", F.instr(F.lit(MONTH_CODES), F.regexp_extract("symbol", pattern, 1)))
          .withColumn("_near", F.when(F.length(digits) == 2, 2000 + digits.cast("int")).otherwise(near)))
    cal = calendar.filter(F.col("root") == root).select(F.col("year").alias("_near"), "month", "last_trade")
    d = d.join(cal, ["_near", "month"], "left")
    dead = (F.length(digits) == 1) & F.coalesce(F.date_add("last_trade", slack_days) < day, F.lit(False))
    d = d.withColumn("year", F.col("_near") + F.when(dead, 10).otherwise(0)).drop("_near", "last_trade")
    rest = [c for c in d.columns if c not in ("year", "month", "ts")]
    # one row per stamp, the first to arrive: a partial aggregate, however many copies there are
    g = d.groupBy("year", "month", "ts").agg(F.min_by(F.struct(*rest), "seq").alias("_r"))
    return g.select("year", "month", "ts", *[F.col("_r").getField(c).alias(c) for c in rest], F.lit(root).alias("root"))


def missing_contracts(calendar: DataFrame, stored: DataFrame, start: str, end: str) -> DataFrame:
    """Expected contract months with no data."""
    lo, hi = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    want = calendar.filter((F.col("last_trade") >= lo) & (F.col("last_trade") <= F.date_add(hi, 400)))
    return want.select("root", "year", "month").join(stored.select("root", "year", "month").distinct(),
                                                     ["root", "year", "month"], "left_anti")


def calendar_vs_exchange(calendar: DataFrame, definitions: DataFrame) -> DataFrame:
    """Share of exact expiry dates and the worst miss in business days, per root."""
    miss = K.between(F.col("last_trade"), F.col("expiration"))
    return (calendar.join(definitions, ["root", "year", "month"]).groupBy("root")
            .agg(F.count(F.lit(1)).alias("contracts"), F.avg(F.when(miss == 0, 1.0).otherwise(0.0)).alias("exact"),
                 F.max(miss).alias("worst_miss")))


def tradeable_windows(windows: DataFrame, bars: DataFrame) -> DataFrame:
    """Windows that have data, each with the next such contract of its root."""
    have = bars.select("root", "year", "month").distinct()
    w = Window.partitionBy("root").orderBy("year", "month")
    d = windows.join(have, ["root", "year", "month"], "left_semi")
    nxt = F.lead(F.struct("year", "month", "contract", "last_trade")).over(w)
    return d.withColumn("seq_no", F.row_number().over(w)).withColumn("nxt", nxt)


def daily_closes(bars: DataFrame) -> DataFrame:
    return bars.groupBy("root", "year", "month", F.to_date("ts").alias("day")).agg(F.max_by("close", "ts").alias("close"))


def contract_pairs(windows: DataFrame, bars: DataFrame) -> DataFrame:
    """Per window and day: the contract's own close and the following contract's.

    A close serves its own window as front and the window before as next, so both sides come
    from one pass over the closes."""
    closes = daily_closes(bars).join(windows.select("root", "year", "month", "seq_no"), ["root", "year", "month"])
    roles = F.explode(F.array(F.struct(F.col("seq_no"), F.lit(True).alias("front")),
                              F.struct((F.col("seq_no") - 1).alias("seq_no"), F.lit(False).alias("front"))))
    d = closes.select("root", "day", "close", roles.alias("r")).select("root", "day", "close", "r.seq_no", "r.front")
    return (d.filter(F.col("seq_no") > 0).groupBy("root", "seq_no", "day")
            .agg(F.max(F.when(F.col("front"), F.col("close"))).alias("front_close"),
                 F.max(F.when(~F.col("front"), F.col("close"))).alias("next_close")))


def rolls(windows: DataFrame, bars: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row per roll: its date and the close-to-close gap on the last day both contracts
    traded before it (else the last common day; else unmeasured, with gap zero)."""
    pairs = contract_pairs(windows, bars) if pairs is None else pairs
    w = windows.filter(F.col("nxt").isNotNull()).select("root", "seq_no", "roll_on", "contract", "nxt")
    both = F.col("front_close").isNotNull() & F.col("next_close").isNotNull()
    g = (w.join(pairs, ["root", "seq_no"], "left").groupBy("root", "seq_no", "roll_on", "contract", "nxt").agg(
        F.max_by(F.struct("front_close", "next_close"),
                 F.when(both, F.struct(F.col("day") < F.col("roll_on"), "day"))).alias("p"),
        F.max_by("front_close", F.when(F.col("front_close").isNotNull(), F.col("day"))).alias("_f"),
        F.min_by("next_close", F.when(F.col("next_close").isNotNull(), F.col("day"))).alias("_n")))
    ok = F.col("p").isNotNull()
    return g.select("root", "seq_no", "roll_on", F.col("contract").alias("from_contract"),
                    F.col("nxt.contract").alias("to_contract"),
                    F.when(ok, F.col("p.next_close") - F.col("p.front_close")).otherwise(0.0).alias("gap"),
                    F.when(ok, F.col("p.front_close")).otherwise(F.col("_f")).alias("front_close"),
                    F.when(ok, F.col("p.next_close")).otherwise(F.col("_n")).alias("next_close"), ok.alias("measured"))


def stitch(windows: DataFrame, bars: DataFrame) -> DataFrame:
    """Back-adjusted continuous bars: each window shifted by the sum of the gaps after it, with
    the raw close and the annualised carry against the next contract."""
    w = Window.partitionBy("root").orderBy("seq_no")
    pairs = contract_pairs(windows, bars)
    gaps = rolls(windows, bars, pairs).select("root", "seq_no", "gap")
    later = F.sum(F.coalesce("gap", F.lit(0.0))).over(w.rowsBetween(0, Window.unboundedFollowing))
    win = windows.join(gaps, ["root", "seq_no"], "left").withColumn("shift", later)
    piece = (bars.join(win, ["root", "year", "month"]).withColumn("day", F.to_date("ts"))
             .filter((F.col("day") >= F.col("active_from")) & ((F.col("day") < F.col("roll_on")) | F.col("nxt").isNull())))
    piece = piece.join(pairs.select("root", "seq_no", "day", "next_close"), ["root", "seq_no", "day"], "left")
    days = F.greatest(F.datediff("nxt.last_trade", "last_trade"), F.lit(1))
    yield_ = F.try_divide(F.col("close") - F.col("next_close"), F.col("close")) * (365.0 / days)
    fill = Window.partitionBy("root", "seq_no").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    piece = piece.withColumn("_y", yield_).withColumn("carry", F.last("_y", True).over(fill))
    return piece.select("root", "ts", "contract", *[(F.col(c) + F.col("shift")).alias(c) for c in ("open", "high", "low", "close")],
                        "volume", F.col("close").alias("raw_close"), "carry")


def roll_cost_cash(contracts: Column, spread_ticks: float = 1.0) -> Column:
    """Closing one contract and opening the next: two commissions and two spreads."""
    tick_value = F.col("tick_size") * F.col("multiplier")
    return 2 * F.col("commission") * contracts + 2 * spread_ticks * tick_value * contracts


def rolls_in_holding(trades: DataFrame, roll_log: DataFrame) -> DataFrame:
    """Rolls strictly after the entry and up to the exit, from the root's short list of dates."""
    dates = roll_log.groupBy(F.col("root").alias("symbol")).agg(F.collect_list(F.col("roll_on").cast("timestamp")).alias("_rolls"))
    held = F.size(F.filter("_rolls", lambda r: (r > F.col("entry_ts")) & (r <= F.col("exit_ts"))))
    return trades.join(dates, "symbol", "left").withColumn("rolls", F.when(F.col("_rolls").isNull(), 0).otherwise(held)).drop("_rolls")


def roll_bill(trades: DataFrame, roll_log: DataFrame, root_dim: DataFrame, spread_ticks: float = 1.0,
              stress: float = 2.0) -> DataFrame:
    """Roll costs nobody charged, by market, against what was charged and earned."""
    d = rolls_in_holding(trades, roll_log).join(
        root_dim.select(F.col("root").alias("symbol"), "tick_size", "multiplier", "commission", "sector"), "symbol")
    cost = F.col("rolls") * roll_cost_cash(F.abs("volume"), spread_ticks) * stress
    return d.groupBy("symbol", "sector").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("rolls").alias("rolls_crossed"), F.sum(cost).alias("unpaid_roll_cost"),
        F.sum("costs").alias("charged_costs"), F.sum("net_pnl").alias("net_pnl"))


def annual_roll_drag(roll_log: DataFrame, years: float) -> DataFrame:
    """Mean yearly gap in price units; positive means a long pays it."""
    return roll_log.groupBy("root").agg((F.sum("gap") / years).alias("drag"), F.count(F.lit(1)).alias("rolls"))


def rebase_positions(positions: DataFrame, roll_log: DataFrame, root_dim: DataFrame) -> DataFrame:
    """Shift entry and stop of positions held across rolls by the basis, and charge each roll."""
    log = roll_log.groupBy(F.col("root").alias("symbol")).agg(
        F.collect_list(F.struct(F.col("roll_on").cast("timestamp").alias("at"), "gap", "measured")).alias("_rolls"))
    d = positions.join(log, "symbol", "left").join(
        root_dim.select(F.col("root").alias("symbol"), "tick_size", "multiplier", "commission"), "symbol")
    mine = F.filter(F.coalesce("_rolls", F.array().cast("array<struct<at:timestamp,gap:double,measured:boolean>>")),
                    lambda r: (r["at"] > F.col("opened_at")) & (r["at"] <= F.col("as_of")))
    d = d.withColumn("_r", F.filter(mine, lambda r: r["measured"])).withColumn("_bad", F.size(mine) - F.size("_r"))
    basis = F.aggregate("_r", F.lit(0.0), lambda a, r: a + r["gap"])
    return (d.withColumn("basis", basis).withColumn("rolls", F.size("_r"))
            .withColumn("entry_price", F.col("entry_price") + F.col("basis")).withColumn("stop_loss", F.col("stop_loss") + F.col("basis"))
            .withColumn("roll_cost", F.col("rolls") * roll_cost_cash(F.col("volume")))
            .withColumn("trusted", F.col("_bad") == 0).drop("_rolls", "_r", "_bad", "tick_size", "multiplier", "commission"))


def to_parent(markets: DataFrame, root_dim: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Markets mapped to the root whose history they share, first occurrence kept; and those unknown."""
    d = markets.join(root_dim.select(F.col("root").alias("market"), "parent"), "market", "left")
    known = d.filter(F.col("parent").isNotNull()).groupBy("parent").agg(
        F.min(order).alias(order), F.min_by("market", order).alias("market"))
    return known, d.filter(F.col("parent").isNull()).select("market").distinct()
