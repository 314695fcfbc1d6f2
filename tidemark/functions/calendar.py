"""Business-day and contract-expiry arithmetic as closed-form date columns.

Weekdays are business days; holidays are not modelled. The rank of a day is the number of
business days up to and including it, so a weekend shares its Friday's rank, and both
directions are plain integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _monday_based(d: Column) -> Column:
    return F.unix_date(d) + 3  # 1970-01-01 was a Thursday


def rank(d: Column) -> Column:
    n = _monday_based(d)
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)) + 1, F.lit(5))


def from_rank(k: Column) -> Column:
    weeks, day = F.floor((k - 1) / 5), F.pmod(k - 1, F.lit(5))
    return F.date_from_unix_date((weeks * 7 + day - 3).cast("int"))


def shift(d: Column, n: Column | int) -> Column:
    """n business days on; stepping back from a weekend, Friday is the first day counted."""
    n = F.lit(n) if isinstance(n, int) else n
    weekend = F.when(F.weekday(d) >= 5, 1).otherwise(0)
    return F.when(n == 0, d).when(n > 0, from_rank(rank(d) + n)).otherwise(from_rank(rank(d) + n + weekend))


def between(a: Column, b: Column) -> Column:
    """Business days from a to b."""
    return F.abs(rank(b) - rank(a))


def nth_weekday(first: Column, weekday: Column, n: Column) -> Column:
    return F.date_add(first, (F.pmod(weekday - F.weekday(first), F.lit(7)) + 7 * (n - 1)).cast("int"))


def last_weekday(last: Column, weekday: Column) -> Column:
    return F.date_sub(last, F.pmod(F.weekday(last) - weekday, F.lit(7)).cast("int"))


# Last-trade rules. Each starts from a base day of a month near the contract month
# (nth: the n-th weekday; last: the last weekday; day: day n; end: the last day) and moves by
# business days. "back" says a base on a weekend first falls back to Friday without counting.
# rule, months from the contract month, base, weekday (Monday = 0), n, business days, back
RULES = [
    ("third_friday", 0, "nth", 4, 3, 0, "yes"),
    ("gold", 0, "end", 0, 0, -2, "yes"),
    ("metals", 0, "end", 0, 0, -2, "yes"),
    ("fx", 0, "nth", 2, 3, -2, "yes"),
    ("crude", -1, "day", 0, 25, -3, "yes"),
    ("natgas", -1, "end", 0, 0, -2, "yes"),
    ("refined", -1, "end", 0, 0, 0, "yes"),
    ("treasury", 0, "end", 0, 0, -7, "yes"),
    ("last_busday", 0, "end", 0, 0, 0, "yes"),
    ("grains", 0, "day", 0, 15, -1, "no"),
    ("lean_hogs", 0, "day", 0, 0, 10, "yes"),
    ("feeder", 0, "last", 3, 0, 0, "yes"),
    ("brent", -2, "end", 0, 0, 0, "yes"),
    ("nikkei", 0, "nth", 4, 2, -1, "yes"),
    ("sofr3", 3, "nth", 2, 3, -1, "yes"),
    ("last_friday", 0, "last", 4, 0, 0, "yes"),
]
RULE_SCHEMA = "expiry_rule string, _months int, _base string, _weekday int, _n int, _move int, _back string"


def rules(spark) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_SCHEMA)


def with_expiry(contracts: DataFrame) -> DataFrame:
    """Add last_trade and first_notice to rows of (year, month, expiry_rule, notice_rule).

    Built in steps, so that no long expression is repeated inside another."""
    d = contracts.join(rules(contracts.sparkSession), "expiry_rule", "left")
    d = d.withColumn("_first", F.make_date("year", "month", F.lit(1)))
    d = d.withColumn("_m", F.add_months("_first", F.col("_months"))).withColumn("_end", F.last_day("_m"))
    base = F.col("_base")
    day = (F.when(base == "nth", nth_weekday(F.col("_m"), F.col("_weekday"), F.col("_n")))
           .when(base == "last", last_weekday(F.col("_end"), F.col("_weekday")))
           .when(base == "day", F.date_add("_m", F.col("_n") - 1)).when(base == "end", F.col("_end"))
           .otherwise(F.raise_error(F.concat(F.lit("unknown expiry rule "), F.col("expiry_rule"))).cast("date")))
    d = d.withColumn("_day", day)
    counted = F.when((F.col("_back") == "no") & (F.weekday("_day") >= 5) & (F.col("_move") < 0), 1).otherwise(0)
    d = d.withColumn("_rank", rank(F.col("_day")) + F.col("_move") + counted)
    d = d.withColumn("last_trade", from_rank(F.col("_rank")))
    # deliverable contracts: the last business day before the contract month
    d = d.withColumn("_rank", rank(F.date_sub("_first", 1)))
    d = d.withColumn("first_notice", F.when(F.col("notice_rule") == "prior_month_end", from_rank(F.col("_rank"))))
    return d.drop("_first", "_m", "_end", "_day", "_rank", "_months", "_base", "_weekday", "_n", "_move", "_back")
