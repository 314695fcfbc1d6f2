"""Other readers and writers: positioning reports, prints, journals, verdicts, costs, contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.operators.quality import DataError, merge_sunday_stubs, validate_counts
from tidemark.session import materialize
from tidemark.sources import snapshots

# Columns of the legacy positioning report and the names used here.
COT_COLUMNS = {
    "Market and Exchange Names": "market",
    "As of Date in Form YYYY-MM-DD": "as_of",
    "Open Interest (All)": "oi",
    "Noncommercial Positions-Long (All)": "spec_long",
    "Noncommercial Positions-Short (All)": "spec_short",
    "Commercial Positions-Long (All)": "comm_long",
    "Commercial Positions-Short (All)": "comm_short",
    "Nonreportable Positions-Long (All)": "small_long",
    "Nonreportable Positions-Short (All)": "small_short",
}
COT_NUMBERS = ["oi", "spec_long", "spec_short", "comm_long", "comm_short", "small_long", "small_short"]


def read_cot_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rename, trim, and turn unreadable numbers and dates into nulls; undated rows drop."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    by_name = {c.strip(): c for c in raw.columns}
    missing = [c for c in COT_COLUMNS if c not in by_name]
    if missing:
        raise DataError(f"positioning file is missing expected columns: {missing}")
    d = raw.select(*[F.col(f"`{by_name[src]}`").alias(dst) for src, dst in COT_COLUMNS.items()])
    return clean_cot(d)


def clean_cot(d: DataFrame) -> DataFrame:
    numbers = [F.trim(c).try_cast("double").alias(c) for c in COT_NUMBERS]
    return (d.select(F.trim("market").alias("market"), F.trim("as_of").try_cast("date").alias("as_of"), *numbers)
            .filter(F.col("as_of").isNotNull()))


COT_TABLE = T.StructType([T.StructField("market", T.StringType()), T.StructField("as_of", T.DateType()),
                          *[T.StructField(c, T.DoubleType()) for c in COT_NUMBERS], T.StructField("code", T.StringType())])


def upsert_cot(spark: SparkSession, path: str, code: str, rows: DataFrame) -> None:
    """Merge reports of one market by date, the newer copy winning. The market is a partition, and the
    change appears at once."""
    new = rows.withColumn("code", F.lit(code)).select(*COT_TABLE.names)
    old = snapshots.read(spark, path, COT_TABLE, where=lambda part: part == f"code={code}")
    snapshots.replace(spark, path, snapshots.merge(old, new, ["code", "as_of"]), ["code"])


def read_cot(spark: SparkSession, path: str, code: str | None = None) -> DataFrame:
    return snapshots.read(spark, path, COT_TABLE, where=None if code is None else lambda part: part == f"code={code}")


def classify_prints(raw: DataFrame, aggressor: str = "aggressor") -> DataFrame:
    """'A' lifted the offer (+1), 'B' hit the bid (-1); anything else is not guessed (0)."""
    a = F.col(aggressor)
    return raw.withColumn("side", F.when(a == "A", 1).when(a == "B", -1).otherwise(0))


def ingest_prints(raw: DataFrame, aggressor: str = "aggressor") -> tuple[DataFrame, DataFrame]:
    """Usable prints, and the share dropped per contract as unclassifiable."""
    d = classify_prints(raw, aggressor)
    dropped = d.groupBy("contract").agg(
        F.count(F.lit(1)).alias("prints"), F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("dropped"))
    return d.filter(F.col("side") != 0).drop(aggressor), dropped.withColumn("dropped_share", F.col("dropped") / F.col("prints"))


def write_prints(prints: DataFrame, path: str) -> None:
    """Range-sorted within each contract's days, so that a scan of a span reads few row groups."""
    (prints.withColumn("day", F.to_date("ts")).repartitionByRange("contract", "ts", "seq")
     .sortWithinPartitions("contract", "ts", "seq").write.mode("append").partitionBy("contract", "day").parquet(path))


def journal_lines(events: DataFrame) -> DataFrame:
    """Records as JSON lines (column `value`); NaN becomes null, and nulls are left out."""
    cols = [F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in events.schema.fields]
    return events.select(F.to_json(F.struct(*cols), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value"))


def journal_records(lines: DataFrame) -> DataFrame:
    """JSON lines (`value`), of a table or a stream, as records. Blank lines drop. A line that is
    no whole record, or names no event, is kept in `_corrupt_record`, which is null elsewhere."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    r = (lines.filter(F.trim("value") != "").select("value", F.from_json("value", schemas.JOURNAL, options).alias("r"))
         .select("value", "r.*"))
    bad = F.col("_corrupt_record").isNotNull() | F.col("event").isNull()
    return r.withColumn("_corrupt_record", F.when(bad, F.col("value"))).drop("value")


def split_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable records, and the lines set aside."""
    bad = F.col("_corrupt_record").isNotNull()
    return records.filter(~bad).drop("_corrupt_record"), records.filter(bad).select(F.col("_corrupt_record").alias("line"))


def _readable(d: DataFrame) -> DataFrame:
    return d.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_journal(spark: SparkSession, path: str, event: str | None = None, limit: int | None = None) -> DataFrame:
    """JSON lines; blank and truncated lines are skipped. With `limit`, the newest records."""
    d = split_records(journal_records(spark.read.text(path)))[0]
    if event:
        d = d.filter(F.col("event") == event)
    return d.orderBy(F.desc("ts")).limit(limit) if limit else d


def write_journal(events: DataFrame, path: str) -> None:
    """Append records as JSON lines."""
    journal_lines(events).write.mode("append").text(path)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Saved run results: headline numbers of whichever book the file holds, one row per test."""
    book = ("struct<net_sharpe:double,max_drawdown:double,realised_vol:double,friction_share:double,"
            "diversification_ratio:double>")
    test = "array<struct<test:string,pass:boolean,detail:string>>"
    d = spark.read.schema(f"passed boolean, net_sharpe double, max_drawdown double, book {book}, carry {book}, "
                          f"filtered {book}, verdict {test}").json(path, multiLine=True)
    best = F.coalesce("book", "carry", "filtered")
    run = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return d.select(run.alias("run"), "passed", F.coalesce(best["net_sharpe"], F.col("net_sharpe")).alias("net_sharpe"),
                    F.coalesce(best["max_drawdown"], F.col("max_drawdown")).alias("max_drawdown"),
                    best["diversification_ratio"].alias("diversification_ratio"),
                    F.explode_outer("verdict").alias("v")).select("*", F.col("v.test").alias("test"), F.col("v.pass").alias("pass")).drop("v")


def read_spread_samples(spark: SparkSession, path: str) -> DataFrame:
    return _readable(spark.read.schema(schemas.SPREADS).option("mode", "PERMISSIVE").json(path)).filter(F.col("symbol").isNotNull())


def _map_json(spark: SparkSession, path: str, value: T.DataType) -> DataFrame:
    """A JSON object keyed by symbol, as (symbol, value) rows."""
    text = spark.read.text(path, wholetext=True)
    m = F.from_json("value", T.MapType(T.StringType(), value))
    return text.select(F.explode(m).alias("symbol", "v"))


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    return _map_json(spark, path, schemas.SPEC).select("symbol", "v.*")


def read_fills(spark: SparkSession, path: str) -> DataFrame:
    """symbol -> list of fills, flattened."""
    return (_map_json(spark, path, T.ArrayType(schemas.FILL)).select("symbol", F.explode("v").alias("f"))
            .select("symbol", "f.leg", "f.spread", "f.slippage", F.col("f.ts").try_cast("timestamp").alias("ts")))


def append_fills(fills: DataFrame, path: str) -> None:
    fills.select("symbol", "leg", "spread", "slippage", "ts").write.mode("append").parquet(path)


def measured_costs(specs: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """A cost row per symbol with a measured spread: slippage is half of it, opens cost double.
    A required symbol without a measurement fails the job."""
    c = (specs.filter(F.col("spread_pts") > 0)
         .select("symbol", (F.col("spread_pts") * F.col("point")).alias("spread"))
         .withColumn("slippage", F.col("spread") / 2).withColumn("spread_multiple_at_open", F.lit(2.0)))
    if required is None:
        return c
    d = required.join(c, "symbol", "left")
    known = F.when(F.col("spread").isNotNull(), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("no measured spread for "), F.col("symbol"))).cast("boolean"))
    return d.filter(known)


def month_windows(spans: DataFrame) -> DataFrame:
    """Tile (start, end) date spans into calendar months, clipped at the ends."""
    m = F.explode(F.sequence(F.trunc("start", "MM"), F.col("end"), F.expr("INTERVAL 1 MONTH")))
    return (spans.withColumn("_m", m).withColumn("from_day", F.greatest("_m", "start"))
            .withColumn("to_day", F.least(F.last_day("_m"), "end")).drop("_m"))


ACCEPTED, REFUSED = "accepted", "refused"
CONTRACT_TABLE = T.StructType([
    T.StructField("ts", T.TimestampType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
    T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType()),
    T.StructField("status", T.StringType()), T.StructField("root", T.StringType())])


def write_contracts(bars: DataFrame, path: str) -> None:
    """Daily contract bars, Sundays folded, in one write: contract months that fail validation are
    set aside under a status of their own. The table is replaced as a whole.

    Prices at or below zero are allowed: futures have printed there."""
    keys = ["root", "year", "month"]
    d = materialize(merge_sunday_stubs(bars, keys))  # read by the checks and by the write
    fails = reduce(lambda a, c: a + F.col(c), ["high_below_low", "outside_range", "duplicate_ts"], F.col("null_ohlc")) > 0
    status = validate_counts(d, keys).select(*keys, F.when(fails, REFUSED).otherwise(ACCEPTED).alias("status"))
    snapshots.replace(bars.sparkSession, path, d.join(status, keys).select(*CONTRACT_TABLE.names), ["status", "root"], whole=True)


def read_contracts(spark: SparkSession, path: str, status: str = ACCEPTED) -> DataFrame:
    """Bars of the accepted contract months, or of those set aside."""
    d = snapshots.read(spark, path, CONTRACT_TABLE, where=lambda part: part.split("/")[0] == f"status={status}")
    return d.drop("status")


def read_expiries(spark: SparkSession, path: str, root: str, parents: dict[str, str] | None = None) -> DataFrame:
    """A root's contract bars; a micro without its own reads its parent's."""
    d = read_contracts(spark, path)
    own = d.filter(F.col("root") == root)
    if parents and root in parents and own.isEmpty():
        return d.filter(F.col("root") == parents[root])
    return own


def read_expiry_files(spark: SparkSession, path: str) -> DataFrame:
    """One Parquet file per contract month: year and month are in the file's name, and the root, where
    the rows do not state it, is the name of its folder."""
    d = spark.read.parquet(path)
    at = r"([^/]+)/[^/]*?(\d{4})(\d{2})[^/]*$"
    part = lambda i: F.regexp_extract(F.col("_metadata.file_path"), at, i)
    root = [] if "root" in d.columns else [part(1).alias("root")]
    return d.select("*", *root, part(2).cast("int").alias("year"), part(3).cast("int").alias("month"))


def write_trades(trades: DataFrame, path: str) -> None:
    trades.write.mode("overwrite").parquet(path)


def write_equity(equity: DataFrame, path: str) -> None:
    equity.write.mode("overwrite").partitionBy("book_id").parquet(path)

