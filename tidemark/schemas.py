"""Explicit schemas of the stored tables."""

from pyspark.sql import types as T

BARS = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()),
    *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
    T.StructField("timeframe", T.StringType()), T.StructField("year", T.IntegerType())])

PRINTS = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("contract", T.StringType()),
    T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType()),
    T.StructField("price", T.DoubleType()), T.StructField("size", T.DoubleType()), T.StructField("side", T.IntegerType())])

BREACH = T.StructType([
    T.StructField("limit", T.StringType()), T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("observed", T.DoubleType()),
    T.StructField("threshold", T.DoubleType())])

JOURNAL = T.StructType([
    T.StructField("ts", T.TimestampType()), T.StructField("event", T.StringType()),
    T.StructField("equity", T.DoubleType()), T.StructField("positions", T.IntegerType()),
    T.StructField("halted", T.BooleanType()), T.StructField("feed_age_s", T.DoubleType()),
    T.StructField("symbol", T.StringType()), T.StructField("strategy", T.StringType()),
    T.StructField("side", T.StringType()), T.StructField("approved", T.BooleanType()),
    T.StructField("note", T.StringType()), T.StructField("breaches", T.ArrayType(BREACH)),
    T.StructField("client_id", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("ticket", T.LongType()), T.StructField("requested", T.DoubleType()),
    T.StructField("filled", T.DoubleType()), T.StructField("volume", T.DoubleType()),
    T.StructField("slippage", T.DoubleType()), T.StructField("reason", T.StringType()),
    T.StructField("error", T.StringType()), T.StructField("consecutive", T.IntegerType()),
    T.StructField("limit", T.StringType()), T.StructField("state", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("_corrupt_record", T.StringType())])

SPREADS = T.StructType([
    T.StructField("ts", T.TimestampType()), T.StructField("symbol", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in ("bid", "ask", "spread", "spread_points", "point", "age_s")],
    T.StructField("_corrupt_record", T.StringType())])

FILL = T.StructType([
    T.StructField("leg", T.StringType()), T.StructField("spread", T.DoubleType()),
    T.StructField("slippage", T.DoubleType()), T.StructField("ts", T.StringType())])

SPEC = T.StructType([
    T.StructField("digits", T.IntegerType()), T.StructField("point", T.DoubleType()),
    T.StructField("tick_size", T.DoubleType()), T.StructField("tick_value", T.DoubleType()),
    T.StructField("volume_min", T.DoubleType()), T.StructField("volume_max", T.DoubleType()),
    T.StructField("volume_step", T.DoubleType()), T.StructField("contract_size", T.DoubleType()),
    T.StructField("stops_level_points", T.IntegerType()), T.StructField("swap_long", T.DoubleType()),
    T.StructField("swap_short", T.DoubleType()), T.StructField("currency_profit", T.StringType()),
    T.StructField("swap_mode", T.IntegerType()), T.StructField("swap_triple_weekday", T.IntegerType()),
    T.StructField("spread_pts", T.DoubleType())])
