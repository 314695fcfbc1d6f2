"""Streaming forms of the bar, journal and quote operators. Functions return a streaming DataFrame
(a batch one works too), or a job with its `frame` and the way to close it; `drain` runs a stream
over what is available, `complete` also closes what is still open at the end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ensure_checkpoint_dir
from tidemark.sources.files import journal_records
from tidemark.streaming.ordered import Ordered
from tidemark.streaming.windows import Windowed


#: Files that one trigger reads, so that a backlog becomes many bounded batches.
FILES_PER_TRIGGER = 64


def source(spark: SparkSession, folder: str, file_name: str, schema: T.StructType, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Files of one name in a folder, as a stream."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", file_name).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(folder))


def journal_source(spark: SparkSession, folder: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """JSON-line files of a folder as a stream of records; lines that cannot be read are in `_corrupt_record`."""
    return journal_records(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder))


def _run(stream: DataFrame, mode: str, batch=None) -> tuple[str, DataFrame | None]:
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if batch is not None:
        w.foreachBatch(batch).start().awaitTermination()
        return f"{base}/state", None
    w.format("parquet").option("path", f"{base}/out").start().awaitTermination()
    return f"{base}/state", spark.read.schema(stream.schema).parquet(f"{base}/out")


def drain(stream: DataFrame, mode: str = "append", batch=None) -> DataFrame | None:
    """Run the stream over all available input into Parquet, and read the result back.

    State and output live in the shared checkpoint folder. With `batch`, each micro-batch is
    handed to it instead and nothing is returned."""
    return _run(stream, mode, batch)[1]


def complete(job: Windowed | Ordered, batch=None) -> DataFrame | None:
    """Drain a job and add what its state still holds at the end: open windows, or rows that wait for
    the watermark. Together they are the result of a batch over the whole input. With `batch`, the
    closing rows are handed to it as one more micro-batch."""
    state, done = _run(job.grouped, "append", None if batch is None else lambda rows, i: batch(job.finish(rows), i))
    rest = job.closing(job.grouped.sparkSession, state)
    if batch is not None:
        batch(rest, -1)
        return None
    return job.finish(done).unionByName(rest)


def delta_windows(prints: DataFrame, freq: str, lateness: str) -> Windowed:
    """Tumbling bars with signed volume.

    The running delta needs an order over bars and is left to the reader of the bars."""
    at = F.struct("ts", "seq")
    signed = F.when(F.col("side") > 0, F.col("size")).when(F.col("side") < 0, -F.col("size")).otherwise(0.0)
    parts = {"open": ("first", F.col("price"), at), "high": ("max", F.col("price")), "low": ("min", F.col("price")), "close": ("last", F.col("price"), at),
             "volume": ("sum", F.col("size")), "prints": ("count", F.lit(1)), "delta": ("sum", signed)}
    return Windowed(prints, F.window("ts", freq), ["symbol"], lateness, parts,
                    lambda g: g.select("symbol", F.col("w.start").alias("ts"), *parts))


def delta_bars(prints: DataFrame, freq: str, lateness: str) -> DataFrame:
    """Bars with signed volume, emitted once the bar can no longer change."""
    return delta_windows(prints, freq, lateness).frame


def once(stream: DataFrame, keys: list[str], lateness: str, ts: str = "ts") -> DataFrame:
    """Drop repeats of a key that arrive within the lateness."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def upsert_into(spark: SparkSession, path: str, timeframe: str, allow_nonpositive: bool = False):
    """A micro-batch function that merges bars into the bar table; replays change nothing."""
    from tidemark.sources.bars import upsert_bars

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_bars(spark, path, batch, timeframe, allow_nonpositive)
    return write


def heartbeat_sessions(journal: DataFrame, gap: str, lateness: str, keys=("runner",)) -> Windowed:
    """Uptime islands: heartbeats no further apart than the gap."""
    beats = journal.filter(F.col("event") == "heartbeat")
    parts = {"beats": ("count", F.lit(1)), "last_beat": ("max", F.col("ts")), "feed_age_max": ("max", F.col("feed_age_s"))}
    return Windowed(beats, F.session_window("ts", gap), list(keys), lateness, parts,
                    lambda g: g.select(*keys, F.col("w.start").alias("first_beat"), "last_beat", "beats", "feed_age_max"))


def event_counts(journal: DataFrame, window: str, slide: str, lateness: str) -> Windowed:
    """Events by kind in a sliding window."""
    return Windowed(journal, F.window("ts", window, slide), ["event"], lateness, {"n": ("count", F.lit(1))},
                    lambda g: g.select(F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "event", "n"))


def spread_guard(quotes: DataFrame, medians: DataFrame, max_multiple: float = 2.0) -> DataFrame:
    """Quotes whose spread exceeds a multiple of their symbol's median (a static table)."""
    d = quotes.join(medians, "symbol").withColumn("multiple", F.try_divide("spread", "median_spread"))
    return d.filter(F.col("multiple") > max_multiple)


def quote_profile(quotes: DataFrame, max_age_seconds: int, lateness: str, freq: str = "1 hour") -> Windowed:
    """Hourly spread profile of fresh quotes only."""
    fresh = quotes.filter(F.unix_timestamp("ingest_ts") - F.unix_timestamp("ts") <= max_age_seconds)
    points = F.col("spread") / F.col("point")
    known = lambda c: ("sum", c.isNotNull().cast("long"))
    parts = {"samples": ("count", F.lit(1)), "max_spread": ("max", F.col("spread")), "_spread": ("sum", F.col("spread")), "_points": ("sum", points),
             "_spreads": known(F.col("spread")), "_pointed": known(points)}
    return Windowed(fresh, F.window("ts", freq), ["symbol"], lateness, parts, lambda g: g.select(
        "symbol", F.col("w.start").alias("ts"), "samples", F.try_divide("_spread", "_spreads").alias("mean_spread"), "max_spread",
        F.try_divide("_points", "_pointed").alias("mean_points")))
