"""Streams over the event files, drained and compared with their batch meaning."""

import uuid

from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.plans import q_ops
from tidemark.plans.registry import cte, query, rounded
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import files as SF
from tidemark.sources import views as V
from tidemark.sources.bars import read_bars
from tidemark.streaming import jobs, ordered

LATE = "2 hours"
DAY = 86_400_000


def raw_events(spark, sf):
    schema = V.table(spark, sf, "events").schema
    return jobs.source(spark, sf, "events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def prints(spark, sf):
    """Prints whose aggressor is stated, so that a bar needs nothing from before it."""
    k = F.get_json_object("props", "$.k").cast("double")
    return raw_events(spark, sf).select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"),
                                        F.col("value").alias("price"), k.alias("size"),
                                        F.when(k % 2 == 0, 1).otherwise(-1).alias("side"))


cte("stream_bars", """
SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close,
 sum(size) AS volume, count(*) AS prints, sum(CASE WHEN CAST(size AS BIGINT) % 2 = 0 THEN size ELSE -size END) AS delta FROM prints GROUP BY 1, 2
""", ("prints",))


@query("stream_delta_bars", "SELECT * FROM stream_bars", ("stream_bars",))
def _(spark, sf):
    return jobs.complete(jobs.delta_windows(prints(spark, sf), "1 hour", LATE))


@query("stream_once", "SELECT symbol, count(*) AS n FROM prints GROUP BY symbol", ("prints",))
def _(spark, sf):
    """Every print arrives twice and is kept once."""
    p = prints(spark, sf)
    d = jobs.drain(jobs.once(p.unionByName(p), ["symbol", "seq"], LATE).select("symbol", "seq"))
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("stream_upsert_bars", "SELECT symbol, ts, open, high, low, close, volume FROM stream_bars", ("stream_bars",))
def _(spark, sf):
    """Closed bars merged into the bar table as they close, the open ones at the end; twice."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/bars-{uuid.uuid4().hex}"
    for _i in range(2):
        jobs.complete(jobs.delta_windows(prints(spark, sf), "1 hour", LATE), batch=jobs.upsert_into(spark, path, "H1", allow_nonpositive=True))
    return read_bars(spark, path, timeframe="H1").drop("timeframe", "year")


@query("stream_feed_staleness", """
SELECT symbol, silent_from, silent_to, round(epoch(silent_to - silent_from), 4) AS seconds FROM (SELECT symbol, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS silent_from, ts AS silent_to FROM prints)
WHERE epoch(silent_to - silent_from) > 5400
""", ("prints",))
def _(spark, sf):
    d = jobs.complete(ordered.feed_silence(prints(spark, sf), 5400, 3600, LATE, width=DAY))
    return rounded(d.filter("status = 'returned'").select("symbol", "silent_from", F.col("noted_at").alias("silent_to"), "seconds"), 4)


@query("stream_feed_silence", """
WITH g AS (SELECT symbol, ts, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS following FROM prints),
seen AS (SELECT (floor(epoch(max(ts)) * 1000) - 7200000)::BIGINT AS mark FROM prints),
a AS (SELECT symbol, ts, following, ts + INTERVAL '5400 seconds' + n * INTERVAL '3600 seconds' AS noted_at FROM g, range(24 * 40) r(n))
SELECT symbol, 'silent' AS status, ts AS silent_from, noted_at, round(epoch(noted_at - ts), 4) AS seconds FROM a, seen
WHERE CASE WHEN following IS NULL THEN (epoch_ms(noted_at) // 3600000 + 1) * 3600000 <= mark ELSE noted_at < following END
UNION ALL SELECT symbol, 'returned', ts, following, round(epoch(following - ts), 4) FROM g WHERE epoch(following - ts) > 5400
""", ("prints",))
def _(spark, sf):
    """Every alert of a silent feed, also of one that never speaks again."""
    return rounded(jobs.complete(ordered.feed_silence(prints(spark, sf), 5400, 3600, LATE, forget_seconds=60 * 86_400)), 4)


@query("stream_heartbeat_sessions", """
WITH b AS (SELECT runner, ts, feed_age_s, coalesce(epoch(ts - lag(ts) OVER (PARTITION BY runner ORDER BY ts)) >= 3600, true) AS fresh FROM journal WHERE event = 'heartbeat'),
i AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY runner ORDER BY ts) AS island FROM b)
SELECT runner, min(ts) AS first_beat, max(ts) AS last_beat, count(*) AS beats, max(feed_age_s) AS feed_age_max FROM i GROUP BY runner, island
""", ("journal",))
def _(spark, sf):
    return jobs.complete(jobs.heartbeat_sessions(journal(spark, sf), "1 hour", LATE))


def journal(spark, sf):
    e = raw_events(spark, sf)
    kind, k, u = F.col("event_type"), F.get_json_object("props", "$.k").cast("double"), F.col("user_id")
    return e.select("ts", F.when(u % 2 == 0, "alpha").otherwise("beta").alias("runner"),
                    F.when(kind == "view", "heartbeat").when(kind == "click", "decision").when(kind == "purchase", "fill")
                    .when(kind == "error", "loop_error").otherwise("roll").alias("event"), F.when(kind == "view", k).alias("feed_age_s"))


@query("stream_event_counts", """
WITH w AS (SELECT time_bucket(INTERVAL '6 hours', ts) - o * INTERVAL '6 hours' AS from_ts, event FROM journal, range(4) r(o))
SELECT from_ts, from_ts + INTERVAL '24 hours' AS to_ts, event, count(*) AS n FROM w GROUP BY ALL
""", ("journal",))
def _(spark, sf):
    return jobs.complete(jobs.event_counts(journal(spark, sf), "24 hours", "6 hours", LATE))


def journal_folder(spark, sf):
    """The journal as JSON-line files of which every eleventh line is cut short."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/journal-{uuid.uuid4().hex}"
    whole = q_ops.journal(spark, sf)
    lines = SF.journal_lines(whole.filter(F.col("seq") % 11 != 0))
    cut = SF.journal_lines(whole.filter(F.col("seq") % 11 == 0))
    cut = cut.select(F.expr("substring(value, 1, length(value) div 2)").alias("value"))
    lines.union(cut).write.text(path)
    return path


@query("journal_files", """
SELECT event, count(*) AS n, round(sum(equity), 4) AS equity, max(ts) AS last_ts, count(*) FILTER (status = 'filled') AS filled FROM journal WHERE seq % 11 <> 0 GROUP BY event
UNION ALL SELECT '(unreadable)', count(*), NULL, NULL, 0 FROM journal WHERE seq % 11 = 0
""", ("journal",))
def _(spark, sf):
    """A journal read from its files: what the readable lines say, and how many cannot be read."""
    good, bad = SF.split_records(SF.journal_records(spark.read.text(journal_folder(spark, sf))))
    d = good.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.sum("equity").alias("equity"), F.max("ts").alias("last_ts"),
                                  F.sum(F.when(F.col("status") == "filled", 1).otherwise(0)).alias("filled"))
    cut = bad.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("(unreadable)").alias("event"), "n", F.lit(None).cast("double").alias("equity"),
        F.lit(None).cast("timestamp").alias("last_ts"), F.lit(0).cast("long").alias("filled"))
    return rounded(d.unionByName(cut), 4)


@query("journal_file_tail", """
WITH w AS (SELECT time_bucket(INTERVAL '6 hours', ts) - o * INTERVAL '6 hours' AS from_ts, event FROM journal, range(4) r(o) WHERE seq % 11 <> 0)
SELECT from_ts, from_ts + INTERVAL '24 hours' AS to_ts, event, count(*) AS n FROM w GROUP BY ALL
""", ("journal",))
def _(spark, sf):
    """Counts by kind over the tail of a streamed journal folder, some files a trigger. The files of
    a folder come in no order of time, so the watermark waits for as long as one journal lasts."""
    good = SF.split_records(jobs.journal_source(spark, journal_folder(spark, sf), 4))[0]
    return jobs.complete(jobs.event_counts(good, "24 hours", "6 hours", "366 days"))


@query("stream_spread_guard", """
WITH m AS (SELECT symbol, median(spread) AS median_spread FROM quotes GROUP BY symbol)
SELECT symbol, ts, round(spread, 6) AS spread, round(spread / median_spread, 6) AS multiple FROM quotes JOIN m USING (symbol) WHERE spread / median_spread > 1.8
""", ("quotes",))
def _(spark, sf):
    from tidemark.operators.trades import exact_median_by
    from tidemark.plans.q_screen import quotes
    med = exact_median_by(quotes(spark, sf), ["symbol"], F.col("spread"), "median_spread")
    live = prints(spark, sf).withColumn("spread", F.col("price") * 1.0005 + F.col("size") / 1000 - F.col("price"))
    return rounded(jobs.drain(jobs.spread_guard(live, med, 1.8).select("symbol", "ts", "spread", "multiple")))


@query("stream_quote_profile", """
SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, count(*) AS samples, round(avg(spread), 6) AS mean_spread, round(max(spread), 6) AS max_spread, round(avg(spread / 0.01), 4) AS mean_points
FROM (SELECT p.symbol, p.ts, p.price * 1.0005 + p.size / 1000 - p.price AS spread, p.size FROM prints p) WHERE size * 2 <= 120 GROUP BY 1, 2
""", ("prints",))
def _(spark, sf):
    q = prints(spark, sf).select(
        "symbol", "ts", (F.col("price") * 1.0005 + F.col("size") / 1000 - F.col("price")).alias("spread"), F.lit(0.01).alias("point"),
        F.timestamp_micros(F.unix_micros("ts") + (F.col("size") * 2).cast("long") * 1_000_000).alias("ingest_ts"))
    return rounded(jobs.complete(jobs.quote_profile(q, 120, LATE)), mean_points=4)


@query("stream_session_book", """
WITH b AS (SELECT symbol AS account, ts, seq, (price - 45) * size AS pnl, 100000 + (price - 45) * size AS equity, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS n FROM prints)
SELECT account, seq, round(equity, 6) AS equity, round(first_value(equity) OVER (PARTITION BY account, CAST(ts AS DATE) ORDER BY ts, seq), 6) AS day_start_equity,
 round(greatest(max(equity) OVER (PARTITION BY account ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 100000), 6) AS high_water_equity,
 n - coalesce(max(CASE WHEN pnl >= 0 THEN n END) OVER (PARTITION BY account ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 0) AS streak FROM b
""", ("prints",))
def _(spark, sf):
    pnl = (F.col("price") - 45) * F.col("size")
    s = prints(spark, sf).select(F.col("symbol").alias("account"), "ts", "seq", (100000 + pnl).alias("equity"), pnl.alias("pnl"))
    return rounded(jobs.complete(ordered.session_book(s, 100_000.0, LATE, width=DAY)))


@query("stream_allocator_feed", """
SELECT symbol, ts, round(cash, 6) AS cash, CAST(least(count(cash) OVER w, 126) AS BIGINT) AS history, round(CASE WHEN count(cash) OVER t > 1 THEN stddev_samp(cash) OVER t END, 6) AS sigma FROM
(SELECT symbol, ts, (close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)) * 5 AS cash FROM bars_h1) WHERE cash IS NOT NULL
WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)
""", ("bars_h1",))
def _(spark, sf):
    """The bar table itself is streamed: completed bars are files of their own."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/closed-{uuid.uuid4().hex}"
    b = B.ohlcv(V.prints(spark, sf), "1 hour").select("symbol", "ts", "close", F.lit(5.0).alias("value_per_unit"))
    b.write.parquet(path)
    live = spark.readStream.schema(b.schema).parquet(path)
    return rounded(jobs.complete(ordered.allocator_feed(live, 126, LATE, width=DAY)))
