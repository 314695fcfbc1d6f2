"""Digests of an append-only event journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import chunks
from tidemark.operators import quantiles

ORDER = ["ts", "seq"]


def within(journal: DataFrame, hours: float, now: Column | None = None) -> DataFrame:
    """Records of the last hours; `now` defaults to the newest record."""
    if now is None:
        now = journal.agg(F.max("ts")).scalar()
    edge = now - F.make_dt_interval(secs=F.lit(hours * 3600).cast("decimal(18,6)"))
    return journal.filter(F.col("ts") >= edge)


def counts(journal: DataFrame, keys=()) -> DataFrame:
    return journal.groupBy(*keys, "event").agg(F.count(F.lit(1)).alias("n"))


def refused_by(row_breaches: str = "breaches", note: str = "note") -> Column:
    """Limits that refused a decision; without any, the note up to its colon."""
    limits = F.coalesce(F.transform(F.col(row_breaches), lambda b: b["limit"]), F.array().cast("array<string>"))
    reason = F.split_part(F.coalesce(F.col(note), F.lit("unknown")), F.lit(":"), F.lit(1))
    return F.when(F.size(limits) > 0, limits).otherwise(F.array(reason))


def rejections_by_cause(decisions: DataFrame) -> DataFrame:
    bad = decisions.filter(~F.coalesce(F.col("approved"), F.lit(False)))
    return (bad.select(F.explode(refused_by()).alias("cause")).groupBy("cause")
            .agg(F.count(F.lit(1)).alias("n")))


def heartbeat_gaps(beats: DataFrame, min_seconds: float, keys=(), order=ORDER) -> DataFrame:
    """Neighbouring heartbeats further apart than a limit. Journals grow without bound, so the
    neighbour is found through chunks."""
    keys = list(keys)
    c = chunks.running_lag(chunks.ordered_chunks(beats.select(*keys, *order), keys, order), keys, order, "ts", "before")
    secs = (F.unix_micros("ts") - F.unix_micros("before")) / 1e6
    return c.filter(secs > min_seconds).select(*keys, "before", F.col("ts").alias("after"), (secs / 60.0).alias("minutes"))


def digest(journal: DataFrame, keys=()) -> DataFrame:
    """One pass over the window: heartbeats, halted share, equity span, feed age, decisions, fills."""
    keys = list(keys)
    ev = F.col("event")
    beat, dec, fill = ev == "heartbeat", ev == "decision", ev == "fill"

    def n(cond):
        return F.sum(F.when(cond, 1).otherwise(0))

    at = F.when(beat & F.col("equity").isNotNull(), F.struct(*ORDER))
    eq = F.when(beat, F.col("equity"))
    filled = fill & (F.col("status") == "filled")
    g = journal.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"), n(beat).alias("heartbeats"), n(beat & F.col("halted")).alias("halted"),
        F.min(F.when(beat, F.col("ts"))).alias("first_beat"), F.max(F.when(beat, F.col("ts"))).alias("last_beat"),
        F.min_by("equity", at).alias("equity_start"), F.max_by("equity", at).alias("equity_end"),
        F.min(eq).alias("equity_min"), F.max(eq).alias("equity_max"), F.max(F.when(beat, F.col("feed_age_s"))).alias("feed_age_max"),
        n(dec).alias("decisions"), n(dec & F.col("approved")).alias("approved"),
        n(fill).alias("fill_attempts"), n(filled).alias("filled"))
    # exact medians are located through buckets, so a long window never gathers in one task
    medians = {"feed_age_median": (F.when(beat, F.col("feed_age_s")), 0.5), "slippage_median": (F.when(filled, F.abs("slippage")), 0.5)}
    at = quantiles.exact_quantiles(journal, keys, medians)
    if keys:
        return g.join(at, keys, "left")
    both = at.select(F.struct(*medians).alias("_m")).scalar()
    return g.withColumn("_m", both).select("*", "_m.*").drop("_m")


def approved_by(journal: DataFrame, n: int = 8) -> DataFrame:
    """Most frequent approved (strategy, symbol, side)."""
    return (journal.filter((F.col("event") == "decision") & F.col("approved"))
            .groupBy("strategy", "symbol", "side").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "strategy", "symbol", "side").limit(n))


def last_errors(journal: DataFrame, kinds: list[str]) -> DataFrame:
    """Count and latest message per kind of trouble."""
    msg = F.coalesce(F.col("error"), F.col("reason"), F.lit(""))
    return (journal.filter(F.col("event").isin(*kinds)).groupBy("event")
            .agg(F.count(F.lit(1)).alias("n"), F.max_by(msg, F.struct(*ORDER)).alias("last")))


def freshness(journal: DataFrame, now: Column, max_age_minutes: float, keys=()) -> DataFrame:
    """Age of the last heartbeat against its limit."""
    beats = journal.filter(F.col("event") == "heartbeat")
    at = F.struct(*ORDER)
    g = beats.groupBy(*keys).agg(F.max("ts").alias("last_beat"), F.count(F.lit(1)).alias("heartbeats"),
                                 F.max_by("equity", at).alias("equity"), F.max_by("halted", at).alias("halted"))
    age = (F.unix_timestamp(now) - F.unix_timestamp("last_beat")) / 60.0
    return g.withColumn("age_minutes", age).withColumn(
        "status", F.when(age <= max_age_minutes, "OK").otherwise("FAIL"))


def runner_digest(journal: DataFrame, poll_minutes: float) -> DataFrame:
    """Per runner: heartbeats, halted share, equity change and gaps beyond three polls."""
    d = digest(journal, ["runner"])
    gaps = (heartbeat_gaps(journal.filter(F.col("event") == "heartbeat"), poll_minutes * 180.0, ["runner"])
            .groupBy("runner").agg(F.count(F.lit(1)).alias("gaps"), F.max("minutes").alias("longest_gap")))
    return (d.join(gaps, "runner", "left").fillna(0, ["gaps"])
            .select("runner", "heartbeats", "halted", "gaps", "longest_gap", "decisions", "filled",
                    F.try_divide(F.col("equity_end") - F.col("equity_start"), F.col("equity_start")).alias("equity_change")))


def state_changes(watchdog: DataFrame, keys=("runner",)) -> DataFrame:
    """Problem checks by state, with when each was first and last seen."""
    return (watchdog.groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"),
                                                 F.max("ts").alias("last_seen")))


def forward_report(journal: DataFrame, keys: list[str]) -> DataFrame:
    """What a running record shows: counts, rolls, calendar span and equity from first to last."""
    ev, at = F.col("event"), F.when(F.col("equity").isNotNull(), F.struct(*ORDER))
    beat = F.when(ev == "heartbeat", F.col("ts"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return journal.groupBy(*keys).agg(
        n(ev == "heartbeat").alias("heartbeats"), n(ev == "decision").alias("decisions"), n(F.col("status") == "filled").alias("filled"),
        n(F.col("approved")).alias("approved"), n(ev.isin("roll", "shadow_roll")).alias("rolls"),
        F.floor((F.unix_micros(F.max(beat)) - F.unix_micros(F.min(beat))) / 86_400_000_000).cast("long").alias("span_days"),
        F.min_by("equity", at).alias("equity_start"), F.max_by("equity", at).alias("equity_end"))


def status(journal: DataFrame, now: Column, max_age_seconds: int, recent: int, keys: list[str]) -> DataFrame:
    """Running and halted flags and the make-up of the newest records.

    Spark keeps only `recent` rows per key in each map task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in ORDER])
    d = journal.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= recent)
    ev = F.col("event")
    beat = F.when(ev == "heartbeat", F.col("ts"))
    age = F.unix_timestamp(now) - F.unix_timestamp(F.max(beat))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return d.groupBy(*keys).agg(
        F.max(beat).alias("last_beat"), (age < max_age_seconds).alias("running"), F.max_by("halted", F.when(ev == "heartbeat", F.struct(*ORDER))).alias("halted"),
        n(ev == "decision").alias("recent_decisions"), n(ev == "fill").alias("recent_fills"))
