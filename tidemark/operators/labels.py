"""Event labels by first barrier touched, and their overlap weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def index_bars(bars: DataFrame, keys=("symbol",)) -> DataFrame:
    """0-based bar index per key, and the key's bar count."""
    w = Window.partitionBy(*keys)
    return bars.withColumn("idx", F.row_number().over(w.orderBy("ts")) - 1).withColumn(
        "n_bars", F.count(F.lit(1)).over(w))


def _levels(page: Column, field: str, better, depth: int) -> Column:
    """Extremes of a page over runs of 1, 2, 4, ... bars: level L holds one value per 2^L bars."""
    def halve(level: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.ceil(F.size(level) / 2).cast("int") - 1)
        return F.transform(pairs, lambda j: better(F.get(level, 2 * j), F.get(level, 2 * j + 1)))

    leaves = F.transform(page, lambda p: p[field])
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(leaves), lambda levels, _: F.concat(levels, F.array(halve(F.element_at(levels, -1)))))


def pages(bars: DataFrame, span: int, keys=("symbol",)) -> DataFrame:
    """Bars in pages of 2 x span, each overlapping the next by half, so that what follows any bar for
    `span` bars lies in the page that begins at or before it: keys, _page, open and close by offset,
    and the low and high extremes of every aligned run. Bars are numbered from 0 without gaps (idx)."""
    depth = span.bit_length()  # span is a power of two, a page has 2 * span bars
    own = F.floor(F.col("idx") / span)
    d = bars.select(*keys, F.explode(F.array(own, own - 1)).alias("_page"), F.struct("idx", "open", "high", "low", "close").alias("_bar"))
    d = d.filter("_page >= 0").groupBy(*keys, "_page").agg(F.array_sort(F.collect_list("_bar")).alias("_bars"))
    return d.select(*keys, "_page", F.transform("_bars", lambda p: p["open"]).alias("_open"), F.transform("_bars", lambda p: p["close"]).alias("_close"),
                    _levels(F.col("_bars"), "low", F.least, depth).alias("_low"), _levels(F.col("_bars"), "high", F.greatest, depth).alias("_high"))


def first_touch(start: Column, below: Column, above: Column, depth: int) -> Column:
    """Offset of the first bar of a page at or after `start` whose low is at most `below` or whose high
    is at least `above`; null without one. First up: the aligned runs that tile what follows `start`
    are tried from the shortest on. Then down: the run that holds a touch is halved."""
    def touches(level: Column, run: Column) -> Column:
        low, high = F.get(F.get(F.col("_low"), level), run), F.get(F.get(F.col("_high"), level), run)
        return F.coalesce(low <= below, F.lit(False)) | F.coalesce(high >= above, F.lit(False))

    state = lambda pos, level, run: F.struct(pos.cast("int").alias("pos"), level.cast("int").alias("level"), run.cast("int").alias("run"))
    none = F.lit(-1)

    def up(s: Column, level: Column) -> Column:
        run = F.call_function("shiftright", s["pos"], level)
        odd = run.bitwiseAND(F.lit(1)) == 1
        after = F.call_function("shiftleft", run + F.when(odd, 1).otherwise(0), level)
        return (F.when(s["level"] >= 0, s).when(odd & touches(level, run), state(s["pos"], level, run))
                .otherwise(state(after, none, none)))

    def down(s: Column, level: Column) -> Column:
        left = s["run"] * 2
        return F.when(s["level"] != level, s).otherwise(
            state(s["pos"], level - 1, F.when(touches(level - 1, left), left).otherwise(left + 1)))

    begin = state(start, none, none)
    whole = F.when((start == 0) & touches(F.lit(depth), F.lit(0)), state(start, F.lit(depth), F.lit(0))).otherwise(begin)
    risen = F.aggregate(F.sequence(F.lit(0), F.lit(depth - 1)), whole, up)
    return F.aggregate(F.sequence(F.lit(depth), F.lit(1)), risen, down, lambda s: F.when(s["level"] == 0, s["run"]))


def triple_barrier(events: DataFrame, bars: DataFrame, profit_multiple: float = 2.0, max_bars: int = 20,
                   min_return: float = 0.0, keys=("symbol",), event_keys=()) -> DataFrame:
    """Entry at the next open; the stop wins inside a bar; else the close at the time limit.

    events: keys, event_keys, i, side, stop_distance. bars: keys, idx, OHLC. An event meets its whole
    path in one equi-join on (key, page) and descends to its first touch in steps of the logarithm of
    the path; every bar is in two pages, however long a trade may be held."""
    keys, ids = list(keys), [*keys, *event_keys, "i", "side", "stop_distance"]
    span = 1 << max_bars.bit_length()  # a power of two above max_bars
    depth = span.bit_length()
    entry = F.col("i") + 1
    e = (events.filter(F.col("stop_distance") > 0).select(*ids, entry.alias("entry_i"), F.floor(entry / span).alias("_page"))
         .join(pages(bars, span, keys), [*keys, "_page"]))
    e = e.withColumn("_at", (F.col("entry_i") - F.col("_page") * span).cast("int")).filter(F.col("_at") < F.size("_open"))
    e = e.withColumn("entry", F.get("_open", "_at"))
    long, risk = F.col("side") > 0, F.col("stop_distance") * F.col("side")
    stop, target = F.col("entry") - risk, F.col("entry") + risk * profit_multiple
    below, above = F.when(long, stop).otherwise(target), F.when(long, target).otherwise(stop)
    e = e.select(*ids, "entry_i", "entry", "_at", "_close", stop.alias("_stop"), target.alias("_target"), "_low", "_high",
                 F.least(F.col("_at") + max_bars, F.size("_close") - 1).alias("_last"),
                 first_touch(F.col("_at"), below, above, depth).alias("_touch"))
    hit = F.col("_touch").isNotNull() & (F.col("_touch") <= F.col("_last"))
    worst = F.when(long, F.get(F.get("_low", F.lit(0)), "_touch") <= F.col("_stop")).otherwise(F.get(F.get("_high", F.lit(0)), "_touch") >= F.col("_stop"))
    # how it ended: bound once, or the descent would be worked out anew in every column
    end = F.transform(F.array(F.struct(hit.alias("hit"), worst.alias("stopped"), F.col("_touch").alias("touch"))), lambda s: F.struct(
        (F.col("entry_i") + F.when(s["hit"], s["touch"]).otherwise(F.col("_last")) - F.col("_at")).alias("t1"),
        F.when(~s["hit"], "time").when(s["stopped"], "stop").otherwise("target").alias("touched"),
        F.when(~s["hit"], F.get("_close", "_last")).when(s["stopped"], F.col("_stop")).otherwise(F.col("_target")).alias("exit")))
    d = e.select(*ids, "entry_i", "entry", F.inline(end))
    d = d.withColumn("ret", (F.col("exit") - F.col("entry")) * F.col("side") / F.col("stop_distance"))
    return d.withColumn("label", F.when(F.col("ret") > min_return, 1).otherwise(0))


def sample_weights(labels: DataFrame, keys=("symbol",)) -> DataFrame:
    """Mean inverse concurrency over each label's span, scaled to mean 1 per key.

    Concurrency is a running sum of span starts and ends over the key's bars, and a span's mean
    is a difference of two running totals: every label is looked up twice, never expanded."""
    keys = list(keys)
    edge = F.explode(F.array(F.struct(F.col("entry_i").cast("long").alias("idx"), F.lit(1).alias("d")),
                             F.struct((F.col("t1") + 1).cast("long").alias("idx"), F.lit(-1).alias("d"))))
    steps = (labels.select(*keys, edge.alias("e")).groupBy(*keys, F.col("e.idx").alias("idx"))
             .agg(F.sum("e.d").alias("d")))
    w = Window.partitionBy(*keys).orderBy("idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # between two edges concurrency is constant: a run of `len` bars adds len / concurrency
    runs = (steps.withColumn("_c", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_len", F.lead("idx").over(w) - F.col("idx")))
    runs = runs.withColumn("_add", F.when(F.col("_c") > 0, F.col("_len") / F.col("_c")).otherwise(0.0))
    cum = runs.select(*keys, "idx", F.coalesce(F.sum("_add").over(before), F.lit(0.0)).alias("_cum"))
    a = cum.select(*keys, F.col("idx").alias("entry_i"), F.col("_cum").alias("_a"))
    b = cum.select(*keys, (F.col("idx") - 1).alias("t1"), F.col("_cum").alias("_b"))
    d = labels.join(a, [*keys, "entry_i"]).join(b, [*keys, "t1"])
    d = d.withColumn("_w", (F.col("_b") - F.col("_a")) / (F.col("t1") - F.col("entry_i") + 1))
    total = d.groupBy(*keys).agg(F.sum("_w").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    return (d.join(total, keys).withColumn("weight", F.when(F.col("_sum") > 0, F.col("_w") * F.col("_n") / F.col("_sum"))
                                           .otherwise(F.col("_w"))).drop("_a", "_b", "_w", "_sum", "_n"))


def label_summary(labels: DataFrame, keys=("symbol",)) -> DataFrame:
    """Counts per barrier, positive share, mean and median R, and an imbalance flag."""
    from tidemark.operators.quantiles import exact_median
    n = F.count(F.lit(1))
    share = F.avg("label")
    g = labels.groupBy(*keys).agg(
        n.alias("labels"), share.alias("positive"), F.avg("ret").alias("mean_r"),
        *[F.sum(F.when(F.col("touched") == t, 1).otherwise(0)).alias(f"n_{t}") for t in ("target", "stop", "time")])
    return (g.join(exact_median(labels, list(keys), "ret", "median_r"), list(keys))
            .withColumn("imbalanced", (F.col("positive") < 0.15) | (F.col("positive") > 0.85)))
