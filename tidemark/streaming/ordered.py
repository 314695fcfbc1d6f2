"""Keyed folds over a stream in event-time order, and watches on feeds that fall silent.

Rows wait in a buffer per key, cut along the clock into buckets; an event-time timer at the end of a
bucket fires once the watermark has passed it, and the buckets passed are folded in time order. A row that
arrives late, but within the watermark, therefore counts exactly as in a batch over the whole table.
A fold sees one bucket of one key at a time and keeps a few numbers between buckets.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# Workers get these classes by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fold of one bucket: (key, rows in order, state or None) -> (rows out or None, new state).
Fold = Callable[[tuple, pd.DataFrame, tuple | None], tuple[pd.DataFrame | None, tuple]]


def pack(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(found: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(found).read_pandas()


def micros(ts: pd.Series) -> np.ndarray:
    return ts.astype("datetime64[us]").astype("int64").to_numpy()


class OrderedFold(StatefulProcessor):
    """Buffer, timers and fold. `width` is a bucket in milliseconds."""

    def __init__(self, fold: Fold, state: str, order: list[str], width: int):
        self.fold, self.state, self.order, self.width = fold, state, order, width

    def init(self, handle) -> None:
        self.handle = handle
        self.buffer = handle.getMapState("buffer", "bucket long", "packed binary")
        self.folded = handle.getValueState("folded", self.state)

    def handleInputRows(self, key, rows, timerValues):
        found = [r for r in rows if len(r)]
        if found:
            rows = pd.concat(found, ignore_index=True) if len(found) > 1 else found[0]
            at = micros(rows["ts"]) // (1000 * self.width)
            for bucket in np.unique(at).tolist():
                part = rows[at == bucket]
                if self.buffer.containsKey((bucket,)):
                    part = pd.concat([unpack(self.buffer.getValue((bucket,))[0]), part], ignore_index=True)
                self.buffer.updateValue((bucket,), (pack(part),))
                self.handle.registerTimer((bucket + 1) * self.width)
        return iter(())

    def release(self, key, passed: int):
        """Fold, in the order of time, every bucket that ends by `passed`."""
        for bucket in sorted(k[0] for k in self.buffer.keys()):
            if (bucket + 1) * self.width > passed:
                break
            rows = unpack(self.buffer.getValue((bucket,))[0]).sort_values(self.order, kind="stable", ignore_index=True)
            self.buffer.removeKey((bucket,))
            out, new = self.fold(key, rows, tuple(self.folded.get()) if self.folded.exists() else None)
            self.folded.update(new)
            if out is not None and len(out):
                yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # the first timer of a key releases all that the watermark has passed, later ones find nothing
        yield from self.release(key, timerValues.getCurrentWatermarkInMs())

    def finish(self, key, left: list[pd.DataFrame], state: tuple | None) -> pd.DataFrame:
        """What rows still buffered at the end of a stream add."""
        if not left:
            return pd.DataFrame()
        rows = pd.concat(left, ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True)
        out, _ = self.fold(key, rows, state)
        return pd.DataFrame() if out is None else out

    def close(self) -> None:
        pass


class Ordered:
    """A fold over a stream in event-time order: `frame` is the stream of its results, and
    `closing` gives what the rows still buffered after the stream has ended add to them."""

    def __init__(self, rows: DataFrame, key: str, fold: Fold, state: str, schema: str, lateness: str,
                 order: tuple[str, ...] = ("ts",), width: int = 3_600_000, processor: Callable[..., OrderedFold] = OrderedFold):
        self.key, self.fold, self.state, self.schema, self.order = key, fold, state, schema, list(order)
        self.processor = processor(fold, state, self.order, width)
        self.grouped = self.frame = rows.withWatermark("ts", lateness).groupBy(key).transformWithStateInPandas(self.processor, schema, "append", "EventTime")

    @staticmethod
    def finish(results: DataFrame) -> DataFrame:
        return results

    def closing(self, spark: SparkSession, checkpoint: str) -> DataFrame:
        """Only rows younger than the watermark are left, so a key's remainder is small."""
        read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
        left = read("buffer").select(F.col(f"key.{self.key}").alias(self.key), F.col("user_map_value.packed").alias("packed"))
        done = read("folded").select(F.col(f"key.{self.key}").alias(self.key), F.col("value").alias("folded"))
        processor = self.processor

        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            state = rows["folded"].iloc[0]
            return processor.finish(key, [unpack(p) for p in rows["packed"] if p is not None], None if state is None else tuple(state.values() if isinstance(state, dict) else state))

        return done.join(left, self.key, "full").groupBy(self.key).applyInPandas(run, self.schema)


# ---- folds

def session_fold(start: float, key: str) -> Fold:
    """Day-start equity, running high-water mark and losing streak after each snapshot."""
    def fold(k, rows, state):
        day0, opened0, high0, streak0 = state or (-1, start, start, 0)
        equity, pnl = rows["equity"].to_numpy(), rows["pnl"].to_numpy()
        day = micros(rows["ts"]) // 86_400_000_000
        new = np.r_[day[0] != day0, day[1:] != day[:-1]]
        opened = equity[np.maximum.accumulate(np.where(new, np.arange(len(day)), 0))]
        opened = np.where(np.cumsum(new) > 0, opened, opened0)
        high = np.maximum(np.maximum.accumulate(equity), high0)
        at = np.arange(1, len(pnl) + 1)
        last_win = np.maximum.accumulate(np.where(pnl < 0, -streak0, at))
        streak = at - last_win
        out = pd.DataFrame({key: k[0], "seq": rows["seq"], "equity": equity, "day_start_equity": opened, "high_water_equity": high, "streak": streak})
        return out, (int(day[-1]), float(opened[-1]), float(high[-1]), int(streak[-1]))
    return fold


def allocator_fold(window: int, key: str) -> Fold:
    """One cash change per completed bar, and the deviation of the trailing window."""
    def fold(k, rows, state):
        prev, hist = state or (None, [])
        close, vpu = rows["close"].to_numpy(), rows["value_per_unit"].to_numpy()
        before = np.r_[np.nan if prev is None else prev, close[:-1]]
        first = int(prev is None)
        change = ((close - before) * vpu)[first:]
        every = np.r_[np.array(hist, np.float64), change]
        sd = pd.Series(every).rolling(window, min_periods=2).apply(lambda x: x.std(ddof=1), raw=True).to_numpy()[len(hist):]
        count = np.minimum(np.arange(len(hist) + 1, len(every) + 1), window)
        out = pd.DataFrame({key: k[0], "ts": rows["ts"].to_numpy()[first:], "cash": change, "history": count, "sigma": sd})
        out["sigma"] = out["sigma"].astype(object).where(out["sigma"].notna(), None)
        return out, (float(close[-1]), [float(x) for x in every[-window:]])
    return fold


def session_book(snapshots: DataFrame, start: float, lateness: str, key: str = "account", width: int = 3_600_000) -> Ordered:
    """snapshots: key, seq, ts, equity, pnl; ordered by time, then seq."""
    return Ordered(snapshots.select(key, "seq", "ts", "equity", "pnl"), key, session_fold(start, key), "day long, opened double, high double, streak long",
                   f"{key} string, seq long, equity double, day_start_equity double, high_water_equity double, streak long", lateness, ("ts", "seq"), width)


def allocator_feed(bars: DataFrame, window: int, lateness: str, key: str = "symbol", width: int = 86_400_000) -> Ordered:
    """bars: key, ts, close, value_per_unit."""
    return Ordered(bars.select(key, "ts", "close", "value_per_unit"), key, allocator_fold(window, key), "prev double, hist array<double>",
                   f"{key} string, ts timestamp, cash double, history long, sigma double", lateness, ("ts",), width)


# ---- silence

ALERT = "{key} string, status string, silent_from timestamp, noted_at timestamp, seconds double"


def _alerts(key: str, name, rows: list[tuple]) -> pd.DataFrame:
    """rows: (status, silent since, at), both in microseconds."""
    since, at = (np.array([r[i] for r in rows], "int64") for i in (1, 2))
    return pd.DataFrame({key: name, "status": [r[0] for r in rows], "silent_from": pd.to_datetime(since, unit="us", utc=True),
                         "noted_at": pd.to_datetime(at, unit="us", utc=True), "seconds": (at - since) / 1e6})


def silence_fold(key: str, limit: int, again: int, forget: int) -> Fold:
    """Alerts of the silences between rows: one when the limit is reached, then one per interval until
    the feed returns, which is reported too unless it was forgotten. State: last row (microseconds),
    alerts given since."""
    def fold(k, rows, state):
        last, given = state or (None, 0)
        found = []
        ts = micros(rows["ts"])
        before = np.r_[ts[0] if last is None else last, ts[:-1]]
        for i in np.flatnonzero((ts - before > limit) | (np.arange(len(ts)) == 0)).tolist():
            since, told = int(before[i]), given if i == 0 else 0
            due = _due(since, told, min(int(ts[i]), since + forget), limit, again)
            found += due
            if (due or told) and ts[i] < since + forget:
                found.append(("returned", since, int(ts[i])))
        return (_alerts(key, k[0], found) if found else None), (int(ts[-1]), 0)
    return fold


def _due(last: int, given: int, until: int, limit: int, again: int) -> list[tuple]:
    """Alerts of a silence since `last`, those given already left out, strictly before `until`."""
    return [("silent", last, at) for at in range(last + limit + given * again, until, again)]


class SilenceFold(OrderedFold):
    """Folds the gaps between rows and, at the bucket ends that the watermark passes, alerts on keys
    that are silent now. After `forget` without a row a key's state goes and its alerts end."""

    def __init__(self, fold, state, order, width, key: str, limit: int, again: int, forget: int):
        super().__init__(fold, state, order, width)
        self.key, self.limit, self.again, self.forget = key, limit, again, forget

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() // self.width * self.width
        yield from self.release(key, now)
        if not self.folded.exists():
            return
        last, given = self.folded.get()
        end = last + self.forget
        due = _due(last, given, min(now * 1000, end), self.limit, self.again)
        if due:
            yield _alerts(self.key, key[0], due)
            given += len(due)
            self.folded.update((last, given))
        following = min(last + self.limit + given * self.again, end)
        if now * 1000 < end:
            self.handle.registerTimer((following // (1000 * self.width) + 1) * self.width)
        elif not list(self.buffer.keys()):
            self.folded.clear()


def feed_silence(ticks: DataFrame, limit_seconds: float, again_seconds: float, lateness: str, forget_seconds: float = 30 * 86_400,
                 key: str = "symbol", width: int = 3_600_000) -> Ordered:
    """Alerts on silent feeds by event time: key, status (silent, returned), silent_from, noted_at, seconds.

    A feed that stays silent alerts when the watermark of the whole stream shows that it does: at the
    limit, and again after each interval; `noted_at` is when the alert was due."""
    limit, again, forget = (int(x * 1_000_000) for x in (limit_seconds, again_seconds, forget_seconds))
    if min(limit, again) <= 0:
        raise ValueError("limit and interval must be positive")
    return Ordered(ticks.select(key, "ts"), key, silence_fold(key, limit, again, forget), "last long, given long", ALERT.format(key=key), lateness, ("ts",), width,
                   partial(SilenceFold, key=key, limit=limit, again=again, forget=forget))


class FeedWatch(StatefulProcessor):
    """Wall-clock watch: a timer at the limit, then one per interval, cancelled when the feed speaks.
    State lives as long as the feed is remembered and expires by itself."""

    def __init__(self, key: str, limit: int, again: int, forget: int):
        self.key, self.limit, self.again, self.forget = key, limit, again, forget

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, given long", ttlDurationMs=self.forget)

    def handleInputRows(self, key, rows, timerValues):
        if not sum(len(r) for r in rows):
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last, given = self.seen.get() if self.seen.exists() else (now, 0)
        self.seen.update((now, 0))
        self.handle.registerTimer(now + self.limit)
        if given:
            yield _alerts(self.key, key[0], [("returned", last * 1000, now * 1000)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.seen.exists():
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        last, given = self.seen.get()
        # writing would renew the time to live, so a feed is watched for its limit plus `forget` at most
        if now - last < self.forget:
            self.seen.update((last, given + 1))
            self.handle.registerTimer(now + self.again)
            yield _alerts(self.key, key[0], [("silent", last * 1000, now * 1000)])

    def close(self) -> None:
        pass


def feed_watch(ticks: DataFrame, limit_seconds: float, again_seconds: float, forget_seconds: float = 7 * 86_400, key: str = "symbol") -> DataFrame:
    """Live alerts on feeds from which nothing arrives, by the clock of the machine: an alert once the
    limit is reached, at most one more per interval while silence lasts, and a note on return. A key
    that has never arrived is not watched; one silent for `forget_seconds` is forgotten."""
    limit, again, forget = (int(x * 1000) for x in (limit_seconds, again_seconds, forget_seconds))
    if min(limit, again) <= 0:
        raise ValueError("limit and interval must be positive")
    return ticks.select(key).groupBy(key).transformWithStateInPandas(FeedWatch(key, limit, again, forget), ALERT.format(key=key), "append", "ProcessingTime")
