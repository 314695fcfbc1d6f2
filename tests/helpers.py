"""Small literal frames."""

import random
from datetime import datetime, timedelta

BAR = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def walk_bars(spark, n=600, seed=4, start=1.08, step=0.004, symbols=("A",), minutes=1440):
    rnd = random.Random(seed)
    rows = []
    for s in symbols:
        px = start
        for i in range(n):
            o = px
            px = max(px + rnd.gauss(0, step), start * 0.3)
            hi, lo = max(o, px) + rnd.random() * step, min(o, px) - rnd.random() * step
            rows.append((s, datetime(2022, 1, 3) + timedelta(minutes=minutes * i), o, hi, lo, px, 100.0 + i))
    return spark.createDataFrame(rows, BAR)


def close_bars(spark, closes, symbol="A", minutes=1440):
    rows, prev = [], closes[0]
    for i, c in enumerate(closes):
        rows.append((symbol, datetime(2024, 1, 1) + timedelta(minutes=minutes * i), float(prev),
                     max(prev, c) + 0.002, min(prev, c) - 0.002, float(c), 100.0))
        prev = c
    return spark.createDataFrame(rows, BAR)


def col(df, name, order="ts"):
    return [r[name] for r in df.orderBy(order).collect()]
