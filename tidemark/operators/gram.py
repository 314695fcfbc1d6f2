"""Sums of products of every pair of members over common periods, as blocked Gram matrices.

Members are dealt to tiles and periods to slabs, both of bounded size. A task meets the values of two
tiles in one slab as dense matrices of periods x members and multiplies them; the products of the
slabs are summed by pair. The number of members is measured, no plan grows with the number of pairs,
and neither a period's nor a member's values ever come together in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Members of a tile and periods of a slab, at most (about).
TILE, SLAB = 256, 1024
MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _tiles(members: DataFrame, tile: int) -> DataFrame:
    """member, _tile: rosters of at most about `tile` members."""
    count = F.ceil(F.lit(members.count()) / tile).cast("int")
    return members.withColumn("_tile", F.pmod(F.xxhash64("member"), F.greatest(count, F.lit(1))).cast("int"))


def _slabs(values: DataFrame, by: list[str], slab: int) -> DataFrame:
    """The periods of each group with their slab."""
    periods = values.select(*by, "period").distinct()
    n = periods.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / slab).cast("int").alias("_n")) if by else None
    periods = periods.join(n, by) if by else periods.withColumn("_n", F.ceil(F.lit(periods.count()) / slab).cast("int"))
    return periods.withColumn("_slab", F.pmod(F.xxhash64("period"), F.greatest("_n", F.lit(1))).cast("int")).drop("_n")


def _everyone(values: DataFrame, roster: DataFrame, by: list[str]) -> DataFrame:
    """All members in every group, as asked for: their pairs are the result. A tile's roster travels as
    one row and meets the groups by tile number."""
    if not by:
        return roster
    packed = roster.groupBy("_tile").agg(F.collect_list("member").alias("_who"))
    tiles = F.explode(F.lit(sorted(r["_tile"] for r in packed.select("_tile").collect()))).alias("_tile")
    return values.select(*by).distinct().select(*by, tiles).join(packed, "_tile").select(*by, "_tile", F.explode("_who").alias("member"))


def _dense(rows: pd.DataFrame, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members, values (0 where absent) and presence, by period and member."""
    members, j = np.unique(rows["member"].to_numpy(dtype=object).astype(str), return_inverse=True)
    known = rows["value"].notna().to_numpy()
    i = np.searchsorted(periods, rows["period"].to_numpy()[known])
    x, seen = np.zeros((len(periods), len(members))), np.zeros((len(periods), len(members)))
    x[i, j[known]], seen[i, j[known]] = rows["value"].to_numpy()[known], 1.0
    return members, x, seen


def pair_moments(values: DataFrame, by: tuple[str, ...] = (), every_pair: bool = False, tile: int = TILE, slab: int = SLAB) -> DataFrame:
    """values (by, period: long, member: string, value: double; one row per by, period and member) ->
    by, a, b (a < b in name order) and, over the periods where both have a value: n, sums, sums of
    squares and of products. `every_pair` also gives pairs without a common period, all members of
    the table in every group. Nulls are no values; a member without any takes part in `every_pair`."""
    by = list(by)
    values = materialize(values.select(*by, "period", "member", "value"))
    roster = _tiles(values.select("member").distinct(), tile)
    placed = values.filter("value is not null").join(roster, "member").join(_slabs(values, by, slab), [*by, "period"])
    cols = [*by, "_slab", "_tile", "member", "period", "value"]
    placed = placed.select(*cols)
    if every_pair:
        named = _everyone(values, roster, by)
        placed = placed.unionByName(named.select(*by, F.lit(0).alias("_slab"), "_tile", "member", F.lit(None).cast("long").alias("period"),
                                                 F.lit(None).cast("double").alias("value")))
    tiles = F.greatest(F.ceil(F.lit(roster.count()) / tile).cast("int"), F.lit(1))
    other = F.explode(F.sequence(F.lit(0), tiles - 1))
    met = placed.withColumn("_o", other).withColumns({"_t": F.least("_tile", "_o"), "_u": F.greatest("_tile", "_o")})
    kinds = {f.name: f.dataType.simpleString() for f in values.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "a string", "b string", "n double", *(f"{m} double" for m in MOMENTS[1:])])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        periods = np.unique(rows["period"].dropna().to_numpy()).astype("int64")
        rows = rows.assign(period=rows["period"].fillna(0).astype("int64"))
        one, two = rows[rows["_tile"] == rows["_t"]], rows[rows["_tile"] == rows["_u"]]
        (a, x, p), (b, y, q) = _dense(one, periods), _dense(two, periods)
        m = {"n": p.T @ q, "sx": x.T @ q, "sy": p.T @ y, "sxx": (x * x).T @ q, "syy": p.T @ (y * y), "sxy": x.T @ y}
        i, j = np.nonzero((m["n"] > 0) | every_pair)
        keep = a[i] != b[j] if rows["_t"].iloc[0] != rows["_u"].iloc[0] else a[i] < b[j]
        i, j = i[keep], j[keep]
        swap = a[i] > b[j]
        out = {k: np.full(len(i), v, dtype=object) for k, v in zip(by, key)}
        out |= {"a": np.where(swap, b[j], a[i]), "b": np.where(swap, a[i], b[j])}
        for name, (u, v) in {"n": ("n", "n"), "sx": ("sx", "sy"), "sy": ("sy", "sx"), "sxx": ("sxx", "syy"), "syy": ("syy", "sxx"), "sxy": ("sxy", "sxy")}.items():
            out[name] = np.where(swap, m[v][i, j], m[u][i, j])
        return pd.DataFrame(out)

    parts = met.groupBy(*by, "_slab", "_t", "_u").applyInPandas(run, schema)
    return parts.groupBy(*by, "a", "b").agg(F.sum("n").cast("long").alias("n"), *[F.sum(m).alias(m) for m in MOMENTS[1:]])


def centred(values: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Values less their member's mean: sums of products lose no digits to a common level."""
    mean = values.groupBy(*by, "member").agg(F.avg("value").alias("_mean"))
    return values.join(mean, [*by, "member"]).withColumn("value", F.col("value") - F.col("_mean")).drop("_mean")


def correlation() -> Column:
    """Pearson correlation of a row of moments; null without two periods or without movement."""
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    spread = lambda s, q: F.greatest(F.col(q) - F.col(s) * F.col(s) / n, F.lit(0.0))
    return F.try_divide(cov, F.sqrt(spread("sx", "sxx") * spread("sy", "syy")))
