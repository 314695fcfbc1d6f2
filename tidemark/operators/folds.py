"""Purged cross-validation folds. Observations carry t0, t1 and are ordered by `order`."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import chunks


def positions(obs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """1-based position and count per key, at any size."""
    c = chunks.ordered_chunks(obs, keys, order)
    return chunks.running_row_number(c, keys, order, "pos", "n_obs").drop(chunks.CHUNK)


def with_blocks(obs: DataFrame, keys: list[str], order: list[str], k: int, name: str = "block") -> DataFrame:
    """Contiguous blocks, the larger ones first."""
    return positions(obs, keys, order).withColumn(name, chunks.array_split_id(F.col("pos"), F.col("n_obs"), k))


def block_bounds(blocked: DataFrame, keys: list[str], embargo_pct: float) -> DataFrame:
    """First start, last end (embargo included) and size of each block: k rows per key."""
    emb = F.floor(F.col("n_obs") * embargo_pct)
    return blocked.groupBy(*keys, "block", "n_obs").agg(
        F.min("t0").alias("lo"), F.max("t1").alias("hi"), (F.max("t1") + F.max(emb)).alias("hi_embargo"),
        F.count(F.lit(1)).alias("test_n"))


def _clean(lo, hi) -> Column:
    return (F.col("t1") < lo) | (F.col("t0") > hi)


def purged_kfold(obs: DataFrame, keys: list[str], order: list[str], k: int = 5, embargo_pct: float = 0.01) -> DataFrame:
    """Every observation once per fold, with role test, train or purged.

    The bounds travel as one short array per key; each row is expanded over the k folds."""
    b = with_blocks(obs, keys, order, k)
    bounds = block_bounds(b, keys, embargo_pct).groupBy(*keys).agg(
        F.collect_list(F.struct("block", "lo", "hi", "hi_embargo")).alias("_b"))
    d = _attach(b, bounds, keys).withColumn("_f", F.explode("_b")).drop("_b")
    role = (F.when(F.col("block") == F.col("_f.block"), "test")
            .when(_clean(F.col("_f.lo"), F.col("_f.hi_embargo")), "train").otherwise("purged"))
    leak = (F.col("block") != F.col("_f.block")) & (F.col("t1") >= F.col("_f.lo")) & (F.col("t0") <= F.col("_f.hi"))
    return d.select(*[c for c in b.columns], F.col("_f.block").alias("fold"), role.alias("role"), leak.alias("leaks"))


def _attach(df: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Add the one column of a frame with one row per key; without keys it is a single value."""
    return df.join(per_key, keys) if keys else df.withColumn(per_key.columns[0], per_key.scalar())


def leakage_report(folds: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: training rows with and without purging, share removed, leaks avoided, mean span."""
    per = folds.groupBy(*keys, "fold").agg(
        F.sum(F.when(F.col("role") == "train", 1).otherwise(0)).alias("kept"),
        F.sum(F.when(F.col("role") != "test", 1).otherwise(0)).alias("naive"),
        F.sum(F.when(F.col("leaks"), 1).otherwise(0)).alias("leaks"),
        F.avg(F.col("t1") - F.col("t0")).alias("span"))
    return per.groupBy(*keys).agg(
        F.avg("kept").alias("mean_kept"), F.avg("naive").alias("mean_naive"),
        (1 - F.avg("kept") / F.avg("naive")).alias("removed_share"), F.sum("leaks").alias("leaks"),
        F.avg("span").alias("mean_span"))


def combinatorial(obs: DataFrame, keys: list[str], order: list[str], groups: int = 6, test_groups: int = 2,
                  embargo_pct: float = 0.01) -> DataFrame:
    """Every combination of test groups; a row trains only if it is clean of every test block."""
    b = with_blocks(obs, keys, order, groups)
    bounds = block_bounds(b, keys, embargo_pct).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("block", F.struct("lo", "hi_embargo").alias("v")))).alias("_b"))
    combos = [F.struct(F.lit(i).alias("path"), F.array(*[F.lit(g) for g in c]).alias("test"))
              for i, c in enumerate(combinations(range(groups), test_groups))]
    d = _attach(b, bounds, keys).withColumn("_c", F.explode(F.array(*combos)))
    clean = F.forall("_c.test", lambda g: (F.col("t1") < F.col("_b")[g]["lo"]) | (F.col("t0") > F.col("_b")[g]["hi_embargo"]))
    role = F.when(F.array_contains("_c.test", F.col("block")), "test").when(clean, "train").otherwise("purged")
    return d.select(*b.columns, F.col("_c.path").alias("path"), role.alias("role"))


def time_split(obs: DataFrame, cut) -> tuple[DataFrame, DataFrame]:
    """Train on what resolved before the cut, test on what began at or after it."""
    return obs.filter(F.col("t1") < cut), obs.filter(F.col("t0") >= cut)
