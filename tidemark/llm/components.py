"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Edges up to which a step is one task, which needs no exchange.
FEW = 100_000


def _least(sym: DataFrame) -> DataFrame:
    """For each u its least neighbour or itself."""
    return sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    """Greater neighbours of each node are tied to its least one."""
    sym = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    return (sym.join(_least(sym), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small(edges: DataFrame) -> DataFrame:
    """Lesser neighbours of each node, and the node, are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(low, "u")
    return tied.select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """`edges` (u, v: long) -> node, component: the least node reachable, for every node that has
    an edge to another one. Nulls, loops and repeated edges are ignored; without edges the result
    is empty.

    Every step stores its edges in the shared folder, so lineage stays short. Steps end once the
    edges are stars, which takes about log(n) of them. A step over few edges is one task: it leaves
    no files of exchanges, however many partitions a shuffle has.
    """
    now = materialize(edges.where("u is not null and v is not null and u <> v").select(
        F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).distinct())

    def sign(df):
        return df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()[:]

    before = None
    while (mark := sign(now)) != before and mark[0]:
        before = mark
        now = materialize(_small(_large(now.coalesce(1) if mark[0] <= FEW else now)))
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
