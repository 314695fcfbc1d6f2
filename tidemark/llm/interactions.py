"""Interaction audit of document filters, from one relation of failing ids per filter.

Every filter stores the ids of the rows that fail it. A table of row ids is then split by one
relation after another: a left-semi join finds the rows that fail, a left-anti join those that
survive, so that after the last relation every row lies in the cell of exactly those filters that
it fails. Relations of labels split the cells in the same way. A prefix of an order removes a set
of filters, and its survivors, removals, redundancies and label losses are sums of cells; the work
is two joins of ids per relation, however many orders are asked for.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import stored

#: More filters than this make more orders than a report can hold.
MOST = 7
BLANKS = "\t\n\x0b\x0c\r"
SIGNS = "[#$%&*|]"


def measured(documents: DataFrame) -> DataFrame:
    """One pass over the texts: row, doc_id, part, one boolean per content filter (a: under 200
    words, b: fewer than half of the words distinct, c: over 2 % capitals A-Z, d: holds one of
    #$%&*|) and the digest of the text. `row` tells rows apart that repeat a doc_id or have none;
    it is fixed once the table is stored."""
    text = F.coalesce("text", F.lit(""))
    d = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                         F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.filter(F.split(F.translate("text", BLANKS, " " * len(BLANKS)), " "), lambda w: w != "")
    d = d.select("row", "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), F.length("text").alias("chars"),
                 (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("capitals"),
                 F.col("text").rlike(SIGNS).alias("d"),
                 F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("k")))[0].alias("w"))
    return d.select("row", "doc_id", "part", "digest", (F.col("w.n") < 200).alias("a"),
                    (100 * F.col("w.k").cast("long") < 50 * F.col("w.n").cast("long")).alias("b"),
                    (100 * F.col("capitals").cast("long") > 2 * F.col("chars").cast("long")).alias("c"), "d")


def later_copies(rows: DataFrame) -> DataFrame:
    """Rows whose text a smaller doc_id has: all that are left when the rows that hold the least
    doc_id of their text are taken away. The join is on text and id together, so copies of one text
    are spread over all tasks. A row without doc_id has no place in the order and never fails."""
    known = rows.where("doc_id is not null").select("row", "doc_id", "digest")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    return known.join(first, ["digest", "doc_id"], "left_anti").select("row")


def failing(rows: DataFrame) -> dict[str, DataFrame]:
    """The stored id relation of each filter, A to E."""
    out = {name: rows.where(name.lower()).select("row") for name in "ABCD"}
    return {name: stored(ids) for name, ids in {**out, "E": later_copies(rows)}.items()}


def cells(ids: DataFrame, relations: list[tuple[DataFrame, str]]) -> DataFrame:
    """`ids` with `mask`: bit i is set on the rows whose key is in relation i (a table, a key
    column). Repeated ids of a relation count once and null ones with nothing; a row of `ids` keeps
    its number of copies."""
    now = ids.withColumn("mask", F.lit(0))
    for i, (relation, key) in enumerate(relations):
        keys = relation.select(key).where(F.col(key).isNotNull()).distinct()
        fails, survives = now.join(keys, key, "left_semi"), now.join(keys, key, "left_anti")
        now = stored(fails.withColumn("mask", F.col("mask").bitwiseOR(F.lit(1 << i))).select(*now.columns).unionByName(survives.select(*now.columns)))
    return now


def audit(ids: DataFrame, filters: dict[str, tuple[DataFrame, str]], good: tuple[DataFrame, str],
          toxic: tuple[DataFrame, str], orders: list[str] | None = None) -> DataFrame:
    """Counts of every part, order and step.

    `ids` has `part` and the key columns of the relations; `filters` names each filter by one
    letter and gives its failing ids (table, key); `good` and `toxic` are relations of labels.
    `orders` are the orders to report, all of them by default. Returns part, filter_order, step,
    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, zeros included for
    every part that has a row. Without rows the result is empty.
    """
    names = list(filters)
    n = len(names)
    if not 1 <= n <= MOST or any(len(x) != 1 for x in names):
        raise ValueError(f"between one and {MOST} filters, each named by one letter")
    spark = ids.sparkSession
    split = cells(ids, [*filters.values(), good, toxic])
    sums = split.groupBy("part", "mask").agg(F.count("*").alias("rows"))
    mask = F.col("mask").bitwiseAND(F.lit((1 << n) - 1))
    has = lambda bit: (F.col("mask").bitwiseAND(F.lit(1 << bit)) != 0).cast("long") * F.col("rows")
    sums = sums.select("part", mask.alias("fails"), "rows", has(n).alias("good"), has(n + 1).alias("toxic"))

    # what a cell adds to filter f behind the set s of filters: bounded by the number of filters
    adds = [(m, s, f, int(not m & (s | 1 << f)), int(bool(m >> f & 1 and not m & s)), int(bool(m >> f & 1 and m & s)), int(m == 1 << f),
             factorial(n) // bin(m).count("1") if m >> f & 1 else 0)
            for m in range(1 << n) for f in range(n) for s in range(1 << n) if not s >> f & 1]
    adds = spark.createDataFrame(adds, "fails int, behind int, f int, stays int, goes int, again int, alone int, share int")
    of = lambda flag, count="rows": F.sum(F.col(flag) * F.col(count))
    steps = sums.join(F.broadcast(adds), "fails").groupBy("part", "behind", "f").agg(
        of("stays").alias("kept"), of("goes").alias("removed"), of("again").alias("redundant"), of("alone").alias("unique_fails"),
        of("goes", "good").alias("good_lost"), of("goes", "toxic").alias("toxic_lost"), of("share").alias("shapley"))

    asked = orders if orders is not None else ["".join(p) for p in permutations(names)]
    places = [(o, k + 1, sum(1 << names.index(x) for x in o[:k]), names.index(x)) for o in asked for k, x in enumerate(o)]
    places = spark.createDataFrame(places, "filter_order string, step int, behind int, f int")
    return steps.join(F.broadcast(places), ["behind", "f"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over `documents` (doc_id, text, source) and `labels` (doc_id,
    quality, toxic), one part per source.

    A null text is empty and fails A only (and E behind a smaller id without text); a null source is the empty string; rows that repeat a
    doc_id count one by one, are no copies of each other, and all have its labels; a row without
    doc_id has no label and never fails E. A doc_id that is labelled more than once is good (toxic)
    if one of its rows says so. Other columns are ignored.
    """
    rows = stored(measured(documents))
    relations = {name: (ids, "row") for name, ids in failing(rows).items()}
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
    return audit(rows.select("row", "doc_id", "part"), relations, (named.where("quality = 1"), "doc_id"), (named.where("toxic = 1"), "doc_id"))
