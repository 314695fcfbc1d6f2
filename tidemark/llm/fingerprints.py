"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

A text is cut into paragraphs at line ends, and long paragraphs into runs of at most four words.
Each piece is hashed to a wide vector of 120 bits, one bit in each of 120 lanes; the fingerprint is
the sum of the vectors, every lane modulo 2^20, next to the number of pieces. Sums do not depend on
order, so a piece is inserted by adding its vector and deleted by subtracting it, and two texts of
the same pieces agree. The lanes also tell how alike two texts are: the squared differences of
centred lanes estimate how many pieces the two multisets do not share. Three lanes lie in one
64-bit number; four bits above them are free, enough for the pieces of the longest text a column
can hold. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LANES = 120
WORDS = LANES // 3
#: A run of up to four words with the blanks and line ends behind them, or leading blanks.
PIECE = r"(?:\S++[^\S\n]*+){1,4}+\n*+|\s++"
SLOT = 20
_MOD = 1 << SLOT
_ONES = sum(1 << SLOT * k for k in range(3))
_FIELD = (_MOD - 1) * _ONES


def pieces(text: Column) -> Column:
    """The pieces of a text, in order; none for null or empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))


def vectors(texts: DataFrame, keys: list[str]) -> DataFrame:
    """`texts` (keys, text) -> keys, v: the number of pieces, then the packed lanes. Rows of one
    key are one multiset, so paragraphs may come in any order and in any number of rows."""
    each = texts.select(*keys, F.explode_outer(pieces(F.col("text"))).alias("piece"))
    each = each.select(*keys, *(F.when(F.col("piece").isNotNull(), F.xxhash64(F.lit(k), "piece")).alias(f"h{k}") for k in (1, 2)))
    lanes = [F.sum(F.shiftrightunsigned(f"h{k}", j).bitwiseAND(F.lit(_ONES))).alias(f"s{k}_{j}") for k in (1, 2) for j in range(SLOT)]
    sums = each.groupBy(*keys).agg(F.count("h1").alias("n"), *lanes)
    packed = [F.coalesce(F.col(f"s{k}_{j}"), F.lit(0)).bitwiseAND(F.lit(_FIELD)) for k in (1, 2) for j in range(SLOT)]
    return sums.select(*keys, F.array("n", *packed).alias("v"))


def combine(a: Column, b: Column) -> Column:
    """The vector of the pieces of both."""
    return F.concat(F.array(F.element_at(a, 1) + F.element_at(b, 1)),
                    F.zip_with(F.slice(a, 2, WORDS), F.slice(b, 2, WORDS), _plus))


def remove(a: Column, b: Column) -> Column:
    """The vector of `a` without the pieces of `b`."""
    def minus(x: Column, y: Column) -> Column:
        lanes = [F.pmod(_lane(x, k) - _lane(y, k), F.lit(_MOD)) * F.lit(1 << SLOT * k) for k in range(3)]
        return lanes[0] + lanes[1] + lanes[2]

    return F.concat(F.array(F.element_at(a, 1) - F.element_at(b, 1)),
                    F.zip_with(F.slice(a, 2, WORDS), F.slice(b, 2, WORDS), minus))


def _lane(x: Column, k: int) -> Column:
    return F.shiftrightunsigned(x, SLOT * k).bitwiseAND(F.lit(_MOD - 1))


def _plus(x: Column, y: Column) -> Column:
    lanes = [F.pmod(_lane(x, k) + _lane(y, k), F.lit(_MOD)) * F.lit(1 << SLOT * k) for k in range(3)]
    return lanes[0] + lanes[1] + lanes[2]


def text_of(v: Column) -> Column:
    """A vector as hex text: eight digits of the count, then fifteen for each packed number."""
    return F.concat(F.lpad(F.hex(F.element_at(v, 1)), 8, "0"),
                    F.array_join(F.transform(F.slice(v, 2, WORDS), lambda x: F.lpad(F.hex(x), 15, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common pieces, 0 to 1 (Jaccard of multisets); 1 for equal vectors."""
    gap = F.element_at(a, 1) - F.element_at(b, 1)

    def square(x: Column, y: Column, k: int) -> Column:
        d = F.pmod(_lane(x, k) - _lane(y, k) + F.lit(_MOD // 2), F.lit(_MOD)) - F.lit(_MOD // 2)
        d = (2 * d - gap).cast("double")
        return d * d

    squares = F.zip_with(F.slice(a, 2, WORDS), F.slice(b, 2, WORDS), lambda x, y: square(x, y, 0) + square(x, y, 1) + square(x, y, 2))
    differ = F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / F.lit(float(LANES))
    both = (F.element_at(a, 1) + F.element_at(b, 1)).cast("double")
    return (F.when(a == b, F.lit(1.0)).when(both == 0, F.lit(1.0))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (both - differ) / (both + differ)))))


def with_next(docs: DataFrame, chunks: int | None = None) -> DataFrame:
    """`docs` (doc_id, text) with `next_text`, the text of the following doc_id; the last row gets
    the first one's. A null doc_id stands before all others; rows of one doc_id follow each other
    by their text, null texts as empty ones.

    Rows are cut into chunks of near-equal size by quantiles of doc_id. A chunk is ordered by
    itself; its last row finds its successor because the first rows of the next chunk that has
    any are put behind it as a guest.
    """
    spark: SparkSession = docs.sparkSession
    chunks = chunks or max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63)).alias("key"), "doc_id",
                        F.coalesce("text", F.lit("")).alias("text"))
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / chunks for i in range(1, chunks)],
                                        max(10000, 20 * chunks))).first()[0]
    cuts = sorted(set(cuts or []))
    rough = cuts[:: max(1, int(len(cuts) ** 0.5))]
    step = max(1, int(len(cuts) ** 0.5))
    if cuts:  # two short searches instead of one long one
        at = F.size(F.filter(F.lit(rough), lambda c: c <= F.col("key")))
        fine = F.slice(F.lit(cuts), F.greatest((at - 1) * step, F.lit(0)) + 1, step)
        chunk = F.greatest(at - 1, F.lit(0)) * step + F.size(F.filter(fine, lambda c: c <= F.col("key")))
    else:
        chunk = F.lit(0)
    keyed = keyed.withColumn("chunk", chunk.cast("int"))
    heads = sorted((r.chunk, r.key) for r in keyed.groupBy("chunk").agg(F.min("key").alias("key")).collect())
    if not heads:
        return docs.select("doc_id", "text", F.lit("").alias("next_text"), F.lit(0).alias("chunk"))
    # one row for each chunk: at most as many as there are cuts
    guests = spark.createDataFrame([(heads[(i + 1) % len(heads)][1], c) for i, (c, _) in enumerate(heads)], "key long, chunk int")
    first = (keyed.where(F.col("key").isin([k for _, k in heads])).groupBy("key").agg(F.min("text").alias("text"))
             .join(guests, "key").select("key", F.lit(None).cast("long").alias("doc_id"), "text", "chunk", F.lit(True).alias("guest")))
    rows = keyed.withColumn("guest", F.lit(False)).unionByName(first)
    w = W.partitionBy("chunk").orderBy("guest", "key", "text")
    return (rows.withColumn("next_text", F.lead("text").over(w)).where(~F.col("guest"))
            .select("doc_id", "text", "next_text", "chunk"))


def edited(text: Column, other: Column) -> Column:
    """`text` with its last quarter (rounded down) replaced by as much of the start of `other`."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(other, F.lit(1), quarter))


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Other columns of `docs` are ignored. A null text
    counts as empty: no pieces, fingerprint of zeros, likeness 1 to another empty text and 0 to
    any other. A table of one row is its own successor; an empty table gives no rows."""
    d = with_next(docs.select("doc_id", "text"))
    d = d.select("chunk", F.monotonically_increasing_id().alias("row"), "doc_id", F.length("text").cast("long").alias("n_chars"),
                 "text", "next_text", edited(F.col("text"), F.col("next_text")).alias("edited"))
    d = d.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    # rows of a chunk are together already, so neither aggregate shuffles
    keys = ["chunk", "row", "doc_id", "n_chars", "edited_sha256"]
    three = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("text")) for k, c in enumerate(("text", "edited", "next_text"))))
    v = vectors(d.select(*keys, F.inline(three)), [*keys, "kind"])
    v = v.groupBy(*keys).agg(*(F.first(F.when(F.col("kind") == k, F.col("v")), ignorenulls=True).alias(c) for k, c in enumerate("ven")))
    return v.select("doc_id", "n_chars", "edited_sha256", text_of(F.col("v")).alias("fingerprint"),
                    text_of(F.col("e")).alias("edited_fingerprint"),
                    likeness(F.col("v"), F.col("e")).alias("near_edited"), likeness(F.col("v"), F.col("n")).alias("near_next"))
