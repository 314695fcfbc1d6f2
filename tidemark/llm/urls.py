"""URL filters: host-suffix and path-prefix expressions against a rule table.

A rule is a host and the beginning of a path. Each URL is expanded into expressions (a suffix of
its host at a label boundary, joined to a beginning of its path at a slash), each rule into the
expression it needs (its host and its path up to the last slash). Both sides meet in an equality
join on the first bytes of a digest; the full digest, and the rest of the rule's path, are then
confirmed. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest that the join uses: 32 bits.
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    """Host after the first `://`, A-Z lower-cased; empty for null or without `://`."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """Path up to `?` or `#`; empty for null or without `://`."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """`rules` (rule, verdict) with host, path, the expression's digest and its precedence.
    Null rules fit nothing. Of equal rules that disagree, `block` is kept."""
    r = rules.where(F.col("rule").isNotNull()).groupBy("rule").agg(F.max("verdict").alias("verdict"))
    cut = F.locate("/", F.col("rule"))
    host = F.translate(F.when(cut > 0, F.substring("rule", F.lit(1), cut - 1)).otherwise(F.col("rule")), _UPPER, _LOWER)
    path = F.when(cut > 0, F.substring("rule", cut, F.length("rule"))).otherwise(F.lit(""))
    slashes = F.size(F.split("r_path", "/", -1)) - 1
    return (r.select("rule", "verdict", host.alias("r_host"), path.alias("r_path"))
            .withColumn("r_depth", slashes)
            .withColumn("r_labels", F.size(F.split("r_host", r"\.", -1)))
            .withColumn("r_digest", _digest(F.concat("r_host", _until_slash(F.col("r_path"), F.col("r_depth"))))))


def _until_slash(path: Column, depth: Column) -> Column:
    """`path` up to and including its slash number `depth`; empty for depth 0."""
    return F.when(depth == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", path, F.lit("/"), depth), F.lit("/")))


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", salts: int = 8) -> DataFrame:
    """`urls` (id, url) -> id, host, path, rule, verdict, one row for each input row.

    The longest fitting rule wins; of equally long ones the one with the longer host, then the
    greater text. A URL that no rule fits (also null, or without `://`) gets a null rule and the
    `default` verdict. Repeated rows each get their own result; empty inputs give empty results
    (or defaults, where only the rules are empty). `salts` spreads a hot expression: each rule
    stands `salts` times, each URL asks for one of them.
    """
    r = rule_table(rules)
    # no rule reaches deeper than these two numbers, so longer expressions cannot match
    depth, labels = r.agg(F.coalesce(F.max("r_depth"), F.lit(0)), F.coalesce(F.max("r_labels"), F.lit(0))).first()
    r = (r.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
         .withColumn("prefix", F.substring("r_digest", 1, PREFIX_DIGITS)))

    u = (urls.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
         .withColumn("row", F.monotonically_increasing_id()))
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.greatest(F.lit(labels), F.lit(1)))),
                           lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    depths = F.sequence(F.lit(0), F.least(F.size(F.split("path", "/", -1)) - 1, F.lit(depth)))
    tops = F.transform(depths, lambda d: _until_slash(F.col("path"), d))
    digests = F.flatten(F.transform(suffixes, lambda s: F.transform(tops, lambda t: _digest(F.concat(s, t)))))
    asked = (u.select("*", F.explode(digests).alias("digest"))
             .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
             .withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")))
    hit = asked.join(r, ["prefix", "salt"], "left")
    fits = (F.col("digest") == F.col("r_digest")) & F.startswith(F.col("path"), F.col("r_path"))
    best = F.when(fits, F.struct(F.length("rule").alias("size"), F.length("r_host").alias("host_size"), "rule", "verdict"))
    return (hit.groupBy("row").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("path").alias("path"),
                                   F.max(best).alias("best"))
            .select("id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
