"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic); the cell weights are raked, one margin after
the other, until the three margins have their target shares; a document is kept with a probability
proportional to the weight of its cell, decided by a hash of its doc_id.

Categories that the targets do not name share one category, `OTHER`, so the number of cells is
bounded by the targets, whatever the input.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import stored

OTHER = "(other)"
DIMENSIONS = ("source", "lang", "topic")
#: Most categories of a margin, so that cells fit the driver.
CATEGORIES = 1000


def tokens(text: Column) -> Column:
    """Words of a text by blanks; 0 for null and blank texts."""
    blanks = "\t\n\x0b\x0c\r"
    words = F.split(F.translate(F.coalesce(text, F.lit("")), blanks, " " * len(blanks)), " ")
    return F.size(F.filter(words, lambda w: w != "")).cast("long")


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def topic(text: Column) -> Column:
    """A topic by the text's form: `list` (short lines), `data` (many digits), `shout` (many
    capitals or signs) or `prose`."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    lines = _count(t, "\n") + 1
    digits, loud = _count(t, "0123456789"), _count(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ!$#%&*")
    return (F.when(digits / n > 0.05, "data").when(loud / n > 0.1, "shout").when(n / lines < 100, "list").otherwise("prose"))


def measures(docs: DataFrame, seed: int = 1, topic_of: Column | None = None) -> DataFrame:
    """One pass over the texts, stored without them: doc_id, source, lang, topic, tokens and the draw
    of every row. Targets, cells and decisions are made from this table."""
    text = F.col("text")
    return stored(docs.select("doc_id", "source", "lang", (topic(text) if topic_of is None else topic_of).alias("topic"), tokens(text).alias("tokens"),
                              draw(F.col("doc_id"), text, seed).alias("draw")))


def with_cells(docs: DataFrame, targets: dict[str, dict[str, float]], topic_of: Column | None = None, tokens_of: Column | None = None) -> DataFrame:
    """`docs` with `_source`, `_lang`, `_topic` (categories) and `_tokens`."""
    value = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col("text")) if topic_of is None else topic_of}
    out = docs
    for d in DIMENSIONS:
        named = [c for c in targets[d] if c != OTHER]
        out = out.withColumn(f"_{d}", F.when(value[d].isin(named), value[d]).otherwise(F.lit(OTHER)))
    return out.withColumn("_tokens", tokens(F.col("text")) if tokens_of is None else tokens_of)


def _of_measures(found: DataFrame, targets: dict[str, dict[str, float]]) -> DataFrame:
    return with_cells(found, targets, F.col("topic"), F.col("tokens"))


def rake(cells: dict[tuple, float], targets: dict[str, dict[str, float]], rounds: int = 200, tolerance: float = 1e-9) -> dict[tuple, float]:
    """Factor of each cell with tokens, such that token sums times factors have the target shares.

    A target whose category has no tokens cannot be met; the others of its margin are scaled to
    fill its place. Where margins contradict each other, the last round's factors are returned.
    """
    keys = sorted(k for k, v in cells.items() if v > 0)
    if not keys:
        return {}
    x = np.array([cells[k] for k in keys], float)
    w = x / x.sum()
    margins = []
    for d, name in enumerate(DIMENSIONS):
        cats = sorted({k[d] for k in keys})
        goal = np.array([max(0.0, targets[name].get(c, 0.0)) for c in cats])
        if goal.sum() <= 0:
            goal = np.ones(len(cats))
        margins.append((np.array([cats.index(k[d]) for k in keys]), goal / goal.sum()))
    for _ in range(rounds):
        worst = 0.0
        for at, goal in margins:
            now = np.bincount(at, weights=w, minlength=len(goal))
            ratio = np.divide(goal, now, out=np.zeros(len(goal)), where=now > 0)
            worst = max(worst, float(np.abs(now - goal).max()))
            w = w * ratio[at]
        if worst < tolerance:
            break
    total = w.sum()
    return {k: float(v / total / (n / x.sum())) if total > 0 else 0.0 for k, v, n in zip(keys, w, x)}


def probabilities(cells: dict[tuple, float], factors: dict[tuple, float], budget: float | None = None) -> dict[tuple, float]:
    """Probability of keeping a document of each cell: proportional to its factor, so that the
    expected tokens keep the targets. With a `budget` (share of all tokens) it is scaled to it and
    cells whose probability would pass 1 are kept whole; without, the largest factor gets 1."""
    if not factors:
        return {}
    top = max(factors.values())
    if budget is None:
        return {k: f / top if top > 0 else 0.0 for k, f in factors.items()}
    total = sum(cells[k] for k in factors)
    low, high = 0.0, 1 / max(min((f for f in factors.values() if f > 0), default=1.0), 1e-12)
    for _ in range(200):
        mid = (low + high) / 2
        if sum(cells[k] * min(1.0, mid * f) for k, f in factors.items()) < budget * total:
            low = mid
        else:
            high = mid
    return {k: min(1.0, high * f) for k, f in factors.items()}


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the row alone; rows without doc_id draw by their text."""
    h = F.when(doc_id.isNotNull(), F.xxhash64(F.lit(seed), doc_id)).otherwise(F.xxhash64(F.lit(seed), F.coalesce(text, F.lit(""))))
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def chances(found: DataFrame, targets: dict[str, dict[str, float]], budget: float | None = None) -> DataFrame:
    """Of stored measures: `_source`, `_lang`, `_topic`, `_weight`, `_probability` of every cell that
    has rows, as many as the product of the target categories at most."""
    if any(len(targets[d]) > CATEGORIES for d in DIMENSIONS):
        raise ValueError(f"a margin has more than {CATEGORIES} categories")
    names = [f"_{x}" for x in DIMENSIONS]
    cells = {tuple(r)[:3]: float(r.n) for r in _of_measures(found, targets).groupBy(*names).agg(F.sum("_tokens").alias("n")).collect()}
    factors = rake(cells, targets)
    chance = probabilities(cells, factors, budget)
    rows = [(*k, factors.get(k, 1.0), chance.get(k, 1.0)) for k in cells]
    return found.sparkSession.createDataFrame(rows, "_source string, _lang string, _topic string, _weight double, _probability double")


def decide(found: DataFrame, targets: dict[str, dict[str, float]], budget: float | None = None) -> DataFrame:
    """Stored measures with their cell, weight, probability and decision: what `mix` adds, without texts."""
    names = [f"_{x}" for x in DIMENSIONS]
    d = _of_measures(found, targets)
    return (d.join(F.broadcast(chances(found, targets, budget)), names).select(*d.columns, "_weight", "_probability")
            .withColumn("_kept", F.col("draw") < F.col("_probability")))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]], budget: float | None = None, seed: int = 1,
        topic_of: Column | None = None, found: DataFrame | None = None) -> DataFrame:
    """`docs` (with doc_id, text, source, lang) and `_source`, `_lang`, `_topic`, `_tokens`,
    `_weight` (factor of the cell), `_probability` and `_kept`; one row for each input row. `found` are
    the measures of `docs`, if they are stored already.

    Null or unnamed sources, languages and topics belong to `OTHER`. Documents without tokens do
    not change the mix: their probability is that of their cell, or 1 where the cell has no tokens
    at all. An empty table stays empty.
    """
    found = measures(docs, seed, topic_of) if found is None else found
    table = chances(found, targets, budget)
    d = with_cells(docs, targets, topic_of)
    return (d.join(F.broadcast(table), [f"_{x}" for x in DIMENSIONS]).select(*d.columns, "_weight", "_probability")
            .withColumn("_kept", draw(F.col("doc_id"), F.col("text"), seed) < F.col("_probability")))


def even_targets(found: DataFrame, top: int = CATEGORIES - 1, power: float = 0.75) -> dict[str, dict[str, float]]:
    """Targets that flatten the mix, from stored measures: each margin's share goes as its tokens' share
    to the `power`, for the `top` categories of the most tokens and `OTHER`, which has the tokens of all
    others and of nulls."""
    out = {}
    cells = stored(found.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("n")))
    total = cells.agg(F.sum("n")).first()[0] or 0
    for name in DIMENSIONS:
        rows = cells.where(F.col(name).isNotNull()).groupBy(name).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), name).limit(top).collect()
        out[name] = {r[name]: (r.n / total) ** power for r in rows if r.n}
        rest = total - sum(r.n for r in rows)
        if rest or not out[name]:
            out[name][OTHER] = (rest / total) ** power if rest else 1.0
        size = sum(out[name].values())
        out[name] = {k: v / size for k, v in out[name].items()}
    return out
