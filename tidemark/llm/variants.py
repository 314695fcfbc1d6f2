"""Grouping spelling variants: one-edit neighbours from Gram matrices of letter counts.

An inserted or deleted letter changes one letter count by one, a replaced letter two counts by one
each, so words one edit apart have letter-count vectors at a squared distance of 1 in adjacent
lengths or of 2 in the same length. Words are dealt to blocks by length and by the counts of a few
groups of letters, which differ between such words by one at most. In every block one matrix product
gives the squared distances of its words to each other and to the words that visit it from adjacent
blocks; pairs at a distance of at most two are then verified letter by letter.

The number of letter groups only sets how fine the blocks are: it is raised until the fullest block
fits a product. A block that stays too full is cut into tiles, and its visitors into slices, so a
task holds a bounded number of words and every pair still meets exactly once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import stored

SHORTEST, LEAST, EVERY, FACTOR = 7, 2, 31, 10
#: Words of a tile, and visitors that meet it in one task, at most (about).
TILE, VISITORS = 4096, 60_000
#: Fewest and most letter groups that blocks are made of.
GROUPS = (3, 12)
#: Distinct words counted before their counts are handed on.
FLUSH = 200_000
#: Rows of a tile multiplied at a time.
ROWS = 512

# Letters of runs are all in Latin-1: A-Z, a-z and everything from U+00C0 to U+00FF. Capitals A-Z
# become small ones, all other characters blanks.
_RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def occurrences(text: str, doc_id: int | None) -> Iterator[tuple[bytes, int]]:
    """(word in Latin-1, count) of a text: lower-cased runs, those picked by their hash together
    with the document without one letter."""
    begun = zlib.crc32(b":" if doc_id is None else f"{doc_id}:".encode())
    for run, n in Counter(text.encode("latin-1", "replace").translate(_RUNS).split()).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begun)
        if h % EVERY == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1:]
        yield run, n


def words(documents: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """`documents` (doc_id, text) -> word, n: distinct words of at least `shortest` letters that
    occur at least `least` times in all texts. Counts are summed within a task before they are
    shuffled. A null text has no words; a null doc_id is written as nothing before the colon;
    repeated rows count each."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()),
                                              pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if text.is_valid:
                    for w, n in occurrences(text.as_py(), doc_id):
                        if len(w) >= shortest:
                            counts[w] += n
                if len(counts) >= FLUSH:
                    yield flush()
        if counts:
            yield flush()

    each = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letter_groups(vocabulary: DataFrame, k: int) -> list[str]:
    """Letters dealt to k groups of about equal weight. Collected is one row per letter of the
    alphabet, which Unicode bounds."""
    seen = (vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
            .collect())
    seen.sort(key=lambda r: (-r.n, r.c))
    groups, weight = [""] * k, [0] * k
    for r in seen:
        g = weight.index(min(weight))
        groups[g] += r.c
        weight[g] += r.n
    return groups


def _weight(count: str):
    """Words of a block, long ones counting for every 32 letters begun."""
    return F.col(count) * F.ceil(F.col("cell")[0] / 32)


def blocks(vocabulary: DataFrame, tile: int = TILE) -> tuple[DataFrame, int]:
    """The words with their block (length, then the letters of each group), as fine as needed."""
    for k in range(GROUPS[0], GROUPS[1] + 1):
        at = F.array(F.length("word"), *[F.length("word") - F.length(F.translate("word", g, "")) if g else F.lit(0)
                                         for g in letter_groups(vocabulary, k)])
        cells = vocabulary.withColumn("cell", at)
        fullest = cells.groupBy("cell").agg(F.count("*").alias("m")).agg(F.max(_weight("m"))).first()[0] or 0
        if fullest <= tile:
            break
    return cells, k


def _visits(k: int):
    """Blocks that a word visits: those one letter longer, and of each two blocks of one length
    that differ by a moved letter the one where it lies in the later group."""
    moved = lambda plus, minus: F.array(*[F.col("cell")[i] + (1 if i in plus else 0) - (1 if i in minus else 0) for i in range(k + 1)])
    longer = [moved((0, g), ()) for g in range(1, k + 1)]
    same = [F.when(F.col("cell")[g] > 0, moved((h,), (g,))) for g in range(1, k + 1) for h in range(g + 1, k + 1)]
    return F.array_compact(F.array(*longer, *same))


def _matrix(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points (0 behind the end), lengths, and the owner of every code point."""
    size = np.array([len(w) for w in found], np.int64)
    flat = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(found)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((len(found), int(size.max(initial=0))), np.uint32)
    out[owner, place] = flat
    return out, size, owner


def _one_edit(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Of code-point rows of one length, or with b one shorter: whether one edit parts them."""
    width = a.shape[1]
    eq = a == b
    out = (la == lb) & (width - eq.sum(1) == 1)
    short = la == lb + 1
    if short.any():
        head = eq[short].argmin(1)
        shifted = np.zeros_like(b[short])
        shifted[:, 1:] = b[short][:, :-1]
        tail_eq = (a[short] == shifted) | (np.arange(width)[None, :] >= la[short][:, None])
        tail_eq[:, 0] = False
        tail = la[short] - 1 - (width - 1 - tail_eq[:, ::-1].argmin(1))
        out[short] = head + tail >= lb[short]
    return out


def near_pairs(home: list[str], visiting: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs one edit apart, as places in home + visiting: each pair within `home` once, and each
    of a home word (the longer one, if lengths differ) with a visiting one."""
    every = home + visiting
    code, size, owner = _matrix(every)
    letters, at = np.unique(code[code > 0], return_inverse=True)
    counts = np.bincount(owner * len(letters) + at, minlength=len(every) * len(letters)).reshape(len(every), len(letters))
    wide = np.float32 if size.max(initial=0) < 2000 else np.float64
    counts = counts.astype(wide)
    square = (counts * counts).sum(1)
    # row i of the product with column j: 2 - squared distance
    left = np.concatenate([2 * counts, 2 - square[:, None], np.full((len(every), 1), -1, wide)], 1)
    right = np.concatenate([counts, np.ones((len(every), 1), wide), square[:, None]], 1).T.copy()
    us, vs = [], []
    for a in range(0, len(home), ROWS):
        for b in range(a, len(every), 8 * ROWS):
            to = min(b + 8 * ROWS, len(every))
            gap = left[a: min(a + ROWS, len(home))] @ right[:, b:to]
            i, j = np.nonzero(gap > -0.5)
            apart, i, j = gap[i, j], i + a, j + b
            ok = (j > i) & np.where(size[i] == size[j], apart < 0.5, (np.abs(size[i] - size[j]) == 1) & (apart > 0.5))
            i, j = i[ok], j[ok]
            for p in range(0, len(i), 1 << 18):
                x, y = i[p: p + (1 << 18)], j[p: p + (1 << 18)]
                keep = _one_edit(code[x], code[y], size[x], size[y])
                us.append(x[keep])
                vs.append(y[keep])
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2


_MET = pa.schema([("word", pa.string()), ("met", pa.int64()), ("lost", pa.int64()), ("near", pa.string())])


def _meet(rows: pa.Table) -> pa.Table:
    """Of one tile and its visitors: per word how many near words it met and the most frequent one."""
    rows = rows.sort_by("visits")
    found, n = rows["word"].to_pylist(), rows["n"].to_numpy()
    m = int((~rows["visits"].to_numpy()).sum())
    if not m or len(found) < 2:
        return _MET.empty_table()
    u, v = near_pairs(found[:m], found[m:])
    if rows["slice"][0].as_py():  # pairs within the tile belong to its first slice
        keep = v >= m
        u, v = u[keep], v[keep]
    if not len(u):
        return _MET.empty_table()
    rank = np.empty(len(found), np.int64)
    rank[np.array(sorted(range(len(found)), key=found.__getitem__))] = np.arange(len(found))
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    order = np.lexsort((rank[v], -n[v], u))
    u, v = u[order], v[order]
    first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
    return pa.table([pa.array([found[i] for i in u[first]], pa.string()), pa.array(np.diff(np.r_[first, len(u)]), pa.int64()),
                     pa.array(-n[v[first]], pa.int64()), pa.array([found[i] for i in v[first]], pa.string())], schema=_MET)


def neighbours(vocabulary: DataFrame, tile: int = TILE, visitors: int = VISITORS) -> DataFrame:
    """Stored `vocabulary` (word, n; distinct words) -> word, n_near, near, near_n: the number of
    words one edit away and the most frequent of them (ties: the smallest), for words that have any."""
    placed, k = blocks(vocabulary, tile)
    placed = stored(placed)
    goes = placed.select("word", "n", F.explode(_visits(k)).alias("cell"))
    size = placed.groupBy("cell").agg(F.count("*").alias("m"))
    guests = goes.groupBy("cell").agg(F.count("*").alias("g"))
    plan = stored(size.join(guests, "cell", "left").select(
        "cell", F.ceil(_weight("m") / tile).cast("int").alias("tiles"),
        F.ceil((_weight("m") + F.coalesce(_weight("g"), F.lit(0))) / visitors).cast("int").alias("slices")))
    tile_of = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    slice_of = F.pmod(F.xxhash64("word", F.lit(1)), F.col("slices")).cast("int")
    each = lambda upper: F.explode(F.sequence(F.lit(0), F.col(upper) - 1))
    row = lambda visits: ("cell", F.col("tile"), F.col("slice"), F.lit(visits).alias("visits"), "word", "n")
    at = placed.join(plan, "cell")
    home = at.withColumn("tile", tile_of).withColumn("slice", each("slices")).select(*row(False))
    # between the tiles of one block the words of each visit the later tiles
    inner = (at.where("tiles > 1").withColumn("own", tile_of).withColumn("slice", slice_of)
             .withColumn("tile", F.explode(F.when(F.col("own") + 1 < F.col("tiles"), F.sequence(F.col("own") + 1, F.col("tiles") - 1)))).select(*row(True)))
    outer = goes.join(plan, "cell").withColumn("slice", slice_of).withColumn("tile", each("tiles")).select(*row(True))
    met = home.unionByName(inner).unionByName(outer).groupBy("cell", "tile", "slice").applyInArrow(_meet, "word string, met long, lost long, near string")
    best = met.groupBy("word").agg(F.sum("met").alias("n_near"), F.min(F.struct("lost", "near")).alias("b"))
    return best.select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.lost")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """`forms` (word, form) -> word, root: the end of the chain of forms. Every round doubles the
    steps taken; a form is ten times as frequent, so chains are short."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = stored(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went")))
        if not now.where("went").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def group(vocabulary: DataFrame, factor: int = FACTOR, tile: int = TILE, visitors: int = VISITORS) -> DataFrame:
    """`vocabulary` (word, n) -> word, form, root, n, n_near, form_n; one row per distinct word.

    Words are near if exactly one letter is inserted, deleted or replaced. The form of a word is its
    near word of largest n (ties: smallest in code-point order) if that n is at least `factor` times
    the word's own, else null; its root is the last of the chain of forms, itself without a form.
    Rows that repeat a word are summed; a null word, an empty one and a null n are left out; other
    columns are ignored; an empty table stays empty.
    """
    vocabulary = stored(vocabulary.where("word is not null and word <> '' and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    near = neighbours(vocabulary, tile, visitors)
    form = F.col("near_n") >= factor * F.col("n")
    out = stored(vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                                              F.when(form, F.col("near")).alias("form"), F.when(form, F.col("near_n")).alias("form_n")))
    ends = roots(out.where("form is not null").select("word", "form"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
