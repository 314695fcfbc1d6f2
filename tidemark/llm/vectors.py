"""Embedding near-dedup: robust-pruned graphs on overlapping cluster shards, range search, verification.

Vectors of one label and length are dealt to the shards of their two nearest centroids; a shard
with many rows is cut into blocks. In every block a flat graph is built by robust pruning, the
adjacency lists that a vector gets from its blocks are united, and every vector searches the blocks
of its shards: a greedy walk from the block's medoid, then an expansion over all neighbours within
a range. Pairs found are verified by their cosine in double precision.

Equal vectors of one label are one node with a count, so copies make no pairs. Centroids are fitted
on a bounded sample; every row is indexed and searched. `recall` compares with brute force.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.store import stored

COSINE = 0.98
#: Vectors on which the centroids are fitted, and most centroids of a label.
SAMPLE, CENTROIDS = 20_000, 256
#: Rows a shard aims at, and rows of a block at most.
SHARD, BLOCK = 1000, 2000
#: Neighbours kept, candidates pruned, slack of the pruning, and width of the greedy walk.
DEGREE, CANDIDATES, ALPHA, BEAM = 24, 64, 1.2, 32
#: The expansion passes through vectors down to this cosine.
THROUGH = 0.95


def nodes(vectors: DataFrame) -> DataFrame:
    """Distinct usable vectors: label, size, rep (least vec_id), copies, unit vector (doubles)."""
    good = _unit(vectors.where(_fit())).select(F.col("u_label").alias("label"), "vec_id", F.col("u_v").alias("v"))
    return (good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
            .select("label", F.size("v").alias("size"), "rep", "copies", "v"))


def centroids(points: DataFrame, sample: int = SAMPLE) -> dict[tuple[str, int], np.ndarray]:
    """Centroids by label and length, by spherical k-means over a bounded sample."""
    counts = {(r.label, r["size"]): r["count"] for r in points.groupBy("label", "size").count().collect()}
    total = sum(counts.values()) or 1
    share = min(1.0, sample / total)
    rows = points.where(F.shiftrightunsigned(F.xxhash64("rep"), 11) < int(share * (1 << 53))).select("label", "size", "v").limit(2 * sample).collect()
    by: dict = {}
    for r in rows:
        by.setdefault((r.label, r["size"]), []).append(r.v)
    rng, out = np.random.default_rng(11), {}
    for key, n in counts.items():
        x = np.array(by.get(key, []))
        k = min(CENTROIDS, max(1, -(-n // SHARD)), max(1, len(x)))
        if not len(x):
            out[key] = np.zeros((1, key[1]))
            continue
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(8):
            near = (x @ c.T).argmax(1)
            for j in range(k):
                if (m := x[near == j]).size:
                    s = m.sum(0)
                    c[j] = s / max(np.linalg.norm(s), 1e-12)
        out[key] = c
    return out


def assign(points: DataFrame, center: dict) -> DataFrame:
    """A row for each of a vector's two nearest shards: label, shard, rep, v."""
    shared = points.sparkSession.sparkContext.broadcast(center)

    def run(frames):
        for pdf in frames:
            for (label, size), g in pdf.groupby(["label", "size"]):
                c = shared.value[(label, size)]
                near = np.argsort(-(np.stack(g.v.to_numpy()) @ c.T), axis=1)[:, :2]
                for k in range(near.shape[1]):
                    yield pd.DataFrame({"shard": [f"{label}/{size}/{j}" for j in near[:, k]], "rep": g.rep.to_numpy(), "v": g.v.to_numpy()})

    return points.select("label", "size", "rep", "v").mapInPandas(run, "shard string, rep long, v array<double>")


def robust_prune(x: np.ndarray, i: int, near: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[int]:
    """Neighbours of i out of `near` (nearest first): one is dropped if a kept one is nearer to it,
    by the factor alpha, than i is."""
    near = near[near != i]
    d = 1 - x[near] @ x[i]
    open_, out = np.ones(len(near), bool), []
    while open_.any() and len(out) < degree:
        p = int(open_.argmax())
        out.append(int(near[p]))
        open_ &= alpha * (1 - x[near] @ x[near[p]]) > d
        open_[p] = False
    return out


def build(x: np.ndarray) -> tuple[list[list[int]], int]:
    """Robust-pruned graph of the rows of x, and its medoid, from which every row can be reached."""
    n = len(x)
    sims = x @ x.T
    k = min(n, CANDIDATES + 1)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
    out = [robust_prune(x, i, near[i]) for i in range(n)]
    back: list[set[int]] = [set(o) for o in out]
    for i, o in enumerate(out):
        for j in o:
            back[j].add(i)
    for i in range(n):
        if len(back[i]) > 2 * DEGREE:
            c = np.array(sorted(back[i]))
            out[i] = robust_prune(x, i, c[np.argsort(-sims[i, c], kind="stable")], 2 * DEGREE)
        else:
            out[i] = sorted(back[i])
    medoid = int((x @ x.sum(0)).argmax())
    seen = np.zeros(n, bool)

    def walk(front: list[int]) -> None:
        while front:
            seen[front] = True
            front = [j for j in {j for i in front for j in out[i]} if not seen[j]]

    walk([medoid])
    while not seen.all():
        lost = np.flatnonzero(~seen)
        j = int(lost[0])
        i = int(np.where(seen, sims[j], -2).argmax())
        out[i].append(j)
        walk([j])
    return out, medoid


def search(x: np.ndarray, graph: list[np.ndarray], medoid: int, q: np.ndarray, cosine: float = COSINE) -> np.ndarray:
    """Rows within the range of q: a greedy walk, then all neighbours reached through near rows."""
    seen = np.zeros(len(x), bool)
    ids, sims, done = np.array([medoid]), np.array([x[medoid] @ q]), np.array([False])
    seen[medoid] = True
    while not done.all():
        i = int(np.where(done, -2, sims).argmax())
        done[i] = True
        new = graph[ids[i]]
        new = new[~seen[new]]
        if not len(new):
            continue
        seen[new] = True
        ids, sims, done = np.concatenate([ids, new]), np.concatenate([sims, x[new] @ q]), np.concatenate([done, np.zeros(len(new), bool)])
        if len(ids) > BEAM:
            top = np.argpartition(-sims, BEAM - 1)[:BEAM] if sims.max() < THROUGH else np.flatnonzero((sims >= THROUGH) | (sims >= np.partition(sims, -BEAM)[-BEAM]))
            ids, sims, done = ids[top], sims[top], done[top]
    front = ids[sims >= THROUGH]
    found = [front]
    while len(front):
        new = np.unique(np.concatenate([graph[i] for i in front]))
        new = new[~seen[new]]
        seen[new] = True
        front = new[x[new] @ q >= THROUGH]
        found.append(front)
    hit = np.concatenate(found)
    return hit[x[hit] @ q >= cosine]


def graphs(assigned: DataFrame) -> DataFrame:
    """Adjacency lists, united over the blocks of a vector: rep, next."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, _ = build(np.stack(pdf.v.to_numpy()))
        ids = pdf.rep.to_numpy()
        return pd.DataFrame({"rep": ids, "next": [ids[o].tolist() for o in out]})

    each = assigned.groupBy("shard", "block").applyInPandas(run, "rep long, next array<long>")
    return each.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))


def pairs(points: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Links (u, v), both ways, between distinct vectors."""
    assigned = assign(points, centroids(points))
    blocks = assigned.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    assigned = stored(assigned.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))
    linked = graphs(assigned)
    full = stored(assigned.join(linked, "rep"))
    # a vector is a node of its own block and asks every block of its shard
    ask = full.select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"), "rep", "v", "block",
                      F.when(F.col("to") == F.col("block"), F.col("next")).alias("next"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.block == pdf.to]
        if not len(own):
            return pd.DataFrame({"u": [], "v": []})
        x, ids = np.stack(own.v.to_numpy()), own.rep.to_numpy()
        at = {r: i for i, r in enumerate(ids.tolist())}
        graph = [np.array([at[j] for j in o if j in at], np.int64) for o in own.next]
        medoid = int((x @ x.sum(0)).argmax())
        us, vs = [], []
        for r, q in zip(pdf.rep.to_numpy(), np.stack(pdf.v.to_numpy())):
            hit = ids[search(x, graph, medoid, q, cosine)]
            hit = hit[hit != r]
            us.append(np.full(len(hit), r))
            vs.append(hit)
        return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    found = ask.groupBy("shard", "to").applyInPandas(run, "u long, v long")
    return found.union(found.select("v", "u")).distinct()


def dedup(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """`vectors` (vec_id, embedding, label) -> vec_id, n_links, component_id, kept; one row each.

    Vectors link within one label, from `cosine` on. A null label, a null, empty or zero vector,
    and one with null or non-finite components link with nothing and are their own component, as
    are vectors of another length than all others of the label. A null vec_id has no links, no
    component and is kept. Copies count as links of each other. Rows that repeat a vec_id count
    each other too. Other columns are ignored; an empty table stays empty.
    """
    points = stored(nodes(vectors))
    link = stored(pairs(points, cosine))
    cluster = components(link)
    size = points.select(F.col("rep").alias("v"), "copies")
    seen = link.join(size, "v").groupBy(F.col("u").alias("rep")).agg(F.sum("copies").alias("others"))
    of_node = (points.join(seen, "rep", "left").join(cluster, F.col("rep") == F.col("node"), "left")
               .select(F.col("label").alias("n_label"), F.col("v").alias("n_v"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                       F.coalesce("component", "rep").alias("component_id")))
    unit = _unit(vectors)
    return (unit.join(of_node, (F.col("u_label") == F.col("n_label")) & (F.col("u_v") == F.col("n_v")), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", F.col("vec_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


def _fit() -> Column:
    """Whether a row can link: plain conditions on its columns, so that a filter on it is cheap."""
    return F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.exists("embedding", lambda x: x != 0)
                      & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))), F.lit(False))


def _unit(vectors: DataFrame) -> DataFrame:
    """Every row with its label and unit vector, null where it cannot link. The largest component
    is divided out first, so that squares neither overflow nor vanish. Largest component and norm
    are bound by lambdas of one element: they are worked out once for a vector, not for each of
    its components, wherever the optimiser puts the expression."""
    once = lambda value, use: F.transform(F.array(value), use)[0]
    top = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    scaled = once(top, lambda t: F.transform("embedding", lambda x: x.cast("double") / t))
    unit = once(scaled, lambda e: once(F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x)), lambda norm: F.transform(e, lambda x: x / norm)))
    return vectors.select("vec_id", F.when(_fit(), F.col("label").cast("string")).alias("u_label"), F.when(_fit(), unit).alias("u_v"))


def recall(vectors: DataFrame, cosine: float = COSINE, every: int = 20) -> float:
    """Share of the true links of the rows whose vec_id is divisible by `every` that are found.
    The true ones come from comparing these rows with all others, in blocks."""
    points = stored(nodes(vectors))
    found = pairs(points, cosine).where(F.pmod("u", F.lit(every)) == 0).count()
    queries = points.where(F.pmod("rep", F.lit(every)) == 0)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"n": [0]})
        s = np.stack(left.v.to_numpy()) @ np.stack(right.v.to_numpy()).T
        same = left.rep.to_numpy()[:, None] == right.rep.to_numpy()[None, :]
        return pd.DataFrame({"n": [int(((s >= cosine) & ~same).sum())]})

    parts = max(1, -(-points.count() // 5000))
    blocks = points.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(parts)))
    asked = queries.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    true = (asked.groupBy("label", "size", "part").cogroup(blocks.groupBy("label", "size", "part")).applyInPandas(run, "n long")
            .agg(F.sum("n")).first()[0] or 0)
    return found / true if true else 1.0
