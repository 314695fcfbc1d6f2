"""Approximate nearest neighbours by cosine, on robust-pruned directed graphs.

Distinct vectors are dealt by hash to shards of about equal size. A shard's graph starts with random
edges; batch by batch, a greedy search for each vector over the graph so far proposes neighbours, and
pruning keeps, nearest first, those that no kept one is closer to by a factor: few edges that point
everywhere. The far ends get the edge back and are pruned in turn. The index is a stored table of
vectors and adjacency lists. Every query asks every shard by a beam search; scores are then exact
cosines of the original vectors in double precision.

Copies of a vector are one node that keeps as many of the smallest ids as an answer can hold, and
equal queries are asked once, so a vector that a third of all rows share costs no more than others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import stored

#: Vectors of a shard, and queries that meet one in one task, about.
SHARD, ASKED = 8_000, 20_000
#: Edges of a node, width of the beam that proposes neighbours, slack of the pruning (a factor on
#: distances), passes.
DEGREE, BEAM, ALPHA, PASSES = 32, 64, 1.2, 2
#: Width of a query's beam.
WIDTH = 128
#: Vectors searched for at a time.
BATCH = 512
#: Parts that the queries of one vector are spread over.
SALTS = 16


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row of q: places and squared distances of the nearest rows of x that a search finds,
    nearest first (-1 and infinity behind the last), then places and squared distances of all rows
    that it has expanded on its way. All queries take their steps together; a query ends when its
    whole beam is expanded."""
    m = len(q)
    ids, far = np.full((m, beam), -1, np.int64), np.full((m, beam), np.inf, np.float32)
    open_, seen = np.zeros((m, beam), bool), np.zeros((m, len(x)), bool)
    ids[:, 0], far[:, 0], open_[:, 0], seen[:, start] = start, 2 - 2 * q @ x[start], True, True
    live, way, cost = np.arange(m), [], []
    while len(live):
        best = np.where(open_[live], far[live], np.inf).argmin(1)
        open_[live, best] = False
        way.append(np.full(m, -1, np.int64))
        cost.append(np.full(m, np.inf, np.float32))
        way[-1][live], cost[-1][live] = ids[live, best], far[live, best]
        new = graph[ids[live, best]]
        fresh = (new >= 0) & ~seen[live[:, None], new]
        some = fresh.any(1)
        at, new, fresh = live[some], new[some], fresh[some]
        r, c = np.nonzero(fresh)
        seen[at[r], new[r, c]] = True
        d = 2 - 2 * np.matmul(x[new], q[at][:, :, None])[:, :, 0]
        d[~fresh] = np.inf
        i, f = np.concatenate([ids[at], np.where(fresh, new, -1)], 1), np.concatenate([far[at], d], 1)
        o = np.concatenate([open_[at], fresh], 1)
        top = np.argsort(f, 1, kind="stable")[:, :beam]
        ids[at], far[at], open_[at] = (np.take_along_axis(a, top, 1) for a in (i, f, o))
        live = live[open_[live].any(1)]
    return ids, far, np.stack(way, 1), np.stack(cost, 1)


def prune(x: np.ndarray, near: np.ndarray, far: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Per row of candidates (places, -1 for none, and their squared distances; repeats are dropped by
    the rule itself, being no distance from each other): the edges kept."""
    order = np.argsort(far, 1, kind="stable")
    near, far = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)
    v = x[near]
    apart = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive, row = (near >= 0) & np.isfinite(far), np.arange(len(near))
    out = np.full((len(near), degree), -1, np.int64)
    for k in range(degree):
        if not alive.any():
            break
        p, some = alive.argmax(1), alive.any(1)
        out[some, k] = near[some, p[some]]
        alive &= (alpha * alpha * apart[row, p] > far) & (near != near[row, p][:, None])
    return out


def _link_back(x: np.ndarray, graph: np.ndarray, came: np.ndarray, to: np.ndarray, degree: int, alpha: float) -> None:
    """Edges to -> came are added; lists that overflow are pruned among the nearest of both."""
    have = (graph[to] == came[:, None]).any(1)
    came, to = came[~have], to[~have]
    far = 2 - 2 * (x[came] * x[to]).sum(1)
    order = np.lexsort((far, to))
    came, to = came[order], to[order]
    nodes, first, count = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(first, count)
    keep = place < 2 * degree
    wide = np.full((len(nodes), 2 * degree), -1, np.int64)
    wide[np.repeat(np.arange(len(nodes)), count)[keep], place[keep]] = came[keep]
    for a in range(0, len(nodes), BATCH):
        part = nodes[a: a + BATCH]
        near = np.concatenate([graph[part], wide[a: a + BATCH]], 1)
        d = 2 - 2 * np.matmul(x[near], x[part][:, :, None])[:, :, 0]
        d[near < 0] = np.inf
        full = (near >= 0).sum(1) > degree
        graph[part[full]] = prune(x, near[full], d[full], degree, alpha)
        rest = np.take_along_axis(near[~full], np.argsort(near[~full] < 0, 1, kind="stable"), 1)
        graph[part[~full]] = rest[:, :degree]


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, passes: int = PASSES) -> tuple[np.ndarray, int]:
    """Directed graph of the unit rows of x (places, -1 for none) and the row where searches start,
    from which every row can be reached."""
    n, rng = len(x), np.random.default_rng(7)
    start = int((x @ x.sum(0)).argmax())
    graph = np.full((n, degree), -1, np.int64)
    if n > 1:
        some = min(degree // 2, n - 1)
        graph[:, :some] = (np.arange(n)[:, None] + 1 + np.argsort(rng.random((n, min(n - 1, 4 * some))), 1)[:, :some] * max(1, (n - 1) // (4 * some))) % n
    for k in range(passes):
        slack = alpha if k == passes - 1 else 1.0
        for part in np.array_split(rng.permutation(n), max(1, -(-n // BATCH))):
            # what lies far off on the way is proposed too: such edges lead from cluster to cluster
            _, _, way, cost = beam_search(x, graph, start, x[part], beam)
            more = graph[part]
            near, d = np.concatenate([way, more], 1), np.concatenate([cost, 2 - 2 * np.matmul(x[more], x[part][:, :, None])[:, :, 0]], 1)
            d[(near < 0) | (near == part[:, None])] = np.inf
            kept = prune(x, near, d, degree, slack)
            graph[part] = kept
            i, j = np.nonzero(kept >= 0)
            _link_back(x, graph, part[i], kept[i, j], degree, slack)
    return _reachable(x, graph, start), start


def _reachable(x: np.ndarray, graph: np.ndarray, start: int) -> np.ndarray:
    """The graph with edges to what cannot be reached, each from the nearest row that can."""
    found = np.zeros(len(x), bool)

    def walk(front: np.ndarray) -> None:
        while len(front):
            found[front] = True
            front = np.unique(graph[front])
            front = front[(front >= 0) & ~found[np.maximum(front, 0)]]

    walk(np.array([start]))
    while not found.all():
        lost = int((~found).argmax())
        host = int(np.where(found, x @ x[lost], -2).argmax())
        if (graph[host] >= 0).all():
            graph = np.concatenate([graph, np.full((len(x), 1), -1, np.int64)], 1)
        graph[host, int((graph[host] < 0).argmax())] = lost
        walk(np.array([lost]))
    return graph


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles), dims and two independent 64-bit hashes of v, of the vectors that take part."""
    ok = (F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.exists("embedding", lambda e: e != 0)
          & ~F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(ok)
            .select("vec_id", F.col("embedding").alias("v"), F.size("embedding").alias("dims"), F.xxhash64("embedding").alias("a"),
                    F.xxhash64(F.lit(1), "embedding").alias("b")))


def _least(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of a key; every task keeps k of a key at most before rows are shuffled."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def nodes(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors: a, b, dims, v and their k smallest vec_ids."""
    # the rank of an id, not of a row: rows that repeat an id take no place of another
    w = Window.partitionBy("a", "b").orderBy("vec_id")
    few = rows.select("a", "b", "dims", "v", "vec_id").withColumn("_k", F.dense_rank().over(w)).where(F.col("_k") <= k)
    return few.groupBy("a", "b").agg(F.first("dims").alias("dims"), F.first("v").alias("v"), F.sort_array(F.collect_set("vec_id")).alias("ids"))


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is divided out first, so squares stay in range."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def index(rows: DataFrame, k: int, shard: int = SHARD) -> DataFrame:
    """The stored index: dims, shard, ids, v, place in the shard, next (places), start."""
    points = nodes(rows, k)
    points = stored(points)
    size = points.groupBy("dims").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    # a shard is little data but long work, so shards are not gathered into few tasks by their bytes
    tasks = size.agg(F.sum("shards")).first()[0] or 1
    dealt = points.join(size, "dims").withColumn("shard", F.pmod("a", "shards").cast("int")).repartition(4 * tasks, "dims", "shard")

    def run(t: pa.Table) -> pa.Table:
        x = _unit(_rows(t["v"])).astype(np.float32)
        graph, start = build(x)
        lists = pa.array([g[g >= 0].tolist() for g in graph], pa.list_(pa.int32()))
        return pa.table({"dims": t["dims"], "shard": t["shard"], "ids": t["ids"], "v": t["v"], "place": pa.array(np.arange(len(x), dtype=np.int32)),
                         "next": lists, "start": pa.array(np.full(len(x), start, np.int32))})

    return stored(dealt.groupBy("dims", "shard").applyInArrow(run, "dims int, shard int, ids array<long>, v array<double>, place int, next array<int>, start int"))


def _answers(found: pa.Table, asked: pa.Table, k: int, width: int, exact: bool) -> pa.Table:
    """Of one shard: for each query its k+1 best ids and their cosines."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not len(found) or not len(asked):
        return out.empty_table()
    found = found.sort_by("place")
    full, ask = _unit(_rows(found["v"])), _unit(_rows(asked["v"]))
    ids = [np.array(i) for i in found["ids"].to_pylist()]
    x, parts = full.astype(np.float32), []
    if not exact:
        lists = found["next"].to_pylist()
        graph = np.full((len(x), max(1, max(map(len, lists)))), -1, np.int64)
        for i, g in enumerate(lists):
            graph[i, : len(g)] = g
    most = min(len(x), k + 1)
    for a in range(0, len(ask), BATCH):
        q = ask[a: a + BATCH]
        if exact:
            cos = q @ full.T
            # everything that could be among the best after rounding
            edge = np.partition(cos, len(x) - most, 1)[:, len(x) - most]
            who, near = np.nonzero(cos >= edge[:, None] - 1e-12)
        else:
            near, *_ = beam_search(x, graph, int(found["start"][0].as_py()), q.astype(np.float32), width)
            who, at = np.nonzero(near >= 0)
            near = near[who, at]
        score = (q[who] * full[near]).sum(1)
        many = np.array([len(ids[i]) for i in near], np.int64)
        who, score, vec = np.repeat(who, many), np.repeat(score, many), np.concatenate([ids[i] for i in near])
        order = np.lexsort((vec, -score, who))
        who, score, vec = who[order], score[order], vec[order]
        first = np.searchsorted(who, np.arange(len(q)))
        keep = np.arange(len(who)) - first[who] < k + 1
        parts.append((who[keep] + a, vec[keep], score[keep]))
    who, vec, score = (np.concatenate(c) for c in zip(*parts))
    return pa.table([asked["a"].to_numpy()[who], asked["b"].to_numpy()[who], vec, score], schema=out)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, width: int = WIDTH, exact: bool = False) -> DataFrame:
    """The k nearest rows of `vectors` (vec_id, embedding) to each of `queries` (vec_id, embedding):
    query_id, rank (from 1), vec_id, score; nearest first, ties to the smaller vec_id.

    A row is no candidate of a query with its vec_id. Vectors of another length than the query's are
    not compared. Rows with a null vec_id, and vectors that are null, empty, zero or hold null or
    non-finite components take no part, neither as query nor as candidate. Rows that repeat a vec_id
    are one id: it is found by its best vector and answered once. Fewer than k candidates are all
    returned; an empty side gives an empty result; other columns are ignored. `exact` compares with
    every vector of a shard instead of searching its graph.
    """
    rows, ask = usable(vectors), usable(queries)
    built = index(rows, k + 1, shard)
    once = ask.groupBy("a", "b").agg(F.first("dims").alias("dims"), F.first("v").alias("v"))
    once = stored(once)
    parts = once.groupBy("dims").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
    shards = built.select("dims", "shard").distinct().toDF("dims", "shard")
    each = once.join(parts, "dims").withColumn("part", F.pmod("b", "parts").cast("int")).join(shards, "dims").select("dims", "shard", "part", "a", "b", "v")
    copies = built.join(parts, "dims").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    keys = ["dims", "shard", "part"]
    best = copies.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInArrow(
        lambda found, asked: _answers(found, asked, k, width, exact), "a long, b long, vec_id long, score double")
    best = _least(best.groupBy("a", "b", "vec_id").agg(F.max("score").alias("score")), ["a", "b"], [F.desc("score"), "vec_id"], k + 1)
    # a vector that many queries share: its answers in every part, its queries over all parts
    spread = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    who = ask.select("a", "b", F.col("vec_id").alias("query_id"), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
    found = who.join(spread, ["a", "b", "salt"]).where("query_id <> vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, width: int = WIDTH) -> float:
    """Share of the true nearest ones, found by comparing with all vectors in blocks, that the search
    finds. One that is as near as the last true one counts as found."""
    got = search(vectors, queries, k, shard, width)
    true = search(vectors, queries, k, shard, exact=True)
    last = true.groupBy("query_id").agg(F.min("score").alias("last"), F.count("*").alias("all"))
    hit = got.join(last, "query_id").where(F.col("score") >= F.col("last") - 1e-12).groupBy("query_id").agg(F.count("*").alias("hits"))
    r = last.join(hit, "query_id", "left").agg(F.sum("all").alias("n"), F.sum("hits").alias("h")).first()
    return (r.h or 0) / r.n if r.n else 1.0
