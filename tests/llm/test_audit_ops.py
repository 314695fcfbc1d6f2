"""Filter interactions, spelling variants and nearest neighbours, against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import interactions, neighbours, q_text, variants

DOC, LABEL = "doc_id long, text string, source string, row string, mask int", "doc_id long, quality int, toxic int, part string"


# ---- filter interactions

def documents(seed=2, n=150):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Aa", "BB", "#x"]
    rows = []
    for i in range(n):
        k = rnd.choice([0, 3, 150, 199, 200, 201, 260])
        some = vocab if rnd.random() < 0.5 else vocab[:60]
        words = [rnd.choice(some if rnd.random() < 0.97 else ["A", "B&", "CD"]) for _ in range(k)]
        rows.append((i, rnd.choice([" ", "\t", "\n ", "\x0b", "\x1c"]).join(words), rnd.choice(["s", "t", "", None])))
    rows += [(n + i, rows[rnd.randrange(n)][1], "s") for i in range(60)]
    rows += [(900, None, "u"), (901, "", None), (901, "", "u"), (902, "x " * 30_000, "s"), (None, "x", "s"), (None, None, None), (3, rows[3][1], "s"),
             (903, "É" * 50 + "A", "s"), (904, "É" * 49 + "A", "s")]
    return [(*r, "clash", 7) for r in rows]


LABELS = [(i, i % 3 % 2, int(i % 5 == 0), "clash") for i in range(0, 200, 2)] + [(4, 1, None, ""), (4, 0, 1, ""), (None, 1, 1, ""), (901, 1, 1, "")]


def brute_audit(rows, labels):
    good, toxic = {d for d, q, _, _ in labels if q == 1} - {None}, {d for d, _, t, _ in labels if t == 1} - {None}
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    docs = []
    for d, t, s, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        docs.append((s or "", {f for f in fails if fails[f]}, d in good, d in toxic))
    out, total = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                total[part, f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own),
                                                   sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_brute_force_and_sql(spark):
    rows = documents()
    docs, labels = spark.createDataFrame(rows, DOC).repartition(5), spark.createDataFrame(LABELS, LABEL)
    got = interactions.report(docs, labels).collect()
    want = brute_audit(rows, LABELS)
    assert len(got) == len(want)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas())
    con.register("labels", labels.toPandas())
    assert {tuple(r[:3]): tuple(r[3:]) for r in con.execute(q_text.ORACLES["op11_filter_interactions"]).fetchall()} == want


def test_audit_of_other_filters_and_empty_tables(spark):
    ids = spark.createDataFrame([(i, "p") for i in range(6)] + [(2, "p"), (None, "q")], "id long, part string")
    table = lambda *x: (spark.createDataFrame([(i,) for i in x], "id long"), "id")
    r = interactions.audit(ids, {"X": table(1, 2, 2, None), "Y": table(2, 3)}, table(2), table(), orders=["YX"])
    got = {(x.part, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in r.collect()}
    assert got == {("p", 1): (4, 3, 0, 1, 2, 0, 4), ("p", 2): (3, 1, 2, 1, 0, 0, 4), ("q", 1): (1, 0, 0, 0, 0, 0, 0), ("q", 2): (1, 0, 0, 0, 0, 0, 0)}
    none = spark.createDataFrame([], DOC)
    assert interactions.report(none, spark.createDataFrame([], LABEL)).count() == 0
    one = interactions.report(spark.createDataFrame(documents()[:1], DOC), spark.createDataFrame([], LABEL))
    assert one.count() == 600 and one.agg(F.sum("good_lost")).first()[0] == 0
    with pytest.raises(ValueError):
        interactions.audit(ids, {"XX": table()}, table(), table())


def test_copies_spread_over_tasks(spark):
    """The join that finds later copies is on text and id, and no join of the audit is on a text alone."""
    rows = interactions.measured(spark.createDataFrame(documents(), DOC))
    plan = interactions.later_copies(rows)._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join LeftAnti" in line)
    assert "digest" in join and "doc_id" in join


# ---- spelling variants

def brute_words(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_forms(n, factor=10):
    near, form = {w: [] for w in n}, {}
    by = defaultdict(list)
    for w in n:
        by[len(w)].append(w)
    for w in n:
        near[w] = [x for k in (len(w) - 1, len(w), len(w) + 1) for x in by[k] if one_edit(w, x)]
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= factor * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def counted(seed=4, n=400):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdeéÉ") for _ in range(rnd.randint(7, 10))) for _ in range(30)]
    out = {w: rnd.choice([5, 400, 4000, 40000]) for w in base}
    while len(out) < n:
        w = list(rnd.choice(list(out)))
        i = rnd.randrange(len(w))
        k = rnd.random()
        if k < 0.3:
            del w[i]
        elif k < 0.6:
            w.insert(i, rnd.choice("abcdeéÉ"))
        elif k < 0.9:
            w[i] = rnd.choice("abcdeéÉ")
        else:
            rnd.shuffle(w)
        out.setdefault("".join(w), rnd.choice([2, 2, 3, 30, 30, 300]))
    return out


def frame(spark, n):
    return spark.createDataFrame([(w, k, "clash", 1) for w, k in n.items()], "word string, n long, cell string, met int")


def result(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("tile, visitors", [(4096, 60_000), (20, 15)])
def test_variants_against_brute_force(spark, tile, visitors):
    n = counted()
    n |= {"x" * 3000: 2, "x" * 3001: 50, "y" * 2999 + "z": 2, "y" * 3000: 21}
    assert result(variants.group(frame(spark, n), tile=tile, visitors=visitors)) == brute_forms(n)


def test_variants_of_one_crowded_block(spark):
    """Words of the same letters: every tile meets every other one once."""
    n = {"".join(p): 2 + i % 90 for i, p in enumerate(itertools.permutations("abcdef"))} | {f"{'abcdef'[:i]}q{'abcdef'[i:]}": 500 for i in range(7)}
    assert result(variants.group(frame(spark, n), tile=64, visitors=100)) == brute_forms(n)


def test_one_edit_of_random_pairs():
    """A block's own words have one length; visitors the same one or one letter less."""
    rnd = random.Random(1)
    for size in range(1, 8):
        some = lambda k: list({"".join(rnd.choice("ab") for _ in range(k)) for _ in range(60)})
        own = some(size)
        guests = [w for w in some(size) if w not in own] + some(size - 1)
        every = own + [w for w in guests if w]
        u, v = variants.near_pairs(own, every[len(own):])
        got = [frozenset((every[i], every[j])) for i, j in zip(u, v)]
        want = {frozenset((a, b)) for a in own for b in every if a != b and one_edit(a, b)}
        assert len(got) == len(set(got)) and set(got) == want


def test_words_of_documents(spark):
    rnd = random.Random(8)
    parts = ["Schönheit", "ÄRGERNIS", "ärgernis", "abcdefgh", "abc×defgh÷", "naïveté", "short", "ÿÿÿÿÿÿÿ", "ŁódźAbcdefg", "x" * 5000]
    rows = [(rnd.choice([None, i, i, 7]), rnd.choice([None, "", " ".join(rnd.choice(parts) for _ in range(30)), "-".join(parts)])) for i in range(400)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, word string").repartition(3)
    want = brute_words(rows)
    assert {r.word: r.n for r in variants.words(docs).collect()} == want
    assert result(variants.group(variants.words(docs))) == brute_forms(want)


def test_variants_of_nulls_repeats_and_nothing(spark):
    rows = [("abcdefg", 15), ("abcdefg", 15), ("abcdefh", 3), (None, 4), ("", 4), ("abcdefgh", None)]
    got = result(variants.group(spark.createDataFrame(rows, "word string, n long")))
    assert got == {"abcdefg": (None, "abcdefg", 30, 1, None), "abcdefh": ("abcdefg", "abcdefg", 3, 1, 30)}
    assert variants.group(spark.createDataFrame([], "word string, n long")).count() == 0
    assert variants.words(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_variants_query_on_whole_texts(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(q_text.QUERIES["op12_spelling_variants"](spark, sf)) == brute_forms(brute_words(rows))


# ---- nearest neighbours

VEC = "vec_id long, embedding array<float>, label int, score string"


def brute_search(rows, queries, k):
    out = {}
    for qid in {q for q, *_ in queries}:
        best = {}
        for q in (np.array(v, np.float64) for i, v in queries if i == qid):
            for i, v in rows:
                if i != qid and len(v) == len(q):
                    v = np.array(v, np.float64)
                    best[i] = max(best.get(i, -2), float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)))
        out[qid] = sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return {q: v for q, v in out.items() if v}


def answers(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def agree(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)


def test_search_of_odd_rows(spark):
    rnd = np.random.default_rng(3)
    good = [(i, [float(x) for x in np.float32(rnd.normal(size=6))]) for i in range(80)]
    good += [(100 + i, good[0][1]) for i in range(40)] + [(150, [1.0, 2.0]), (200, [2.0, 1.0]), (250, [-1.0, 0.5]), (50, good[7][1]), (0, good[0][1])]
    bad = [(300, None), (350, []), (400, [0.0] * 6), (450, [1.0, None, 1, 1, 1, 1]), (500, [float("nan")] * 6), (550, [float("inf")] * 6), (None, good[3][1])]
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "c") for i, v in good + bad], VEC).repartition(4)
    queries = df.where("vec_id % 50 = 0")
    want = brute_search(good, [g for g in good if g[0] % 50 == 0], 5)
    agree(answers(neighbours.search(df, queries, shard=30)), want)
    agree(answers(neighbours.search(df, queries, shard=30, exact=True)), want)
    assert neighbours.search(df.limit(0), queries).count() == 0 and neighbours.search(df, queries.limit(0)).count() == 0


def test_graph_reaches_all_and_recalls(spark):
    rnd = np.random.default_rng(5)
    x = np.concatenate([rnd.normal(size=(1, 24)) * 5 + rnd.normal(size=(150, 24)) for _ in range(10)] + [np.ones((40, 24))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph, start = neighbours.build(x)
    seen, front = {start}, [start]
    while front:
        front = [int(j) for i in front for j in graph[i] if j >= 0 and int(j) not in seen]
        seen |= set(front)
    assert len(seen) == len(x) and ((graph >= 0).sum(1) <= graph.shape[1]).all()
    assert all(len(set(g[g >= 0])) == (g >= 0).sum() and i not in g for i, g in enumerate(graph))
    ids, far, *_ = neighbours.beam_search(x, graph, start, x[:200])
    true = np.sort(2 - 2 * x[:200] @ x.T, 1)[:, 4]
    assert (far[:, :5] <= true[:, None] + 1e-5).mean() > 0.97


def test_recall_of_the_table(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert neighbours.recall(v, v.where("vec_id % 50 = 0"), shard=150) >= 0.95
    got = q_text.QUERIES["op13_nearest_neighbours"](spark, sf)
    rows = [(r.vec_id, r.embedding) for r in v.collect()]
    agree(answers(got), brute_search(rows, [r for r in rows if r[0] % 50 == 0], 5))
