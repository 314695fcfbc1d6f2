"""Substring dedup: MinHash banding of paragraphs, exact verification, components, removal of runs.

A text is cut into paragraphs at line ends, and within a line at sentence ends and before capitals,
so that a passage set into other text still has its own pieces. Paragraphs with the same five-word
shingles are one class. Classes are banded by MinHash, with bands tuned for a wanted recall;
colliding classes are verified by the exact Jaccard of their shingles and clustered by connected
components. A paragraph whose cluster first occurs in another document is a repeat, and runs of
consecutive repeats with enough words are removed.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import jaccard, tokens
from tidemark.llm.components import components
from tidemark.llm.store import matching, stored

#: Paragraphs are near copies from this Jaccard similarity on, as in `jaccard`.
SIMILAR = jaccard.NUM / jaccard.DEN
#: Share of the pairs at that similarity that the bands find.
RECALL = 0.96
#: Rows of a band.
ROWS = 2
#: Least words of a run of repeats that is removed.
RUN_WORDS = 40
#: Rounds of leaders in a crowded band before its members of different clusters are compared.
ROUNDS = 3
BATCH = 8 << 20
U = np.uint64


@lru_cache(None)
def bands(recall: float = RECALL, similar: float = SIMILAR, rows: int = ROWS) -> int:
    """Fewest bands of `rows` rows that find the share `recall` of the pairs just at `similar`."""
    b = 1
    while 1 - (1 - similar**rows) ** b < recall:
        b += 1
    return b


def _cut(raw: np.ndarray, off: np.ndarray):
    """Paragraphs of some texts: row, number in the text, first and last byte in the text, words,
    word hashes, and the offsets of the paragraphs in them."""
    h, row, s, e, low = tokens.words(raw, off)
    if not len(h):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, h, np.zeros(1, np.int64)
    end = np.isin(low[e - 1], np.frombuffer(b".!?", np.uint8))
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    head = raw[s]
    nxt = raw[np.minimum(s + 1, len(raw) - 1)]
    capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E))
    start = np.ones(len(h), bool)
    start[1:] = end[:-1] | (lines[s[1:]] > lines[e[:-1]]) | (row[1:] != row[:-1]) | (capital[1:] & ~capital[:-1])
    at = np.flatnonzero(start)
    size = np.diff(np.append(at, len(h)))
    r = row[at]
    number = np.arange(len(at)) - np.searchsorted(r, r)
    return r, number, s[at] - off[r], e[at + size - 1] - off[r], size, h, np.append(at, len(h))


def _paragraphs(text: pa.Array):
    """(first row, paragraph arrays, shingles, offsets, digests), some texts at a time."""
    raw, off = tokens.parts(text)
    for a, b in tokens.slices(off):
        r, number, first, last, size, h, at = _cut(raw[off[a]: off[b]], off[a: b + 1] - off[a])
        own = np.repeat(np.arange(len(size)), size)
        e, o = tokens.shingle_sets(h, own, len(size), jaccard.WIDTH)
        yield a, (r, number, first, last, size), e, o, jaccard.digest(e, o)


def _minhash(e: np.ndarray, off: np.ndarray):
    """Band signatures in the form that `jaccard` lists: class, signature, slot and units."""
    n, out = len(off) - 1, []
    for b in range(bands()):
        sig = np.full(n, U(b + 1))
        for k in range(ROWS):
            low = np.minimum.reduceat(tokens.mix(e ^ U((b * ROWS + k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), off[:-1])
            sig = tokens.mix(sig * U(0xD6E8FEB86659FD93) + low)
        out.append(sig)
    return np.tile(np.arange(n), bands()), np.concatenate(out)


def _deal(key: np.ndarray, shards: int):
    shard = ((key >> U(32)) * U(shards) >> U(32)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    return [(k, order[cuts[k]: cuts[k + 1]]) for k in range(shards) if cuts[k + 1] > cuts[k]]


def _gathered(text: pa.Array):
    """Paragraphs of a batch in chunks large enough to be dealt out in few rows."""
    held, size = [], 0
    for a, p, e, o, c in _paragraphs(text):
        held.append((a + p[0], *p[1:], e, o, c))
        size += len(e)
        if size > BATCH // 12:
            yield _together(held)
            held, size = [], 0
    if held:
        yield _together(held)


def _together(held):
    lead = np.cumsum([0] + [len(x[5]) for x in held])
    cols = [np.concatenate([x[k] for x in held]) for k in (0, 1, 2, 3, 4, 5)]
    off = np.concatenate([[0]] + [x[6][1:] + n for x, n in zip(held, lead)])
    return (*cols, off, np.concatenate([x[7] for x in held]))


def _occurrences(docs: DataFrame, shards: int) -> DataFrame:
    """Where each class occurs, dealt to shards by class; identical ones of a document once each."""
    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for r, number, first, last, size, _, _, c in _gathered(b.column(1)):
                rows = [(k, zlib.compress(np.stack([c[at], ids[r[at]], number[at], first[at], last[at], size[at]]).astype(np.int64).tobytes(), 1))
                        for k, at in _deal(tokens.mix(c.view(U)), shards)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], ["shard", "blob"])

    return docs.mapInArrow(tokens.lean(run), "shard int, blob binary")


PLACES = "class long, doc_id long, number int, first int, last int, words int, home_doc long, home_number int, is_home boolean"


def _repeated(occurrences: DataFrame) -> DataFrame:
    """Occurrences of the classes that occur in more than one place, with the class's first place."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([np.frombuffer(zlib.decompress(v), np.int64).reshape(6, -1) for v in pdf.blob], 1)
        x = x[:, np.lexsort((x[2], x[1], x[0]))]
        start = np.concatenate([[True], x[0][1:] != x[0][:-1]])
        at = np.flatnonzero(start)
        many = np.repeat(np.diff(np.append(at, x.shape[1])) > 1, np.diff(np.append(at, x.shape[1])))
        home = at[np.cumsum(start) - 1]
        x, start, hd, hn = x[:, many], start[many], x[1][home][many], x[2][home][many]
        return pd.DataFrame({"class": x[0], "doc_id": x[1], "number": x[2], "first": x[3], "last": x[4], "words": x[5],
                             "home_doc": hd, "home_number": hn, "is_home": start})

    return occurrences.groupBy("shard").applyInPandas(tokens.lean_group(run), PLACES)


def _banded(docs: DataFrame, shards: int) -> DataFrame:
    """Band signatures of the distinct classes of each batch, as `jaccard` groups them."""
    def run(batches):
        for b in batches:
            for *_, e, off, c in _gathered(b.column(1)):
                _, one = np.unique(c, return_index=True)
                size = np.diff(off)[one]
                o = np.concatenate([[0], np.cumsum(size)])
                who, sig = _minhash(e[np.repeat(off[one] - o[:-1], size) + np.arange(o[-1])], o)
                cls = c[one][who]
                rows = [(k, zlib.compress(cls[at].tobytes(), 1), sig[at].tobytes(), bytes(len(at)))
                        for k, at in _deal(sig, shards)]
                if rows:
                    none = pa.array([b""] * len(rows), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[0] for x in rows], pa.int32()), *(pa.array([x[i] for x in rows], pa.binary()) for i in (1, 2, 3)), none, none],
                        ["shard", "sets", "sigs", "flags", "owners", "spare"])

    return docs.mapInArrow(tokens.lean(run), jaccard.LISTS)


def _shingles(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """class, shingles for some classes, from one document each; classes: class, doc_id, number."""
    wanted = stored(classes.groupBy("doc_id").agg(F.collect_set("number").alias("numbers")))
    some = matching(docs, wanted, "doc_id", "inner").select("doc_id", "text", "numbers")

    def run(batches):
        for b in batches:
            want = b.column(2).to_pylist()
            for a, (r, number, *_), e, off, c in _paragraphs(b.column(1)):
                asked = [set(want[a + i]) for i in range(int(r.max()) + 1)] if len(r) else []
                hit = [k for k, (i, n) in enumerate(zip(r.tolist(), number.tolist())) if n in asked[i]]
                if hit:
                    size = np.diff(off)[hit]
                    own = np.repeat(np.arange(len(hit)), size)
                    flat = np.concatenate([e[off[k]: off[k + 1]] for k in hit])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[hit]), pa.array([e[off[k]: off[k + 1]].tobytes() for k in hit], pa.binary()), pa.array(size.astype(np.int32)),
                         pa.array(jaccard.parities(flat, own, len(hit)).tolist(), pa.list_(pa.int64()))], ["class", "shingles", "n", "odd"])

    return some.mapInArrow(tokens.lean(run), "class long, shingles binary, n int, odd array<long>").dropDuplicates(["class"])


def _verified(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    side = shingles.select("class", "shingles")
    both = (pairs.join(side.toDF("a", "x"), "a").join(side.toDF("b", "y"), "b").select("a", "b", "x", "y"))

    def run(batches):
        for b in batches:
            ok = pa.array([jaccard._links(np.frombuffer(x, U), np.frombuffer(y, U))
                           for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["u", "v"])

    return both.mapInArrow(tokens.lean(run), "u long, v long")


def _near(docs: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """(class, cluster) of the classes that are near copies of others, and the first place of each
    class that was compared."""
    found = stored(jaccard._groups(_banded(docs, shards), True).where(F.col("kind").isin(jaccard._PAIRS, jaccard._CROWD)))
    pairs = stored(jaccard._pairs(found))
    crowd = stored(found.where(F.col("kind") == jaccard._CROWD).select("g", F.explode("members").alias("class")))
    used = stored(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(crowd.select("class")).distinct())

    def locate(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for r, number, _, _, _, _, _, c in _gathered(b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(ids[r]), pa.array(number.astype(np.int32))], ["class", "doc_id", "number"])

    where = matching(docs.mapInArrow(tokens.lean(locate), "class long, doc_id long, number int"), used, "class", "left_semi")
    first = stored(where.groupBy("class").agg(F.min(F.struct("doc_id", "number")).alias("p")).select("class", "p.*"))
    shingles = stored(_shingles(docs, first))
    edges = stored(_verified(pairs, shingles))
    if crowd.isEmpty():
        return components(edges).toDF("class", "cluster"), first
    open_ = crowd
    for _ in range(ROUNDS):
        lead = open_.groupBy("g").agg(F.min("class").alias("lead"))
        met = stored(open_.join(lead, "g").where("class <> lead"))
        tied = stored(_verified(met.select(F.col("lead").alias("a"), F.col("class").alias("b")).distinct(), shingles))
        open_ = stored(met.join(tied, (met.lead == tied.u) & (met["class"] == tied.v), "left_anti").select("g", "class"))
        edges = stored(edges.union(tied))
        if open_.isEmpty():
            break
    # tied members stay: one may be the only link of another that no leader matches
    label = components(edges).toDF("class", "cluster")
    part = stored(crowd.join(label, "class", "left").select("g", "class", F.coalesce("cluster", "class").alias("cluster")))
    mixed = part.groupBy("g").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).where("lo < hi").select("g")
    odds = range(jaccard.ODD)
    rest = stored(part.join(mixed, "g", "left_semi").join(shingles.select("class", "n", *(F.col("odd")[k].alias(f"odd_{k}") for k in odds)), "class")
                  .select("g", "class", "cluster", "n", *(f"odd_{k}" for k in odds)))
    met = (rest.toDF("g", "a", "c_a", "n_a", *(f"a_{k}" for k in odds)).join(rest.toDF("g", "b", "c_b", "n_b", *(f"b_{k}" for k in odds)), "g")
           .where(f"c_a < c_b and {jaccard.PARITIES}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    edges = stored(edges.union(_verified(met, shingles)))
    return components(edges).toDF("class", "cluster"), first


def repeats(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """Every paragraph that repeats one of an earlier document: doc_id, number, first and last byte,
    words, and the document that holds the first copy (`source`)."""
    d = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # a shard takes the bands of about eight megabytes of text
    shards = shards or max(64, int(size // (8 << 20)))
    places = stored(_repeated(_occurrences(d, shards)))
    near, first = _near(d, shards)
    near = stored(near.join(first, "class"))
    # the first place of a cluster, over its classes
    home = near.groupBy("cluster").agg(F.min(F.struct("doc_id", "number")).alias("h")).select("cluster", F.col("h.doc_id").alias("c_doc"), F.col("h.number").alias("c_number"))
    moved = stored(near.join(home, "cluster").select("class", "doc_id", "number", "c_doc", "c_number"))
    # classes that occur once but are near copies: their only place
    lone = moved.join(places.select("class").distinct(), "class", "left_anti").where("doc_id <> c_doc")
    spans = _spans(d, lone.select("doc_id", "number", F.col("c_doc").alias("source")))
    many = (places.join(moved.select("class", "c_doc"), "class", "left").withColumn("source", F.coalesce("c_doc", "home_doc"))
            .where("doc_id <> source").select("doc_id", "number", "first", "last", "words", "source"))
    return many.union(spans).dropDuplicates(["doc_id", "number"])


def _spans(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bytes and words of some paragraphs, by document and number."""
    listed = stored(wanted.groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("number", "source"))).alias("wanted")))
    some = matching(docs, listed, "doc_id", "inner").select("doc_id", "text", "wanted")

    def run(batches):
        for b in batches:
            ids, want = b.column(0).to_pylist(), [dict(x) for x in b.column(2).to_pylist()]
            for a, (r, number, first, last, size), *_ in _paragraphs(b.column(1)):
                hit = [k for k, (i, n) in enumerate(zip(r.tolist(), number.tolist())) if n in want[a + i]]
                if hit:
                    i = [a + int(r[k]) for k in hit]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[j] for j in i], pa.int64()), *(pa.array(x[hit].astype(np.int32)) for x in (number, first, last, size)),
                         pa.array([want[j][int(number[k])] for j, k in zip(i, hit)], pa.int64())],
                        ["doc_id", "number", "first", "last", "words", "source"])

    return some.mapInArrow(tokens.lean(run), "doc_id long, number int, first int, last int, words int, source long")


def removals(docs: DataFrame, run_words: int = RUN_WORDS, shards: int | None = None) -> DataFrame:
    """doc_id, spans (first and last byte of each removed run), removed_words, sources: one row for
    each document from which something goes."""
    by = W.partitionBy("doc_id").orderBy("number")
    r = repeats(docs, shards).withColumn("island", F.col("number") - F.row_number().over(by))
    runs = (r.groupBy("doc_id", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("words").alias("words"),
                                              F.collect_set("source").alias("sources")).where(F.col("words") >= run_words))
    return runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"),
                                      F.sum("words").alias("removed_words"),
                                      F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))


def dedup(docs: DataFrame, run_words: int = RUN_WORDS, shards: int | None = None) -> DataFrame:
    """`docs` with the repeated runs cut out of `text`; all columns and rows stay.

    The first document (by doc_id) that holds a passage keeps it. A text may become empty. Null and
    empty texts stay as they are; rows with a null doc_id are left alone and are no source; rows
    that repeat a doc_id are one document, and only the cuts found for that doc_id are made, where
    they fit the text. An empty table stays empty.
    """
    cuts = stored(removals(docs.select("doc_id", "text"), run_words, shards)).select(F.col("doc_id").alias("_cut_id"), "spans")
    names = docs.columns
    cut = docs.join(cuts, docs["doc_id"] == F.col("_cut_id"), "left").select(*(docs[c] for c in names), F.col("spans").alias("_spans"))
    # bytes between the spans, joined
    raw = F.col("text").cast("binary")
    kept = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.encode(F.lit(""), "UTF-8").alias("out")),
                       lambda acc, s: F.struct(s["last"].alias("at"), F.concat(acc["out"], F.substring(raw, acc["at"] + 1, s["first"] - acc["at"])).alias("out")),
                       lambda acc: F.concat(acc["out"], F.substring(raw, acc["at"] + 1, F.octet_length("text"))).cast("string"))
    return cut.select(*(F.when(F.col("_spans").isNotNull() & F.col("text").isNotNull(), kept).otherwise(F.col("text")).alias("text")
                        if c == "text" else F.col(c) for c in names))
