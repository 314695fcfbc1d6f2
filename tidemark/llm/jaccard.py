"""N-gram Jaccard self-join by universe partitioning and the pigeonhole principle.

A document's set of shingles is dealt by a hash into m segments, the same for all sets of one size
band. Two sets that link differ in at most H shingles, so with more than H segments some segment
must agree: its subset of shingles, hashed, is a signature under which both are listed. In `loose`
segments the one-deletion neighbourhoods are listed too, so that the segment answers up to one
difference and counts for two. The numbers of segments of both kinds are allocated by expected
cost. Empty segments are not listed; a set that has too few full ones is dealt again under the next
seed until it has enough, and a pair is found under the smaller of its sets' last seeds.

A signature held by more than `COMMON` distinct sets would pair them all. It is left out, which is
exact for every set that has enough other signatures at its last seed and lost none at an earlier
one that sets end at. The other sets are joined again by single
shingles (the finest partition), and sets that consist of common shingles even among those are
tied to a few leaders of their groups, then compared across the clusters that result.

Every candidate passes a lower bound of its difference from few bucket counts, then one from as
many buckets as its sets are large, and then the exact comparison of the shingles of both texts.
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

from tidemark.llm import tokens
from tidemark.llm.components import components
from tidemark.llm.store import matching, stored

WIDTH = 5
#: Sets link when NUM * union <= DEN * intersection.
NUM, DEN = 75, 100
#: Distinct sets under one signature above which it is left to the later rounds.
COMMON = 16
#: Units of a signature of a set that is dealt again: a set that ends at this seed may be met here only.
DEALT_AGAIN = 3
#: Units charged to such a set where the signature is common.
ALL = 1 << 21
#: Buckets of the lower bound.
BUCKETS = 128
#: Numbers of 64 buckets each whose parities bound a difference within Spark.
ODD = 8
#: Expected cost of a signature of one shingle, against 1 for a longer one: its list is longer.
SINGLE = 4.0
#: Turns in which crowded groups are tied to leaders before their clusters are compared.
TURNS = 1
#: Members up to which a crowded group is compared in one place.
WHOLE = 512
#: Tasks among which the packs of one size band of a larger group are dealt.
SALTS = 8
#: Members of two packs that are compared at a time.
LEFT, RIGHT = 128, 4096
#: The parities of the bucket counts differ in no more places than the sets in shingles.
PARITIES = (" + ".join(f"bit_count(a_{k} ^ b_{k})" for k in range(ODD))
            + f" <= n_a + n_b - 2 * ceil({NUM} * (n_a + n_b) / {NUM + DEN})")
#: Shared groups just before a group of a set by which a pair is known to have been met there.
EARLIER = 8
#: Bytes of text whose signatures are made together.
BATCH = 2 << 20
U = np.uint64


def furthest(total: int) -> int:
    """Most shingles in which two linked sets of `total` shingles together can differ."""
    return total - 2 * -(-NUM * total // (NUM + DEN))


@lru_cache(None)
def lows(top: int) -> tuple[int, ...]:
    """Lower ends of the size bands up to size `top`: a set links within its band and the next."""
    out = [1]
    while out[-1] <= top:
        out.append(out[-1] * DEN // NUM + 1)
    return tuple(out)


@lru_cache(None)
def allocation(lo: int, hi: int) -> tuple[int, int]:
    """(segments, of which loose) for the sets of sizes lo to hi and the band above, by expected cost."""
    need = furthest(hi + hi * DEN // NUM) + 1
    best = None
    for loose_share in (0.0, 0.25, 0.5, 1.0):
        for m in sorted({max(1, int(need * f / (1 + loose_share))) for f in np.arange(0.5, 3.0, 0.05)}):
            q, good, cost = round(m * loose_share), True, 0.0
            for s in (lo, hi):
                p0 = (1 - 1 / m) ** s if m > 1 else 0.0
                p1 = s / m * (1 - 1 / m) ** (s - 1) if m > 1 else float(s == 1)
                p2 = s * (s - 1) / 2 / m**2 * (1 - 1 / m) ** (s - 2) if m > 1 and s > 1 else float(s == 2)
                units = (m - q) * (1 - p0) + q * (2 - 2 * p0 - p1)
                spread = (m * p0 * (1 - p0)) ** 0.5
                good &= units - 1.5 * spread >= 1.05 * (furthest(s + s * DEN // NUM) + 1) or s <= need
                cost += m * (1 - p0 + (SINGLE - 1) * p1) + q * (s / m + (SINGLE - 1) * 2 * p2)
            if good and (best is None or cost < best[0]):
                best = cost, m, q
    return (best[1], best[2]) if best else (need, 0)


def _segments(e: np.ndarray, owner: np.ndarray, m: np.ndarray, q: np.ndarray, salt: np.ndarray):
    """Signatures of sets under one dealing. e: shingles; owner: their set; m, q, salt: by set.
    Returns owner and signature of listed subsets, units each stands for, and units by set."""
    n = len(m)
    seg = (tokens.mix(e ^ salt[owner]) % m[owner].astype(U)).astype(np.int64)
    order = np.lexsort((seg, owner))
    e, owner, seg = e[order], owner[order], seg[order]
    start = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (seg[1:] != seg[:-1])]))
    size = np.diff(np.append(start, len(e)))
    value = tokens.mix(e * U(0x9FB21C651E98DF25) + U(1))
    total = np.add.reduceat(value, start)
    o, s = owner[start], seg[start]
    loose = s < q[o]
    tag = tokens.mix(salt[o] + s.astype(U) * U(0xD6E8FEB86659FD93))
    units = np.where(loose, np.minimum(size, 2), 1)
    sig, who = tokens.mix(total ^ tag), o
    part = np.repeat(loose & (size > 1), size)
    if part.any():
        k = np.repeat(np.arange(len(start)), size)[part]
        sig = np.concatenate([sig, tokens.mix((total[k] - value[part]) ^ tag[k])])
        who = np.concatenate([who, o[k]])
    # a segment whose one-deletion signature is common answers a difference less
    listed = np.concatenate([units, np.ones(len(sig) - len(units), np.int64)])
    return who, sig, listed, np.bincount(o, weights=units, minlength=n).astype(np.int64)


def signatures(e: np.ndarray, off: np.ndarray):
    """All signatures of some sets: set, signature, slot (0: with larger sets, 1: with smaller ones),
    units (DEALT_AGAIN before the set's last seed); and for each set and slot the units to spare."""
    size = np.diff(off)
    n = len(size)
    bands = np.array(lows(int(size.max()) if n else 1))
    home = np.searchsorted(bands, size, "right") - 1
    out, spare = [], np.full((n, 2), 1 << 20, np.int64)
    for slot in (0, 1):
        at = np.flatnonzero(home >= slot)
        band = home[at] - slot
        lo, hi = bands[band], bands[band + 1] - 1 if len(at) else bands[band]
        alloc = {b: allocation(int(bands[b]), int(bands[b + 1]) - 1) for b in np.unique(band)}
        partner = size[at] * DEN // NUM if slot == 0 else hi
        total = size[at] + partner
        need = total - 2 * -(-NUM * total // (NUM + DEN)) + 1
        m = np.array([alloc[b][0] for b in band], np.int64)
        q = np.array([alloc[b][1] for b in band], np.int64)
        seed = 0
        while len(at):
            own = np.repeat(np.arange(len(at)), size[at])
            flat = e[np.repeat(off[at] - np.concatenate([[0], np.cumsum(size[at])[:-1]]), size[at]) + np.arange(size[at].sum())]
            salt = tokens.mix(band.astype(U) * U(0xA0761D6478BD642F) + U(seed * 7919 + 13))
            who, sig, units, have = _segments(flat, own, m, q, salt)
            ends = have >= need
            out.append((at[who], sig, np.full(len(sig), slot, np.uint8), np.where(ends[who], units, DEALT_AGAIN).astype(np.uint8)))
            spare[at[ends], slot] = (have - need)[ends]
            at, band, need, m, q, seed = at[~ends], band[~ends], need[~ends], m[~ends], q[~ends], seed + 1
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, t) for t in (np.int64, U, np.uint8, np.uint8)], spare


def single_shingles(e: np.ndarray, off: np.ndarray):
    """As `signatures`, with every shingle a segment of its own: a linked set shares three quarters
    of a set's shingles, so it shares one of any quarter and one more."""
    size = np.diff(off)
    need = size + (-NUM * size // DEN) + 1
    n = len(size)
    spare = np.full((n, 2), 1 << 20, np.int64)
    spare[:, 0] = size - need
    return (np.repeat(np.arange(n), size), e, np.zeros(len(e), np.uint8), np.ones(len(e), np.uint8)), spare


def digest(e: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One number for each set, equal for equal sets."""
    total = np.concatenate([[U(0)], np.cumsum(tokens.mix(e + U(0x1234567)), dtype=U)])
    return tokens.mix((total[off[1:]] - total[off[:-1]]) ^ np.diff(off).astype(U)).view(np.int64)


def _sets(text: pa.Array):
    """(rows from, to, shingles, offsets) of a column, some texts at a time."""
    raw, off = tokens.parts(text)
    for i, j in tokens.slices(off, BATCH):
        found = []
        o = off[i: j + 1] - off[i]
        part = raw[off[i]: off[j]]
        for a, b in tokens.slices(o):
            h, row, *_ = tokens.words(part[o[a]: o[b]], o[a: b + 1] - o[a])
            found.append(tokens.shingle_sets(h, row, b - a, WIDTH))
        lead = np.cumsum([0] + [f[1][-1] for f in found])
        yield i, j, np.concatenate([f[0] for f in found]), np.concatenate([[0]] + [f[1][1:] + x for f, x in zip(found, lead)])


def parities(e: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Of each of n sets whether the buckets hold an odd number of its shingles, as ODD numbers."""
    width = 64 * ODD
    counts = np.bincount(owner * width + (tokens.mix(e ^ U(0x5BF03635)) % U(width)).astype(np.int64), minlength=n * width)
    return np.packbits((counts.reshape(n, width) & 1).astype(np.uint8), axis=1).view(np.int64)


def profiles(e: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Of each set the counts of at least twice as many buckets as it has shingles (a power of two),
    compressed; nothing where a count exceeds a byte."""
    size = np.diff(off)
    width = 1 << np.ceil(np.log2(np.maximum(2 * size, 64))).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(width)])
    own = np.repeat(np.arange(len(size)), size)
    bucket = (tokens.mix(e ^ U(0x2545F491)) & (width[own] - 1).astype(U)).astype(np.int64)
    counts = np.bincount(at[own] + bucket, minlength=at[-1])
    over = set(np.repeat(np.arange(len(size)), width)[counts > 255].tolist())
    small = counts.astype(np.uint8)
    return [b"" if i in over else zlib.compress(small[at[i]: at[i + 1]].tobytes(), 1) for i in range(len(size))]


def may_link(x: bytes, y: bytes) -> bool:
    """Whether the profiles of two sets allow a link: a set's shingles move no more counts than they are."""
    if not x or not y:
        return True
    x, y = (np.frombuffer(zlib.decompress(p), np.uint8).astype(np.int32) for p in (x, y))
    width = min(len(x), len(y))
    apart = np.abs(x.reshape(-1, width).sum(0) - y.reshape(-1, width).sum(0)).sum()
    return bool(apart <= furthest(int(x.sum() + y.sum())))


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), set (digest), sketch (bucket counts), parities of finer
    buckets and profile of each document."""
    def run(batches):
        for b in batches:
            for i, j, e, off in _sets(b.column(1)):
                n = j - i
                size = np.diff(off)
                own = np.repeat(np.arange(n), size)
                counts = np.bincount(own * BUCKETS + (tokens.mix(e) % U(BUCKETS)).astype(np.int64), minlength=n * BUCKETS)
                blob = np.minimum(counts, 255).astype(np.uint8).reshape(n, BUCKETS)
                odd = parities(e, own, n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, n).cast(pa.int64()), pa.array(size.astype(np.int64)), pa.array(digest(e, off)),
                     pa.array([r.tobytes() for r in blob], pa.binary()), pa.array(odd.tolist(), pa.list_(pa.int64())),
                     pa.array(profiles(e, off), pa.binary())],
                    ["doc_id", "n", "set", "sketch", "odd", "profile"])

    return docs.select("doc_id", "text").mapInArrow(tokens.lean(run), "doc_id long, n long, set long, sketch binary, odd array<long>, profile binary")


LISTS = "shard int, sets binary, sigs binary, flags binary, owners binary, spare binary"


def _listing(docs: DataFrame, make, shards: int) -> DataFrame:
    """Signatures of distinct sets of each batch, dealt to shards by signature."""
    def run(batches):
        for b in batches:
            for _, _, e, off in _sets(b.column(1)):
                ids = digest(e, off)
                size = np.diff(off)
                _, one = np.unique(ids, return_index=True)
                one = one[size[one] > 0]
                if not len(one):
                    continue
                o = np.concatenate([[0], np.cumsum(size[one])])
                flat = e[np.repeat(off[one] - o[:-1], size[one]) + np.arange(o[-1])]
                ids = ids[one]
                (who, sig, slot, units), spare = make(flat, o)
                shard = ((sig >> U(32)) * U(shards) >> U(32)).astype(np.int64)
                order = np.lexsort((who, shard))
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                where = (ids.view(U) % U(shards)).astype(np.int64)
                rows = []
                for k in range(shards):
                    at, mine = order[cuts[k]: cuts[k + 1]], np.flatnonzero(where == k)
                    if len(at) or len(mine):
                        rows.append((k, zlib.compress(ids[who[at]].tobytes(), 1), sig[at].tobytes(), (slot[at] << 4 | units[at]).tobytes(),
                                     ids[mine].tobytes(), spare[mine].astype(np.int32).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 5)],
                                                 ["shard", "sets", "sigs", "flags", "owners", "spare"])

    return docs.select("doc_id", "text").mapInArrow(tokens.lean(run), LISTS)


FOUND = "kind int, g long, members array<long>, slot int, units int"
_PAIRS, _LOST, _SPARE, _CROWD = 0, 1, 2, 3


def _groups(lists: DataFrame, crowds: bool) -> DataFrame:
    """Lists of equal signatures: kind 0 the sets of a rare one, 1 units lost by a set to common
    ones, 2 units a set had to spare, 3 the sets of a common one (if asked for, in blocks)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.concatenate([np.frombuffer(zlib.decompress(x), np.int64) for x in pdf["sets"]])
        sig = np.concatenate([np.frombuffer(x, U) for x in pdf.sigs])
        flag = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["flags"]])
        order = np.lexsort((flag, c, sig))
        c, sig, flag = c[order], sig[order], flag[order]
        last = np.ones(len(c), bool)
        last[:-1] = (c[1:] != c[:-1]) | (sig[1:] != sig[:-1])
        c, sig, flag = c[last], sig[last], flag[last]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(c) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(c)))
        rare = np.flatnonzero((size > 1) & (size <= COMMON))
        common = np.repeat(size > COMMON, size)
        parts = [pd.DataFrame({"kind": _PAIRS, "g": sig[start[rare]].view(np.int64),
                               "members": [c[a: a + k].tolist() for a, k in zip(start[rare], size[rare])], "slot": 0, "units": 0})]
        if common.any():
            units = (flag & 15).astype(np.int64)
            ending = np.repeat(np.logical_or.reduceat(units != DEALT_AGAIN, start), size)
            units = np.where(units == DEALT_AGAIN, np.where(ending, ALL, 0), units)
            lost = pd.DataFrame({"c": c[common], "slot": flag[common] >> 4, "units": units[common]}).groupby(["c", "slot"], as_index=False).units.sum()
            lost = lost[lost.units > 0]
            lost["units"] = lost.units.clip(upper=ALL)
            parts.append(pd.DataFrame({"kind": _LOST, "g": 0, "members": [[x] for x in lost.c.tolist()], "slot": lost.slot, "units": lost.units}))
            if crowds:
                blocks = [(int(np.int64(sig[a].view(np.int64))), c[i: min(i + 4096, a + k)].tolist())
                          for a, k in zip(start, size) if k > COMMON for i in range(a, a + k, 4096)]
                parts.append(pd.DataFrame({"kind": _CROWD, "g": [b[0] for b in blocks], "members": [b[1] for b in blocks], "slot": 0, "units": 0}))
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in pdf.owners])
        spare = np.concatenate([np.frombuffer(x, np.int32) for x in pdf.spare]).reshape(-1, 2)
        ids, one = np.unique(ids, return_index=True)
        for slot in (0, 1):
            parts.append(pd.DataFrame({"kind": _SPARE, "g": 0, "members": [[x] for x in ids.tolist()], "slot": slot, "units": spare[one, slot]}))
        return pd.concat(parts, ignore_index=True).astype({"members": object})

    return lists.groupBy("shard").applyInPandas(tokens.lean_group(run), FOUND)


def _pairs(found: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of the sets under rare signatures: at most COMMON by COMMON each."""
    m = F.array_sort("members")
    each = F.flatten(F.transform(m, lambda x, i: F.transform(F.slice(m, i + 2, COMMON), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return found.where(F.col("kind") == _PAIRS).select(F.explode(each).alias("p")).select("p.a", "p.b").distinct()


def _rare(found: DataFrame, classes: DataFrame, docs: DataFrame, described: DataFrame) -> DataFrame:
    """Links between the sets under rare signatures. Each set is first compared with the least of
    all its groups' members; then sets of one group that are not yet in one cluster."""
    groups = found.where(F.col("kind") == _PAIRS).select("g", "members")
    each = groups.select("g", F.array_min("members").alias("lead"), F.explode("members").alias("set"))
    first = each.where("lead <> set").groupBy("set").agg(F.min("lead").alias("lead"))
    tied = verified(_possible(first.select(F.col("lead").alias("a"), F.col("set").alias("b")), classes), docs, described)
    label = components(tied).join(classes.select("set", "rep"), F.col("node") == F.col("rep")).select("set", "component")
    open_ = (each.join(label, "set", "left").groupBy("g")
             .agg(F.collect_list(F.struct(F.coalesce("component", "set").alias("cluster"), "set")).alias("m"))
             .select(F.array_sort("m").alias("m")).where("m[0].cluster <> m[size(m) - 1].cluster"))
    m = F.col("m")
    across = F.flatten(F.transform(m, lambda x, i: F.transform(
        F.filter(F.slice(m, i + 2, COMMON), lambda y: y["cluster"] != x["cluster"]),
        lambda y: F.struct(F.least(x["set"], y["set"]).alias("a"), F.greatest(x["set"], y["set"]).alias("b")))))
    rest = open_.select(F.explode(across).alias("p")).select("p.a", "p.b").distinct()
    return tied.union(verified(_possible(rest, classes), docs, described))


def _crowded(found: DataFrame) -> DataFrame:
    """Sets for which the rare signatures are not enough."""
    units = found.where(F.col("kind").isin(_LOST, _SPARE)).select(
        F.element_at("members", 1).alias("set"), "slot",
        F.when(F.col("kind") == _LOST, -F.col("units")).otherwise(F.col("units")).alias("left"))
    return units.groupBy("set", "slot").agg(F.sum("left").alias("left")).where("left < 0").select("set").distinct()


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sizes and bucket counts allow a link, with the documents that stand for both."""
    side = classes.select("set", "n", "sketch", "rep")
    p = (pairs.join(side.toDF("a", "n_a", "sketch_a", "rep_a"), "a").where("n_a > 0")
         .join(side.toDF("b", "n_b", "sketch_b", "rep_b"), "b").where(f"{DEN} * least(n_a, n_b) >= {NUM} * greatest(n_a, n_b)"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16)
            y = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16)
            total = b.column(4).to_numpy(zero_copy_only=False)
            ok = np.abs(x - y).sum(1) <= total - 2 * -(-NUM * total // (NUM + DEN))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], ["a", "b"])

    return (p.select("rep_a", "rep_b", "sketch_a", "sketch_b", (F.col("n_a") + F.col("n_b")).alias("total"))
            .mapInArrow(tokens.lean(run), "a long, b long"))


def _close(pairs: DataFrame, described: DataFrame) -> DataFrame:
    """Stored pairs (a, b) of documents -> those whose profiles allow a link."""
    known = described.select("doc_id", "profile")
    ask = stored(pairs.select(F.col("b").alias("doc_id"), "a"))
    heads = stored(pairs.select(F.col("a").alias("doc_id")).distinct())
    right = matching(known, ask, "doc_id", "inner").select("a", F.col("doc_id").alias("b"), F.col("profile").alias("profile_b"))
    both = right.join(matching(known, heads, "doc_id").toDF("a", "profile_a"), "a").select("a", "b", "profile_a", "profile_b")

    def run(batches):
        for b in batches:
            ok = pa.array([may_link(x.as_py(), y.as_py()) for x, y in zip(b.column(2), b.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    return both.mapInArrow(tokens.lean(run), "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, described: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents whose sets link, from the texts of both."""
    pairs = stored(_close(stored(pairs), described))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ask = stored(pairs.select(F.col("b").alias("doc_id"), "a"))
    heads = stored(pairs.select(F.col("a").alias("doc_id")).distinct())
    # few pairs are broadcast, and then each text is shuffled once
    right = matching(texts, ask, "doc_id", "inner").select("a", F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    left = matching(texts, heads, "doc_id").toDF("a", "text_a")
    both = right.join(left, "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                b = batch.slice(k, 256)
                left = [(e, off) for _, _, e, off in _sets(b.column(2))]
                right = [(e, off) for _, _, e, off in _sets(b.column(3))]
                ok = np.array([_links(x, y) for x, y in zip(_each(left), _each(right))], bool)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], ["u", "v"])

    return stored(both.mapInArrow(tokens.lean(run), "u long, v long"))


def _each(found):
    for e, off in found:
        for i in range(len(off) - 1):
            yield e[off[i]: off[i + 1]]


def _links(x: np.ndarray, y: np.ndarray) -> bool:
    if not len(x) or not len(y):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return DEN * common >= NUM * (len(x) + len(y) - common)


def _band():
    return F.floor(F.log(F.col("n").cast("double")) / np.log(DEN / NUM) + 1e-9).cast("int")


def _dealt(part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the comparisons within groups: g, set, n, held (members of the group) with the
    band and salt under which they meet. Linked sets are at most one size band apart; those of a
    group of more than WHOLE members are dealt to SALTS tasks for each band, others are compared as they
    are. The rows may stand for packs of members, which are fewer."""
    large = F.col("held") > WHOLE
    band = _band()
    salt = F.pmod(F.xxhash64("set"), F.lit(SALTS)).cast("int")
    none, salts = F.array(F.lit(0)), F.sequence(F.lit(0), F.lit(SALTS - 1))
    one = part.withColumn("band", F.when(large, band).otherwise(0)).withColumn("salt", F.when(large, salt).otherwise(0))
    two = (part.withColumn("band", F.explode(F.when(large, F.array(band - 1, band, band + 1)).otherwise(none)))
           .withColumn("salt", F.explode(F.when(large, salts).otherwise(none))))
    return one, two


#: What a packed member is made of.
_MEMBER = ["set", "component", "n", *(f"odd_{k}" for k in range(ODD)), *(f"before_{k}" for k in range(EARLIER))]


def _packs(part: DataFrame) -> DataFrame:
    """Members of groups of more than WHOLE, packed: g, set and n (the least of the pack, for its name
    and band), held, rows. A pack is of one size band; there are the more packs and the larger ones the
    more members a group has, so that the copies of a member grow with the root of the group only."""
    m = (part.where(F.col("held") > WHOLE).withColumn("band", _band())
         .withColumn("deal", F.pmod(F.xxhash64("set"), F.ceil(F.sqrt(F.col("held") / WHOLE)).cast("long"))))
    before = [F.coalesce(F.get("before", F.lit(k)), F.lit(0)).cast("long").alias(f"before_{k}") for k in range(EARLIER)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[_MEMBER].to_numpy(np.int64)
        return pd.DataFrame({"g": [pdf.g.iloc[0]], "set": [pdf["set"].min()], "n": [pdf.n.min()], "held": [pdf.held.iloc[0]], "rows": [rows.tobytes()]})

    return (m.select("g", "band", "deal", "held", *_MEMBER[: 3 + ODD], *before).groupBy("g", "band", "deal")
            .applyInPandas(tokens.lean_group(run), "g long, set long, n long, held long, rows binary"))


def _apart(x: np.ndarray, y: np.ndarray, same: bool):
    """Pairs of sets of two packs (or within one) that are in two clusters, may link by their sizes and
    parities, and were not met in an earlier group; some at a time."""
    y = y[np.argsort(y[:, 2], kind="stable")]
    for k in range(0, len(x), LEFT):
        p = x[k: k + LEFT]
        i = np.searchsorted(y[:, 2], -(-NUM * p[:, 2].min() // DEN))
        j = np.searchsorted(y[:, 2], p[:, 2].max() * DEN // NUM, "right")
        for at in range(i, j, RIGHT):
            q = y[at: min(at + RIGHT, j)]
            n, m = p[:, None, 2], q[None, :, 2]
            ok = (p[:, None, 1] != q[None, :, 1]) & (DEN * np.minimum(n, m) >= NUM * np.maximum(n, m))
            if same:
                ok &= p[:, None, 0] < q[None, :, 0]
            odd = np.zeros(ok.shape, np.int64)
            for c in range(3, 3 + ODD):
                odd += np.bitwise_count(p[:, None, c].view(U) ^ q[None, :, c].view(U))
            ok &= odd <= n + m - 2 * -(-NUM * (n + m) // (NUM + DEN))
            u, v = np.nonzero(ok)
            met, late = np.zeros(len(u), bool), q[v, 3 + ODD:]
            for c in range(3 + ODD, 3 + ODD + EARLIER):
                own = p[u, c]
                met |= (own != 0) & (own[:, None] == late).any(1)
            a, b = p[u[~met], 0], q[v[~met], 0]
            yield np.minimum(a, b), np.maximum(a, b)


def _packed_pairs(part: DataFrame) -> DataFrame:
    """Pairs (a < b) of sets in groups of more than WHOLE members. The names of packs are dealt and
    meet; only pairs of packs that meet are given their members."""
    packs = stored(_packs(part))
    one, two = _dealt(packs.select("g", "set", "n", "held"))
    met = (one.select("g", "band", "salt", F.col("set").alias("x")).join(two.select("g", "band", "salt", F.col("set").alias("y")), ["g", "band", "salt"])
           .where("x <= y").select("g", "x", "y"))
    both = (met.join(packs.select("g", F.col("set").alias("x"), F.col("rows").alias("rows_x")), ["g", "x"])
            .join(packs.select("g", F.col("set").alias("y"), F.col("rows").alias("rows_y")), ["g", "y"]))

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                x, y, left, right = (c[k].as_py() for c in b.columns)
                left, right = (np.frombuffer(r, np.int64).reshape(-1, len(_MEMBER)) for r in (left, right))
                for lo, hi in _apart(left, right, x == y):
                    yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], ["a", "b"])

    return both.select("x", "y", "rows_x", "rows_y").mapInArrow(tokens.lean(run), "a long, b long")


def _crowds(found: DataFrame, sets: DataFrame, classes: DataFrame, docs: DataFrame, edges: DataFrame,
            described: DataFrame) -> DataFrame:
    """Links between sets made of common shingles. A set is listed under its least common shingles
    only, a quarter of all and one more, less the rare ones that are settled: a linked set shares
    one of them. In each of `TURNS` turns the members of a group that are not in its leader's cluster
    are compared with that leader; then members of clusters that are still apart are compared. There
    a row carries its set's groups just before, and a pair that was met in one of them is passed over."""
    listed = stored(found.where(F.col("kind") == _CROWD).select("g", F.explode("members").alias("set")).join(sets, "set", "left_semi"))
    common = listed.groupBy("set").agg(F.count("*").alias("common"))
    room = (common.join(classes.select("set", "n"), "set")
            .select("set", (F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1 - (F.col("n") - F.col("common"))).alias("room")))
    held = listed.groupBy("g").agg(F.count("*").alias("held"))
    least = W.partitionBy("set").orderBy("held", "g")
    before = F.collect_list("g").over(least.rowsBetween(-EARLIER, -1)).alias("before")
    members = stored(listed.join(held, "g").select("g", "set", F.row_number().over(least).alias("k"), before)
                     .join(room, "set").where("k <= room").select("g", "set", "before"))
    known = classes.select("set", "rep", "n", *(F.col("odd")[k].alias(f"odd_{k}") for k in range(ODD)))
    members = stored(members.join(known, "set"))
    for turn in range(TURNS + 1):
        cluster = components(edges)
        part = stored(members.join(cluster, F.col("rep") == F.col("node"), "left").drop("node")
                      .withColumn("component", F.coalesce("component", "rep")))
        mixed = (part.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("held"))
                 .where("lo < hi").select("g", "held"))
        part = part.join(mixed, "g")
        if turn == TURNS:
            break
        # every turn asks other leaders; up to four orders in a turn, so that groups do not all ask the same set
        rank = F.xxhash64("set", F.pmod("g", F.lit(4)), F.lit(turn))
        lead = part.groupBy("g").agg(F.min_by(F.struct(F.col("set").alias("lead"), F.col("component").alias("of")), rank).alias("l")).select("g", "l.*")
        star = (part.join(lead, "g").where("component <> of")
                .select(F.least("set", "lead").alias("a"), F.greatest("set", "lead").alias("b")).distinct())
        edges = stored(edges.union(verified(_possible(star, classes), docs, described)))
    part = stored(part)
    side = lambda x: part.where(F.col("held") <= WHOLE).select(
        "g", F.col("set").alias(x), F.col("component").alias(f"c_{x}"), F.col("n").alias(f"n_{x}"), F.col("before").alias(f"before_{x}"),
        *(F.col(f"odd_{k}").alias(f"{x}_{k}") for k in range(ODD)))
    whole = (side("a").join(side("b"), "g")
             .where(f"c_a < c_b and {DEN} * least(n_a, n_b) >= {NUM} * greatest(n_a, n_b) and {PARITIES} "
                    "and not arrays_overlap(before_a, before_b)")
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    across = whole.union(_packed_pairs(part)).distinct()
    return edges.union(verified(_possible(across, classes), docs, described))


def links(docs: DataFrame, described: DataFrame, shards: int) -> DataFrame:
    """Links (u, v) between the documents that stand for the distinct sets."""
    classes = stored(described.where("n > 0 and doc_id is not null").groupBy("set").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"),
        F.first("odd").alias("odd")))
    found = stored(_groups(_listing(docs, signatures, shards), False))
    edges = stored(_rare(found, classes, docs, described))
    crowded = stored(_crowded(found).join(classes.select("set", "rep"), "set").select(F.col("rep").alias("doc_id"), "set"))
    if crowded.isEmpty():
        return edges
    few = matching(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), crowded.select("doc_id"), "doc_id")
    again = stored(_groups(_listing(few, single_shingles, shards), True))
    edges = stored(edges.union(_rare(again, classes, docs, described)))
    left = stored(_crowded(again))
    if left.isEmpty():
        return edges
    return _crowds(again, left, classes, docs, edges, described)


def join(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """`docs` (doc_id, text) -> doc_id, n_shingles, component_id, one row for each input row.

    A set is the distinct five-word shingles of the whole text (with fewer words, the sequence as
    one). Null and empty texts and texts of blanks have an empty set and link with nothing. The
    component is the smallest doc_id reachable by links; exact copies are members of one set and
    are never expanded into pairs. A null doc_id has no component (null). Rows that repeat a
    doc_id are one document as far as links go. Other columns are ignored; an empty table gives no
    rows.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", "text")
    described = stored(describe(d))
    total = described.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # a shard holds about a million signatures
    shards = shards or max(64, int(total * 0.8 // 1_000_000))
    edges = links(d, described, shards)
    cluster = components(edges)
    rep = (described.where("n > 0 and doc_id is not null").groupBy("set").agg(F.min("doc_id").alias("rep")))
    of_set = rep.join(cluster, rep.rep == cluster.node, "left").select("set", F.coalesce("component", "rep").alias("of_set"))
    return (described.join(of_set, "set", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.coalesce("of_set", "doc_id")))
                    .otherwise(F.col("doc_id")).alias("component_id")))
