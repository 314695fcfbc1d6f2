"""LM scoring: a bigram trie with Elias-Fano levels, built and queried in shards.

Words are known by 64-bit hashes. The texts are read once and stored as batches of hashes, so that
every later step sees the same batches. They deal their word pairs to shards by the first word of the
pair (the context). A shard adds up the training counts of all batches and writes a trie:
contexts in order, monotone pointers to their successors, successors in order within their context,
and one byte of quantised log probability each. The levels are memory-mapped files of the task,
removed with it. Every pair of the batches is then looked up: its context by search, the pair by a
successor search relative to the context. Seen pairs have an absolutely discounted probability;
for others the context's remaining weight is multiplied by the word's own probability, which a
second table of shards, by word, answers.

Only sums by document come back, so nothing of the model has to fit one machine or the driver.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.store import stored

U = np.uint64
END, BEGIN = U(0x51ED270B7A1C3F85), U(0x2545F4914F6CDD1D)
#: Bytes of text in a batch, and elements of a trie level that are decoded at a time.
BATCH, BLOCK = 8 << 20, 1 << 16


def held_out(doc_id: Column) -> Column:
    """Rows that the model does not learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


class Level:
    """A non-decreasing sequence of 64-bit numbers in Elias-Fano form, in a memory-mapped file: the
    low bytes of each number, and the high parts as a bit vector with a one for every number."""

    def __init__(self, values: np.ndarray, path: str):
        n = len(values)
        top = int(values[-1]) if n else 0
        self.n, self.bytes = n, min(8, max(0, -(-max(0, (top // max(n, 1)).bit_length()) // 8)))
        low = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, : self.bytes]
        self.shift = 8 * self.bytes
        high = (values >> U(self.shift)).astype(np.int64) if self.shift < 64 else np.zeros(n, np.int64)
        at = high + np.arange(n)
        bits = np.zeros((int(at[-1]) + 8) // 8 if n else 0, np.uint8)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        self.starts = at[::BLOCK]
        low.tofile(path + ".low")
        bits.tofile(path + ".high")
        self.low = np.memmap(path + ".low", np.uint8, "r", shape=low.shape) if low.size else low
        self.high = np.memmap(path + ".high", np.uint8, "r") if bits.size else bits

    def block(self, k: int) -> np.ndarray:
        """Numbers k * BLOCK and on, one block."""
        i, j = k * BLOCK, min(self.n, (k + 1) * BLOCK)
        first = int(self.starts[k]) >> 3
        end = (int(self.starts[k + 1]) >> 3) + 1 if k + 1 < len(self.starts) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[first:end], bitorder="little")) + first * 8
        ones = ones[ones >= self.starts[k]][: j - i]
        out = np.zeros((j - i, 8), np.uint8)
        out[:, : self.bytes] = self.low[i:j]
        high = (ones - np.arange(i, j)).astype(U)
        return out.view("<u8")[:, 0] | (high << U(self.shift) if self.shift < 64 else U(0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each of the sorted keys, or -1."""
        out = np.full(len(keys), -1, np.int64)
        begin = 0
        for k in range(len(self.starts)):
            values = self.block(k)
            end = int(np.searchsorted(keys, values[-1], "right"))
            asked = keys[begin:end]
            at = np.minimum(np.searchsorted(values, asked), len(values) - 1)
            out[begin:end] = np.where(values[at] == asked, at + k * BLOCK, -1)
            begin = end
        return out

    def all(self) -> np.ndarray:
        return np.concatenate([self.block(k) for k in range(len(self.starts))]) if self.n else np.zeros(0, U)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each number, and the numbers that the bytes stand for: means of equal shares."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(1)
    cuts = np.unique(np.quantile(x, np.linspace(0, 1, 257)[1:-1]))
    code = np.searchsorted(cuts, x, "left")
    n = np.bincount(code, minlength=len(cuts) + 1)
    return code.astype(np.uint8), np.bincount(code, x, len(cuts) + 1) / np.maximum(n, 1)


class Trie:
    """Contexts, their successors, and quantised log probabilities, of sorted distinct pairs."""

    #: Bits of a successor's hash that are kept: they are compared only within a context.
    BITS = 40

    def __init__(self, context: np.ndarray, word: np.ndarray, count: np.ndarray, folder: str):
        start = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        kinds = np.diff(np.append(start, len(context)))
        total = np.add.reduceat(np.append(count, 0), start)[: len(start)] if len(start) else np.zeros(0, np.int64)
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        self.context = Level(context[start], os.path.join(folder, "context"))
        self.pointer = Level(np.append(start, len(context)).astype(U), os.path.join(folder, "pointer"))
        rank = np.repeat(np.arange(len(start), dtype=U), kinds)
        self.successor = Level((rank << U(self.BITS)) | (word >> U(64 - self.BITS)), os.path.join(folder, "successor"))
        self.code, self.value = quantise(np.log10((count - discount) / np.repeat(total, kinds)))
        self.left_code, self.left_value = quantise(np.log10(discount * kinds / np.maximum(total, 1)))

    def score(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of a pair's probability, or of its context's remaining weight; and which are seen."""
        every, place = np.unique(context, return_inverse=True)
        rank = self.context.find(every)[place]
        key = (np.maximum(rank, 0).astype(U) << U(self.BITS)) | (word >> U(64 - self.BITS))
        order = np.argsort(key, kind="stable")
        at = np.full(len(key), -1, np.int64)
        at[order] = self.successor.find(key[order])
        at[rank < 0] = -1
        # the successor lies between the pointers of its context
        begin = self.pointer.all().astype(np.int64)
        seen = (at >= 0) & (at >= begin[np.maximum(rank, 0)])
        left = np.where(rank >= 0, self.left_value[self.left_code[np.maximum(rank, 0)]] if len(self.left_code) else 0.0, 0.0)
        return np.where(seen, self.value[self.code[np.maximum(at, 0)]] if len(self.code) else 0.0, left), seen


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), kind)


def _batches(records: Iterator[pa.RecordBatch]):
    """(name, doc ids, held out, tokens, row of each token): texts with an end token each."""
    task, k = TaskContext.get().partitionId(), 0
    for b in records:
        raw, off = tokens.parts(b.column(2))
        held = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for i, j in tokens.slices(off, BATCH):
            n, hs, rows = j - i, [], []
            o = off[i: j + 1] - off[i]
            part = raw[off[i]: off[j]]
            for a, c in tokens.slices(o):
                h, row, *_ = tokens.words(part[o[a]: o[c]], o[a: c + 1] - o[a])
                hs.append(h)
                rows.append(row + a)
            h, row = np.concatenate([*hs, np.full(n, END)]), np.concatenate([*rows, np.arange(n)])
            order = np.argsort(row, kind="stable")
            yield f"{task}-{k}", b.column(0).slice(i, n), held[i:j], h[order], row[order]
            k += 1


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def _tokenised(docs: DataFrame) -> DataFrame:
    """The texts as batches, one row each: ids, held out and tokens of the documents, the distinct words
    by falling count, and the word at each place. To be stored: where batches are cut follows the
    session's settings, which are others while a table is stored."""
    kind = docs.schema["doc_id"].dataType

    def run(records):
        for name, ids, held, h, row in _batches(records):
            w, at, n = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            place = np.empty(len(w), np.uint32)
            place[order] = np.arange(len(w), dtype=np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([np.packbits(held).tobytes()], pa.binary()),
                 pa.array([_pack(np.bincount(row, minlength=len(held)))], pa.binary()), pa.array([w[order].tobytes()], pa.binary()),
                 pa.array([_pack(place[at])], pa.binary())], ["batch", "ids", "held", "size", "words", "places"])

    return docs.mapInArrow(run, f"batch string, ids array<{kind.simpleString()}>, held binary, size binary, words binary, places binary")


def _tokens(records: Iterator[pa.RecordBatch]):
    """(name, held out, tokens, row of each token) of stored batches: batch, held, size, words, places."""
    for b in records:
        for k in range(b.num_rows):
            name, held, size, w, places = (c[k].as_py() for c in b.columns)
            n = _unpack(size, np.int64)
            yield (name, np.unpackbits(np.frombuffer(held, np.uint8))[: len(n)].astype(bool),
                   np.frombuffer(w, U)[_unpack(places, np.uint32)], np.repeat(np.arange(len(n)), n))


#: Columns of the stored batches that `_tokens` reads.
HASHES = ["batch", "held", "size", "words", "places"]
LISTS = "shard int, batch string, a binary, b binary, n binary, docs binary, held binary"


def _listed(name: str, held: np.ndarray, a: np.ndarray, b: np.ndarray | None, row: np.ndarray, shards: int) -> pa.RecordBatch:
    """Distinct keys (a, b) of a batch with the documents they occur in, by shard of a."""
    order = np.lexsort((row, a) if b is None else (row, b, a))
    a, row = a[order], row[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    if b is not None:
        b = b[order]
        new[1:] |= b[1:] != b[:-1]
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(a)))
    key, second = a[start], None if b is None else b[start]
    cuts = np.searchsorted(_shard(key, shards), np.arange(shards + 1))
    occ = np.append(start, len(a))
    bits, rows = np.packbits(held).tobytes(), []
    for k in range(shards):
        i, j = cuts[k], cuts[k + 1]
        if j > i:
            rows.append((k, name, _pack(key[i:j]) if b is not None else key[i:j].tobytes(), b"" if b is None else second[i:j].tobytes(),
                         _pack(n[i:j].astype(np.uint32)), _pack(row[occ[i]: occ[j]].astype(np.uint32)), bits))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.string()] + [pa.binary()] * 5)],
                                      ["shard", "batch", "a", "b", "n", "docs", "held"])


def _words(batches: DataFrame, shards: int, pairs: bool) -> DataFrame:
    """Words, or pairs of a word and the next, of every batch."""
    def run(records):
        for name, held, h, row in _tokens(records):
            if pairs:
                before = np.concatenate([[BEGIN], h[:-1]])
                before[np.concatenate([[True], row[1:] != row[:-1]])] = BEGIN
                yield _listed(name, held, before, h, row, shards)
            else:
                yield _listed(name, held, h, None, row, shards)

    return batches.select(*HASHES).mapInArrow(run, LISTS)


def _counts(batches: DataFrame, shards: int) -> DataFrame:
    """Training counts of words, added up by shard: shard, words, counts, distinct, total."""
    def send(records):
        for _, held, h, row in _tokens(records):
            w, n = np.unique(h[~held[row]], return_counts=True)
            cuts = np.searchsorted(_shard(w, shards), np.arange(shards + 1))
            full = [k for k in range(shards) if cuts[k + 1] > cuts[k]]
            if full:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([w[cuts[k]: cuts[k + 1]].tobytes() for k in full], pa.binary()),
                     pa.array([_pack(n[cuts[k]: cuts[k + 1]].astype(np.uint32)) for k in full], pa.binary())], ["shard", "words", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.concatenate([np.frombuffer(x, U) for x in pdf.words])
        n = np.concatenate([_unpack(x, np.uint32) for x in pdf.counts]).astype(np.int64)
        w, at = np.unique(w, return_inverse=True)
        n = np.bincount(at, n, len(w)).astype(np.int64)
        return pd.DataFrame({"shard": [pdf.shard.iloc[0]], "words": [w.tobytes()], "counts": [_pack(n)], "kinds": [len(w)], "total": [int(n.sum())]})

    return (batches.select(*HASHES).mapInArrow(send, "shard int, words binary, counts binary").groupBy("shard")
            .applyInPandas(add, "shard int, words binary, counts binary, kinds long, total long"))


SUMS = "batch string, shard int, score binary, known binary, base binary, words binary, docs binary"


def _pair_scores(pairs: DataFrame, shards: int) -> DataFrame:
    """Of each batch and shard: log probabilities by document, and the words still to be answered,
    dealt by word (rows with `words`)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, parts = list(pdf.itertuples()), []
        for r in rows:
            n = _unpack(r.n, np.uint32).astype(np.int64)
            docs = _unpack(r.docs, np.uint32).astype(np.int64)
            held = np.unpackbits(np.frombuffer(r.held, np.uint8)).astype(bool)
            pair = np.repeat(np.arange(len(n)), n)
            parts.append((_unpack(r.a, U), np.frombuffer(r.b, U), np.bincount(pair, ~held[docs], len(n)).astype(np.int64), pair, docs))
        a, b, c = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.lexsort((b, a))
        sa, sb = a[order], b[order]
        new = np.ones(len(sa), bool)
        new[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
        start = np.flatnonzero(new)
        count = np.add.reduceat(c[order], start)
        ka, kb, kc = sa[start][count > 0], sb[start][count > 0], count[count > 0]
        with tempfile.TemporaryDirectory() as folder:
            trie = Trie(ka, kb, kc, folder)
            value, seen = trie.score(a, b)
            del trie
        out, begin = [], 0
        for r, (_, words, _, pair, docs) in zip(rows, parts):
            v, s = value[begin: begin + len(words)], seen[begin: begin + len(words)]
            begin += len(words)
            score = np.bincount(docs, v[pair])
            out.append((r.batch, -1, _pack(score), b"", b"", b"", b""))
            miss = ~s[pair]
            w, d = words[pair[miss]], docs[miss]
            o = np.argsort(w, kind="stable")
            cuts = np.searchsorted(_shard(w[o], shards), np.arange(shards + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                at = o[cuts[k]: cuts[k + 1]]
                out.append((r.batch, int(k), b"", b"", b"", w[at].tobytes(), _pack(d[at].astype(np.uint32))))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SUMS.split(", ")])

    return pairs.groupBy("shard").applyInPandas(run, SUMS)


def _word_scores(asked: DataFrame, counts: DataFrame, kinds: int, total: int) -> DataFrame:
    """Sums by batch and document: base, known words, and the probabilities of the words that
    `_pair_scores` left to be answered. asked: shard, batch, a (words), n, docs, open."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(right):
            w, n = np.frombuffer(right.words.iloc[0], U), _unpack(right.counts.iloc[0], np.int64)
        else:
            w, n = np.zeros(1, U), np.zeros(1, np.int64)
        out = []
        for r in left.itertuples():
            words, docs = np.frombuffer(r.a, U), _unpack(r.docs, np.uint32).astype(np.int64)
            at = np.minimum(np.searchsorted(w, words), len(w) - 1)
            c = np.where(w[at] == words, n[at], 0)
            p = np.log10((c + 1) / (total + kinds + 1))
            if r.open:
                out.append((r.batch, -1, _pack(np.bincount(docs, p)), b"", b""))
            else:
                size = _unpack(r.n, np.uint32)
                out.append((r.batch, -1, b"", _pack(np.bincount(docs, np.repeat(c > 0, size))), _pack(np.bincount(docs, np.repeat(p, size)))))
        return pd.DataFrame(out, columns=["batch", "shard", "score", "known", "base"])

    return (asked.groupBy("shard").cogroup(counts.groupBy("shard"))
            .applyInPandas(run, "batch string, shard int, score binary, known binary, base binary"))


def score(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """`docs` (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score;
    one row for each input row.

    Null and empty texts have the end token alone. A null doc_id is learnt from. Without training
    rows every word is unknown and only the base probabilities of an empty vocabulary remain. Rows
    that repeat are scored and counted each; other columns are ignored; an empty table gives no
    rows. The texts are read once.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = shards or max(64, int(size // (8 << 20)))
    batches = stored(_tokenised(d))
    counts = stored(_counts(batches, shards))
    kinds, total = counts.agg(F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    pair = stored(_pair_scores(_words(batches, shards, True), shards))
    single = _words(batches, shards, False).select("shard", "batch", "a", "n", "docs", F.lit(False).alias("open"))
    more = pair.where("shard >= 0").select("shard", "batch", F.col("words").alias("a"), F.lit(b"").alias("n"), "docs", F.lit(True).alias("open"))
    answers = _word_scores(single.union(more), counts, kinds, total)
    sums = pair.where("shard < 0").select("batch", "score", "known", "base").union(answers.select("batch", "score", "known", "base"))

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        h = left.iloc[0]
        n = len(h.ids)
        whole = {c: np.zeros(n) for c in ("score", "known", "base")}
        for r in right.itertuples():
            for c, kind_ in (("score", float), ("known", float), ("base", float)):
                if blob := getattr(r, c):
                    x = _unpack(blob, kind_)
                    whole[c][: len(x)] += x
        size_ = _unpack(h["size"], np.int64)
        return pd.DataFrame({"doc_id": pd.array(list(h.ids), dtype=object), "held_out": np.unpackbits(np.frombuffer(h.held, np.uint8))[:n].astype(bool),
                             "n_tokens": size_, "n_known": whole["known"].astype(np.int64), "train_tokens": total,
                             "base_score": whole["base"], "score": whole["score"]})

    return (batches.select("batch", "ids", "held", "size").groupBy("batch").cogroup(sums.groupBy("batch"))
            .applyInPandas(finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
